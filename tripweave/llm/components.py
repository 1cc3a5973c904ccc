"""Connected components of a link table, as rounds of joins.

Each round turns every node's links towards its smallest known neighbour, first over all
neighbours (large star), then over the smaller ones (small star), until nothing changes.
A round is written to the shared folder, so the lineage stays short and a lost executor
costs a re-read. Nothing but a row count and a checksum reaches the driver. What a round
shuffles and writes is dealt to as many tasks as its links need: every task of a shuffle leaves
files of a block each, which at many partitions and few links are far larger than the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


#: Links that one task of a round handles.
LINKS = 1 << 16


def _checksum(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(digest), F.lit(0)).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link, root being the smallest node reachable.

    Links are undirected and may repeat; loops, nulls and an empty table are fine. Nodes
    without a link between different nodes do not appear.
    """
    edges = (
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct()
    )
    edges = store(edges, "links")
    seen = _checksum(edges)
    while seen[0]:
        tasks = -(-seen[0] // LINKS)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .coalesce(tasks)
            .distinct()
        )
        edges = store(small.coalesce(tasks), "links")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
