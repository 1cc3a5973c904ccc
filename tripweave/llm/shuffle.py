"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first: row after row of the matrix is
a multivariate hypergeometric draw from the room left in the shards, which is the law those
counts have under a uniform permutation of all rows. Then every partition permutes its rows and
hands out the first so many to shard 0, the next to shard 1 and so on; the rows are exchanged;
and every shard permutes what it got. Sizes are exact by construction, whatever the partitions
hold, so no key can be hot.

The rows and their random keys are written once before any count is taken: a task that runs
again after a lost executor reads the same rows and the same keys. A shard is permuted in
ranges of its random keys, each a bounded unit of work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, store

#: Rows that one range of a shard holds on average.
RANGE_ROWS = 1 << 20

#: numpy draws hypergeometric numbers from populations below this.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good items among ``drawn`` from ``good + bad``, for populations of any size.

    Beyond numpy's limit by inversion around the mode: the probabilities of a window of twelve
    standard deviations either side, from exact ratios of neighbours.
    """
    if drawn == 0 or good == 0:
        return 0
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(drawn, good)
    total = good + bad
    mean = drawn * good / total
    spread = int(12 * (mean * (bad / total) * max(total - drawn, 1) / total + 1) ** 0.5) + 1
    first, last = max(low, int(mean) - spread), min(high, int(mean) + spread)
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(weights - weights.max())
    return first + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows to move from each partition (its row count) to each shard (its exact size)."""
    if sum(counts) != sum(sizes):
        raise ValueError("the shards must hold all rows")
    rng = np.random.default_rng(seed)
    room = list(sizes)
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, count in enumerate(counts):
        left, rest = count, sum(room)
        for s in range(len(sizes)):
            rest -= room[s]
            taken = left if not rest and left else hypergeometric(rng, room[s], rest, left)
            matrix[p, s] = taken
            room[s] -= taken
            left -= taken
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart; the first shards hold the extra rows."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``pack`` (all columns of ``rows``), ``shard`` and ``slot`` (gapless from 0 in a shard).

    Every permutation of the rows over all places is equally likely. Repeated rows are rows of
    their own; null values do not matter; an empty table gives an empty result. Columns may have
    any names. The driver holds one number per partition and shard.
    """
    spark = rows.sparkSession
    drawn = rows.select(packed(rows).alias("pack"), F.spark_partition_id().alias("part"), F.rand(seed).alias("first"), F.rand(seed + 1).alias("second"))
    drawn = store(drawn, "drawn")
    held = {r["part"]: r["n"] for r in drawn.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(held)
    sizes = even_sizes(sum(held.values()), shards)
    matrix = communication_matrix([held[p] for p in parts], sizes, seed)
    bounds = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in zip(parts, np.cumsum(matrix, axis=1))], "part int, bounds array<long>")
    local = drawn.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("first", "second")))
    sent = local.join(bounds, "part").withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("place"))))
    ranges = max(1, -(-max(sizes) // RANGE_ROWS))
    ranged = sent.select("pack", "shard", "first", "second", F.floor(F.col("second") * ranges).cast("int").alias("range"))
    if ranges == 1:
        slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("second", "first"))
        return ranged.select("pack", "shard", (slot - 1).cast("long").alias("slot"))
    ranged = store(ranged, "ranged")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("second", "first"))
    return ranged.withColumn("rank", slot).join(starts, ["shard", "range"]).select("pack", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
