"""From raw documents to packed token sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a frame;
all but the last return the columns they were given. ``run`` writes each stage to the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import packing, quality, resemblance, toxicity
from tripweave.llm.common import packed, ship, store, table, unpacked
from tripweave.session import prepare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    judged = quality.assess(docs, table(spark, sf_dir, "labels"), docs.columns)
    return unpacked(judged.where("kept"), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from labelled rows among them."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return unpacked(scored.where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (null ids last).

    Near copies share four fifths or more of their five-word shingles.
    Rows count on their own, so of repeated rows one stays, and rows that share an id but not
    their text do not drop each other.
    """
    ship(spark)
    rows = store(docs.select(packed(docs).alias("pack"), F.monotonically_increasing_id().alias("row")), "rows", compression="zstd")
    rows = rows.withColumn("doc_id", F.col("pack.doc_id").cast("long"))
    groups = store(resemblance.near_copies(rows.withColumn("text", F.col("pack.text")), doc_id="row").select(F.col("doc_id").alias("row"), "component_id"), "groups")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best"))
    return unpacked(rows.join(first.select(F.col("best.row").alias("row")), "row", "left_semi"), docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", keep_quality), ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("packing", pack_tokens)]

#: SQL cannot express the tokenizer; tests compare a run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
