"""Sinks: versioned tables, replaced, merged or appended without rewriting what stays.

Parquet has no merge, so a sink computes the next state as a table and, where asked, writes it as
a new version. A version is a manifest, one small file of the table's log that names the folders
it consists of; it appears by a rename once all data are there, so a reader sees the version
before or the one after and never a part. Partitions that a write does not touch keep their
folders. Data without a manifest, left by a crash, are written over. A table has one writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import params
from ..functions import geo, text

#: Incoming rows that one task of an append sorts at once.
APPEND_ROWS = 1 << 18


def replace_source(existing: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Next state after one source is captured again.

    Its old rows go, and so do rows of other sources that a captured hub of the same name
    within 400 m supersedes.
    """
    from ..operators.catalog import superseded

    others = existing.filter(F.col("source") != source)
    gone = superseded(others, incoming).select("hub_id")
    return others.join(gone, "hub_id", "left_anti").unionByName(incoming.withColumn("source", F.lit(source)), allowMissingColumns=True)


def replace_source_in(root: str, version: str, incoming: DataFrame, source: str) -> list[str | None]:
    """Capture one source of a table partitioned by source; returns the sources written.

    Only the source itself and those that lose superseded rows get new folders.
    """
    from ..operators.catalog import superseded

    spark = incoming.sparkSession
    existing = read_version(spark, root)
    others = existing.filter(F.col("source") != source)
    losing = others.join(superseded(others, incoming).select("hub_id"), "hub_id", "left_semi").select("source").distinct()
    touched = sorted({source, *(row["source"] for row in losing.collect())})  # names of sources, a folder each
    after = replace_source(existing, incoming, source).filter(F.col("source").isin(touched))
    write_version(after, root, version, "source", keep_others=True, emptied=tuple(touched))
    return touched


def _files(spark: SparkSession, path: str):
    """The shared file system of a path, and a constructor of its paths."""
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(context._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the manifests of a table, oldest first."""
    files, make = _files(spark, root)
    if not files.exists(make(f"{root}/log")):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(make(f"{root}/log")) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    files, make = _files(spark, root)
    stream = files.open(make(f"{root}/log/{name}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def committed(spark: SparkSession, root: str, version: str) -> bool:
    return any(name.split("-", 1)[1] == f"{version}.json" for name in versions(spark, root))


def _commit(spark: SparkSession, root: str, version: str, parts: dict[str, str]) -> None:
    files, make = _files(spark, root)
    draft = make(f"{root}/log/_draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
    out.close()
    number = len(versions(spark, root))
    if not files.rename(draft, make(f"{root}/log/{number:012d}-{version}.json")):
        raise RuntimeError(f"version {version} of {root} could not be committed")


def _folder(spark: SparkSession, value: str | None) -> str:
    """The folder Spark gives a partition value."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "_part=" + ("__HIVE_DEFAULT_PARTITION__" if value in (None, "") else escape(value))


def write_version(frame: DataFrame, root: str, version: str, partition_by: str | None = None, keep_others: bool = False, emptied: tuple = ()) -> str:
    """Write a version and commit it; an empty table is refused, a committed version is an error.

    With ``partition_by`` every value has a folder of its own; with ``keep_others`` the folders of values
    that ``frame`` does not hold are taken over from the last version as they are, but for the
    values ``emptied``, which have no rows any more.
    """
    spark = frame.sparkSession
    if committed(spark, root, version):
        raise ValueError(f"version {version} of {root} is committed already")
    path = f"{root}/versions/{version}"
    if partition_by:
        frame.withColumn("_part", F.col(partition_by)).write.mode("overwrite").partitionBy("_part").parquet(path)
    else:
        frame.write.mode("overwrite").parquet(path)
    files, make = _files(spark, path)
    folders = [f.getPath().getName() for f in files.listStatus(make(path)) if f.isDirectory()]
    if partition_by and not folders or not partition_by and spark.read.schema(frame.schema).parquet(path).isEmpty():
        raise ValueError("refusing to replace a table with an empty capture")
    parts = {name: f"{path}/{name}" for name in folders} if partition_by else {"": path}
    if keep_others and (before := versions(spark, root)):
        gone = {_folder(spark, value) for value in emptied}
        kept = {name: at for name, at in manifest(spark, root, before[-1])["parts"].items() if name not in gone}
        parts = {**kept, **parts}
    _commit(spark, root, version, parts)
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The last committed version."""
    return spark.read.parquet(*manifest(spark, root, versions(spark, root)[-1])["parts"].values())


def merge_logos(existing: DataFrame, answered: DataFrame) -> DataFrame:
    """Answered keys win, keys answered without a logo go, unanswered keys stay."""
    new = answered.select("brand_key", F.col("url").alias("new_url"), F.lit(True).alias("answered"))
    rows = existing.select("brand_key", F.col("url").alias("old_url")).join(new, "brand_key", "full")
    return rows.select("brand_key", F.when(F.col("answered"), F.col("new_url")).otherwise(F.col("old_url")).alias("url")).filter("url IS NOT NULL")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """Incoming rows whose key is new, the first of each.

    Both sides are dealt by key once, into as many tasks as the incoming rows need, so what a
    task sorts does not grow with the capture.
    """
    context = incoming.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-incoming.select(key).count() // APPEND_ROWS))
    known = existing.select(key).repartition(tasks, key).distinct()
    fresh = incoming.repartition(tasks, key).join(known, key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")


def retain(events: DataFrame, days: int = params.RETENTION_DAYS) -> DataFrame:
    """Events no older than ``days`` before the newest; on a dated table whole partitions go."""
    newest = events.agg(F.max("occurred_at").alias("newest"))
    return events.join(newest, F.lit(True)).filter(F.col("occurred_at") >= F.col("newest") - F.make_dt_interval(days=F.lit(days))).drop("newest")
