"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tripweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and local benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRIPWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings results depend on; leave sizing to the cluster."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and versioned tables.

    The cluster names it in ``spark.checkpoint.dir``. Only on a single machine (tests, a
    laptop) a local folder stands in; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-tripweave-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def spread(frame, *keys: str):
    """Rows over all shuffle partitions ahead of a step that multiplies them.

    Adaptive execution sizes partitions by the bytes it sees, not by what a following
    explode or cell join makes of them; an explicit count keeps the work parallel.
    """
    spark = frame.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return frame.repartition(wanted, *keys)


def store(frame, name: str = "stage", **options: str):
    """A stage written once to the shared folder (with the writer's options) and read back.

    It cuts the lineage like a checkpoint, and the reader knows the table's real size, so
    a small stage is broadcast and a large one is not. A lost executor costs a re-read.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_root(spark)}/stages/{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
