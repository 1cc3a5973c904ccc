"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

__all__ = ["fanout", "field", "gather", "packed", "ship", "slices", "store", "table", "unpacked"]

#: The six ASCII white-space characters; a word is a run of anything else.
SPACES = "\t\n\x0b\x0c\r "

#: Bytes of text that one step inside a task holds at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(frame: DataFrame, *keep: str) -> Column:
    """The kept columns as one struct, so that derived columns never clash with them."""
    return F.struct(*[field(c) for c in (keep or frame.columns)])


def unpacked(frame: DataFrame, columns: list[str], pack: str = "pack") -> DataFrame:
    return frame.select(*[field(pack).getField(c).alias(c) for c in columns])


def fanout(spark: SparkSession) -> int:
    """Partitions of an exchange that Spark must not shrink: its rows are few but dear."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes; a longer text stands alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start+length]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
