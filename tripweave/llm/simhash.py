"""Near copies by SimHash: a byte-position inverted index with count filtering.

Every text gets a 64-bit fingerprint of its word shingles. Two fingerprints that differ in at
most ``max_bits`` bits differ in at most that many bytes, so they share at least
``8 - max_bits`` bytes at equal positions: the guaranteed minimum. The index posts each
different fingerprint under its positional bytes; inside a posting list shared bytes are
tallied per pair, pairs that reach the minimum are kept, and a bit count verifies them.

A posting list under one byte holds 1/256 of all fingerprints, which is quadratic work. A key
therefore joins several positional bytes: of 8 positions dealt into groups, enough shared ones
put two (or more) into one group, so a few position sets already cover every such pair and none
is lost. The number of bytes in a key follows the number of fingerprints.

Long posting lists are cut into blocks and every pair of blocks is a unit of work, so no task
holds a whole list. A unit emits a spanning forest of its links, never all pairs: exact copies
share a fingerprint and count once, and a crowd of near copies costs a link per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fanout, field, slices, store
from .components import components

SHINGLE, SEED, MAX_BITS, POSITIONS = 4, 42, 4, 8

#: Members of a posting list that meet in one block.
BLOCK = 512

#: Fingerprints a posting list may hold on average before the key takes another byte.
LIST_LENGTH = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased word shingles, each hashed by XXH64; no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(gram) for gram in zip(*[words[i:] for i in range(shingle)])]
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(grams), step):
        hashes = np.array([digest(gram, seed) for gram in grams[at : at + step]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes of a text's shingles, repeats included; zero for none."""
    counts, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row; the fingerprint's 64 bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(field(doc_id).cast("long").alias("doc_id"), field(text).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def position_sets(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` positions; any ``shared`` of the 8 positions contain one of them.

    The positions are dealt into groups so small in number that ``shared`` positions must put
    ``width`` of them into one; all sets inside the groups then suffice.
    """
    if width >= shared:
        return list(combinations(range(POSITIONS), shared))
    groups = max(1, (shared - 1) // (width - 1)) if width > 1 else POSITIONS - shared + 1
    if width == 1:
        return [(p,) for p in range(groups)]
    dealt = [range(POSITIONS)[g::groups] for g in range(groups)]
    return [s for group in dealt for s in combinations(group, width)]


def _key(fp: Column, index: int, positions: tuple[int, ...]) -> Column:
    value = F.lit(index).cast("long")
    for p in positions:
        value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return value


def tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared positional bytes and differing bits of paired fingerprints."""
    differ = a ^ b
    folded = differ | (differ >> np.uint64(4))
    folded |= folded >> np.uint64(2)
    folded |= folded >> np.uint64(1)
    unequal = np.bitwise_count(folded & np.uint64(0x0101010101010101))
    return POSITIONS - unequal, np.bitwise_count(differ)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j, smaller index on top."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parent, high, low)
        parent = _roots(parent)
    return parent


def link_units(units: np.ndarray, sides: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal unit (adjacent), as a spanning forest.

    ``sides`` tells which of two blocks a row belongs to: -1 for a block against itself.
    Rows are compared at every offset inside their unit.
    """
    n = len(fps)
    parent = np.arange(n)
    last = np.searchsorted(units, units, side="right")
    live = np.arange(n)
    offset = 1
    while True:
        live = live[live + offset < last[live]]
        if not len(live):
            break
        i, j = live, live + offset
        meet = (sides[i] != sides[j]) | (sides[i] < 0)
        i, j = i[meet], j[meet]
        shared, bits = tally(fps[i], fps[j])
        good = shared >= POSITIONS - max_bits
        good &= bits <= max_bits
        parent = _hook(parent, i[good], j[good])
        offset += 1
    child = np.flatnonzero(parent != np.arange(n))
    return fps[child], fps[parent[child]]


def _link(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(block: np.ndarray) -> pa.RecordBatch:
            keys = block[:, :3]
            new = np.ones(len(block), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            a, b = link_units(np.cumsum(new), block[:, 3], np.ascontiguousarray(block[:, 4]).view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            if held:
                block = np.concatenate([*held, block])
            same = (block[:, :3] == block[-1, :3]).all(axis=1)
            cut = len(block) - int(same[::-1].argmin() if not same.all() else len(block))
            held = [block[cut:]]  # the last unit may go on in the next batch
            if cut:
                yield links(block[:cut])
        if held:
            yield links(held[0])

    return run


def linked(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, list_length: int = LIST_LENGTH) -> DataFrame:
    """Links ``(a, b)`` among different fingerprints ``fp`` at ``max_bits`` or fewer differing bits.

    The links span the same components as all such pairs do.
    """
    if not 0 <= max_bits < POSITIONS:
        raise ValueError("count filtering needs fewer differing bits than positions")
    spark = fps.sparkSession
    shared = POSITIONS - max_bits
    count = fps.count()
    width = next((w for w in range(1, shared) if count / 256**w <= list_length), shared)
    keys = F.array(*[_key(F.col("fp"), i, s) for i, s in enumerate(position_sets(shared, width))])
    posted = fps.select("fp", F.explode(keys).alias("key"))
    long_lists = posted.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = posted.join(long_lists, "key", "left").withColumn("mine", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp", "key"), F.col("blocks").cast("long"))).otherwise(F.lit(0).cast("long")))
    units = dealt.select("key", "mine", "fp", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")).select(
        "key",
        F.least("mine", F.col("other").cast("long")).alias("low"),
        F.greatest("mine", F.col("other").cast("long")).alias("high"),
        F.when(F.col("mine") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("mine")).alias("side"),
        "fp",
    )
    ready = units.repartition(fanout(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ready.mapInArrow(_link(max_bits), "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. ``component_id`` is the
    smallest doc_id reachable; rows with a null doc_id take part, and a component of such rows
    alone has a null id. Repeated rows come out as often as they came in. An empty table gives
    an empty result; other columns of ``docs`` are ignored.
    """
    rows = store(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    members = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "members")
    roots = components(linked(members.select("fp"), max_bits))
    grouped = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
