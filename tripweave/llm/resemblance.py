"""Near copies by resemblance: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

First come the links of ``simhash``: fingerprints of the same shingles, posted under their positional
bytes, tallied to the guaranteed minimum and counted by bits. Texts whose fingerprints are linked
meet and are verified by the exact Jaccard of their sets.

Fingerprints tell copies of few changes; a Jaccard of 0.8 seldom leaves them within four bits. So every
text also gets ``BANDS`` keys, each made of ``ROWS`` min-hashes of its shingles, and what the fingerprints
left apart meets where it shares a key, which a pair of Jaccard j does with probability
``1 - (1 - j**ROWS)**BANDS`` (0.9999 at 0.8), and is verified alike.

Texts with equal sets count once, and posting lists with the same members meet once. Bands are
worked off in rounds: what the first few keys connect needs no second look, so later rounds
read only the lists whose members are still apart, and few texts travel more than once or twice.
They travel compressed. Long posting lists are cut into blocks. First every block meets itself;
then, where a list still holds several components, all texts outside its largest one meet the
whole list, block by block, and no pair of different components is left out. What is connected
when texts meet is known where they meet, so only links between different components come out, as
links of their roots: a crowd of near copies costs a link per member once, and not once for every
key and block that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import fanout, field, slices, store
from .components import components
from .simhash import _hook

SHINGLE, SEED = 5, 42

#: Jaccard from which texts are near copies, as a fraction.
SIMILAR = (4, 5)

#: Keys of a text and min-hashes in each.
BANDS, ROWS = 24, 5

#: Bands of each round.
ROUNDS = ((0, 3), (3, 9), (9, BANDS))

#: Members of a posting list, and the shingles they hold, that meet in one block.
BLOCK, VOLUME = 512, 1 << 20

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str | None) -> np.ndarray:
    """The lower-cased five-word shingles in order, repeats included, each hashed by XXH64; a shorter text is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    count, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(count)), dtype=np.uint64, count=count)


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of a text's shingles."""
    return np.unique(hashes(text))


def keys(found: np.ndarray) -> list[int]:
    """One signed long per band; none for a text without words."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _FACTORS).min(axis=0))
    hashed = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(hashed, dtype=np.uint64).view(np.int64).tolist()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
    for whole in batches:
        for batch in slices(whole, "text"):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = hashes(text)
                found, raw = np.unique(every), (text or "").encode("utf-8", "surrogatepass")
                mark = np.uint64(simhash.majority(every)).astype(np.int64).item()
                out.append((doc_id, xxhash.xxh3_128_digest(found.tobytes()), mark, keys(found), len(found), len(raw), pa.compress(raw, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "digest", "fp", "bands", "size", "n_bytes", "packed"])


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i < j`` of sets with a Jaccard of ``SIMILAR`` or more."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    width, total = 4096, int((count > 1).sum())
    for at in range(0, total, width):
        a, b = np.searchsorted(column, (at, at + width))
        held = np.zeros((len(sets), min(width, total - at)), dtype=np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes - both
    i, j = np.nonzero(both * SIMILAR[1] >= union * SIMILAR[0])
    return i[i < j], j[i < j]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the roots that each unit (rows adjacent) connects, as a spanning forest."""
    unit, roots, sets = None, [], []

    def links() -> pa.RecordBatch:
        i, j = similar(sets)
        known, at = np.unique(np.array(roots, dtype=np.int64), return_inverse=True)
        parent = _hook(np.arange(len(known)), at[i], at[j])
        child = np.flatnonzero(parent != np.arange(len(known)))
        return pa.RecordBatch.from_arrays([pa.array(known[child]), pa.array(known[parent[child]])], ["a", "b"])

    for batch in batches:
        for name, root, n_bytes, text in zip(*[c.to_pylist() for c in batch.columns]):
            if name != unit:
                if len(sets) > 1:
                    yield links()
                unit, roots, sets = name, [], []
            roots.append(root)
            sets.append(shingles(pa.decompress(text, n_bytes, "zstd", asbytes=True).decode("utf-8", "surrogatepass") if n_bytes else None))
    if len(sets) > 1:
        yield links()


def _meet(units: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Verified links between the roots of the members ``(unit, cid, root)`` of each unit."""
    spark = texts.sparkSession
    ready = units.join(texts, "cid").select("unit", "root", "n_bytes", "packed").repartition(fanout(spark), "unit").sortWithinPartitions("unit")
    return store(ready.mapInArrow(_verify, "a long, b long"), name)


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the root of each ``cid``: itself if nothing is linked to it."""
    if roots is None:
        return rows.withColumn("root", F.col("cid"))
    return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components once the links between ``roots`` are added to what is connected already."""
    found = components(links)
    if roots is None:
        return found
    above = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return store(moved.union(found.join(roots, "node", "left_anti").select("node", "root")), "roots")


def _lists(posted: DataFrame, block: int) -> DataFrame:
    """``key, cid, size, root, blocks`` of the posting lists with several components, equal lists once."""
    sums = (F.count("*").alias("n"), F.sum("size").alias("volume"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
    lists = posted.groupBy("key").agg(*sums, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    lists = lists.groupBy("n", "volume", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("volume") / VOLUME)).cast("long")
    return store(posted.join(lists.select("key", blocks.alias("blocks")), "key").select("key", "cid", "size", "root", "blocks"), "members")


def _crossing(members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Units ``(unit, cid, root)`` in which the texts outside a long list's largest component meet all others."""
    long_lists = _rooted(members.where("blocks > 1").drop("root"), roots)
    parts = long_lists.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root", "volume")).alias("m"), F.sum("n").alias("n"), F.sum("volume").alias("volume")).where("n > m.n")
    count = lambda n, volume: F.greatest(F.ceil(n / block), F.ceil(volume / VOLUME), F.lit(1)).cast("long")
    main = main.select("key", F.col("m.root").alias("main"), count(F.col("m.n"), F.col("m.volume")).alias("inner"), count(F.col("n") - F.col("m.n"), F.col("volume") - F.col("m.volume")).alias("outer"))
    left = store(long_lists.join(main, "key").select("key", "cid", "root", (F.col("root") == F.col("main")).alias("inside"), "inner", "outer"), "left")
    left = left.withColumn("mine", F.pmod(F.xxhash64("cid", "key"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))))
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    crossing = left.select("key", "cid", "root", F.when(F.col("inside"), F.col("mine")).alias("b"), F.when(~F.col("inside"), F.col("mine")).alias("a"), F.explode(F.when(F.col("inside"), steps("outer")).otherwise(steps("inner"))).alias("other"))
    crossing = crossing.select(F.xxhash64("key", F.lit("main"), F.coalesce("a", "other"), F.coalesce("b", "other")).alias("unit"), "cid", "root")
    among = left.where(~F.col("inside")).select("key", "cid", "root", "mine", F.explode(steps("outer")).alias("other"))
    return crossing.union(among.select(F.xxhash64("key", F.lit("rest"), F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "cid", "root"))


def _marked(apart: DataFrame) -> DataFrame:
    """``cid, size, key``: the key names the linked fingerprints that a text's fingerprint belongs to."""
    marks = store(apart.select("fp").distinct(), "marks")
    linked = components(simhash.linked(marks)).withColumnRenamed("node", "fp")
    return apart.join(linked, "fp", "left").select("cid", "size", F.coalesce("root", "fp").alias("key"))


def _round(posted: DataFrame, texts: DataFrame, roots: DataFrame | None, block: int) -> DataFrame:
    """Components once the texts ``(cid, size, key)`` of equal keys have met."""
    members = _lists(_rooted(posted, roots), block)
    dealt = F.pmod(F.xxhash64("cid", "key"), F.col("blocks"))
    roots = _joined(_meet(members.select(F.xxhash64("key", dealt).alias("unit"), "cid", "root"), texts, "links"), roots)
    if not members.where("blocks > 1").isEmpty():
        roots = _joined(_meet(_crossing(members, roots, block), texts, "crossing"), roots)
    return roots


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, component_id)`` for every row; ids must be set and differ from each other.

    Null and empty texts, and texts without words, equal each other; a text of fewer than five
    words is one shingle. Texts of any length are compared whole. ``component_id`` is the
    smallest id reachable. An empty table gives an empty result; other columns are ignored.
    """
    given = docs.select(field(doc_id).cast("long").alias("doc_id"), field(text).cast("string").alias("text"))
    signed = store(given.mapInArrow(_sign, "doc_id long, digest binary, fp long, bands array<long>, size long, n_bytes long, packed binary"), "signed")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("cid"))
    texts = signed.select(F.col("doc_id").alias("cid"), "n_bytes", "packed")
    apart = store(signed.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("cid"), "size", "fp", "bands"), "apart")
    roots = _round(_marked(apart), texts, None, block)
    for first, last in ROUNDS:
        some = apart.select("cid", "size", F.explode(F.slice("bands", first + 1, last - first)).alias("key"))
        roots = _round(some, texts, roots, block)
    return _named(signed, classes, roots)


def _named(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    known = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("root", "cid").alias("component_id"))
    return signed.select("doc_id", "digest").join(known, "digest").select("doc_id", "component_id")
