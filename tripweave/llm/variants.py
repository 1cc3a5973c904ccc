"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

One edit changes few letter counts: a replaced letter puts the vectors of two words of equal
length at a squared distance of exactly 2, an inserted or deleted one those of adjacent lengths
at exactly 1. Words lie in blocks of one length; squared distances between a block and itself
or the next length come from one NumPy product, ``|x|^2 + |y|^2 - 2 xy``. Pairs in reach are
verified letter by letter.

So that a block meets few others, letters are dealt into four groups. One edit touches two
letters at most, hence leaves the counts of two whole groups as they were: words near each
other share at least one key (two groups, counts of their letters), and no pair is lost. A
list under one key that is longer than ``BLOCK`` is cut into blocks of one length each, and every pair
of blocks of equal or adjacent length is a unit of work of its own. A pair that shares several
keys counts under the first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fanout, field, slices, store

LEAST_LENGTH, LEAST_COUNT, RATIO, DROPPED = 7, 2, 10, 31

#: Words that meet in one block.
BLOCK = 1024

#: Code points of a block's words held for verification at once.
CELLS = 1 << 22

#: Words of a list that meet in one product, whatever their lengths.
SMALL = 192

#: Pairs that go out at once.
OUT_ROWS = 8192

#: Bytes of different words a task counts before it passes them on.
HELD_BYTES = 16 << 20

#: Runs of letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")

#: Letters of a word after lower-casing A-Z, each with its place in the count vector and its group.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
GROUPS = 4
KEYS = list(combinations(range(GROUPS), 2))
_PLACE = np.full(0x100, -1)
_PLACE[LETTERS] = np.arange(len(LETTERS))
_GROUP = np.arange(len(LETTERS)) % GROUPS


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text and how often each occurs; a null id is written as nothing."""
    found: Counter = Counter()
    name = b"" if doc_id is None else str(doc_id).encode()
    for raw, times in Counter(_RUN.findall((text or "").encode("utf-8", "surrogatepass").lower())).items():
        if len(raw) < LEAST_LENGTH:
            continue
        word = raw.decode()
        if len(word) < LEAST_LENGTH:
            continue
        h = zlib.crc32(name + b":" + raw)
        if h % DROPPED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        found[word] += times
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = len(held)
                counted = words_of(doc_id, text)
                held.update(counted)
                size += (len(held) - before) * 64 + sum(map(len, counted)) // 8
                if size > HELD_BYTES:
                    yield out()
                    held, size = Counter(), 0
    if held:
        yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` for every word that occurs often enough; tasks add up before the exchange."""
    rows = docs.select(field(doc_id).cast("long").alias("doc_id"), field(text).cast("string").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word; letters outside the alphabet are an error of the caller."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    held = np.bincount(owner * len(LETTERS) + _PLACE[codes], minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS))
    # products of single precision are exact up to 2**24
    return held.astype(np.float32 if held.max(initial=0) < 256 else np.float64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0).to_pylist()
        counts = letter_counts(words).astype("<u4")
        keys = np.empty((len(words), len(KEYS)), dtype=np.int64)
        for k, groups in enumerate(KEYS):
            part = np.ascontiguousarray(counts[:, np.isin(_GROUP, groups)])
            keys[:, k] = [xxhash.xxh64_intdigest(row, k) // 16 * len(KEYS) + k for row in part]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array(list(keys), pa.list_(pa.int64()))], ["word", "length", "keys"]
        )


def _grid(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, a byte each, aligned on the left and on the right."""
    both = ("".join([w.ljust(longest, "\0") for w in words]), "".join([w.rjust(longest, "\0") for w in words]))
    return tuple(np.frombuffer(text.encode("latin-1"), dtype=np.uint8).reshape(len(words), longest) for text in both)


def one_edit(words: list[str], lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs, of equal or adjacent lengths, are one inserted, deleted or replaced letter apart.

    Such words agree before the edit and after it: letters alike at both ends make up the shorter one.
    """
    longest = int(lengths.max())
    if longest * len(words) <= CELLS or len(words) <= 2:
        return _ends(words, lengths, i, j, longest)
    first, second = np.array([0]), np.array([1])  # very long words: a pair at a time
    return np.array([one_edit([words[a], words[b]], lengths[[a, b]], first, second)[0] for a, b in zip(i, j)])


def _ends(words: list[str], lengths: np.ndarray, i: np.ndarray, j: np.ndarray, longest: int) -> np.ndarray:
    ahead, behind = _grid(words, longest)
    alike = np.empty(len(i), dtype=np.int64)
    step = max(1, CELLS // longest)
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        alike[at : at + step] = (ahead[a] != ahead[b]).argmax(axis=1) + (behind[a] != behind[b])[:, ::-1].argmax(axis=1)
    return alike >= np.minimum(lengths[i], lengths[j]) - (lengths[i] == lengths[j])


def _blocks(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index blocks that meet: a small list as a whole, else those of equal or adjacent length."""
    if len(lengths) <= SMALL:
        yield np.arange(len(lengths)), np.arange(len(lengths))
        return
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        for theirs in (mine, np.flatnonzero(lengths == length + 1)):
            for p in range(0, len(mine), BLOCK):
                for q in range(p if theirs is mine else 0, len(theirs), BLOCK):
                    yield mine[p : p + BLOCK], theirs[q : q + BLOCK]


def near_pairs(words: list[str], sides: np.ndarray, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart that meet first under a key of kind ``key``.

    ``sides`` names the block of each word; words of equal side do not meet unless it is negative.
    """
    lengths = np.array([len(w) for w in words])
    counts = letter_counts(words)
    norms = (counts * counts).sum(axis=1)
    for left, right in _blocks(lengths):
        apart = norms[left][:, None] + norms[right][None, :] - 2 * (counts[left] @ counts[right].T)
        i, j = np.nonzero((apart == 1) | (apart == 2))
        i, j = left[i], right[j]
        step = lengths[j] - lengths[i]
        keep = ((step == 1) | (step == 0) & (i < j)) & ((sides[i] != sides[j]) | (sides[i] < 0))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        changed = counts[i] != counts[j]
        same = [~changed[:, _GROUP == g].any(axis=1) for g in range(GROUPS)]
        first = np.stack([same[a] & same[b] for a, b in KEYS], axis=1).argmax(axis=1) == key
        i, j = i[first], j[first]
        if len(i):
            good = one_edit(words, lengths, i, j)
            yield i[good], j[good]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words inside each unit (rows adjacent), in both directions."""
    unit, words, sides, counts = None, [], [], []
    found: tuple[list, list, list] = ([], [], [])

    def meet() -> None:
        for i, j in near_pairs(words, np.array(sides), unit[0] % len(KEYS)):
            for x, y in ((i, j), (j, i)):
                found[0].extend(words[k] for k in x)
                found[1].extend(words[k] for k in y)
                found[2].extend(counts[k] for k in y)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        named = np.stack([np.asarray(c) for c in batch.columns[:3]], axis=1)
        starts = np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1
        bounds = [0, *starts.tolist(), len(named)] if len(named) else [0]
        side, word, n = (c.to_pylist() for c in batch.columns[3:])
        for a, b in zip(bounds, bounds[1:]):
            now = tuple(named[a].tolist())
            if now != unit:
                if len(words) > 1:
                    meet()
                unit, words, sides, counts = now, [], [], []
            words += word[a:b]
            sides += side[a:b]
            counts += n[a:b]
        if len(found[0]) >= OUT_ROWS:
            yield out()
            for column in found:
                column.clear()
    if len(words) > 1:
        meet()
    yield out()


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of words one edit apart, each once."""
    spark = vocab.sparkSession
    keyed = vocab.select("word", "n").mapInArrow(_with_n(_keys), "word string, n long, length int, keys array<long>")
    posted = store(keyed.select("word", "n", "length", F.explode("keys").alias("key")), "posted")
    # long lists alone are numbered: blocks of one length, each with its place inside the list
    sizes = posted.groupBy("key", "length").count()
    sizes = sizes.withColumn("members", F.sum("count").over(Window.partitionBy("key"))).where(F.col("members") > block)
    cut = store(sizes.select("key", "length", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "cut")
    zero = F.lit(0).cast("long")
    dealt = posted.join(cut, ["key", "length"], "left").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")))
    units = dealt.where("blocks IS NULL").select("key", zero.alias("low"), zero.alias("high"), F.lit(-1).cast("long").alias("side"), "word", "n")
    around = F.array(*[F.struct((F.col("length") + d).alias("length"), F.lit(-d).alias("step"), F.col("blocks").alias("theirs")) for d in (-1, 0, 1)])
    meets = cut.select("key", F.explode(around).alias("m")).select("key", "m.*")
    paired = dealt.where("blocks IS NOT NULL").drop("blocks").join(meets, ["key", "length"])
    paired = paired.select("key", "length", "word", "n", "mine", "step", F.explode(F.sequence(zero, F.col("theirs") - 1)).alias("other"))
    name = lambda length, place: length.cast("long") * (1 << 32) + place
    mine, other = name(F.col("length"), F.col("mine")), name(F.col("length") + F.col("step"), F.col("other"))
    long = paired.select("key", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), F.when(mine == other, F.lit(-1).cast("long")).otherwise(mine).alias("side"), "word", "n")
    ready = units.union(long).repartition(fanout(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ready.mapInArrow(_meet, "word string, near string, near_n long")


def _with_n(keys):
    """Carry ``n`` past a step over words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in keys(iter([batch])):
                yield pa.RecordBatch.from_arrays([out.column(0), batch.column(1), out.column(1), out.column(2)], ["word", "n", "length", "keys"])

    return run


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every ``word, form``: the last word its forms lead to, by pointer doubling.

    A form occurs ten times as often as its word, so a chain of k forms needs 10**k words and a
    few rounds follow the longest.
    """
    ends = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        ends = moved.select("word", "root")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the texts.

    A word's form is its near word of largest count (ties: smallest in code-point order) if that
    is ten times its own or more; root follows forms to the last. Null and empty texts have no
    words, a null id is written as nothing before the colon; repeated rows count again. Texts
    without frequent words, or no texts, give an empty result. Other columns are ignored.
    """
    vocab = store(vocabulary(docs, doc_id, text), "vocabulary")
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = vocab.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    is_form = F.coalesce(F.col("best_n") >= RATIO * F.col("n"), F.lit(False))
    judged = store(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "judged"
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
