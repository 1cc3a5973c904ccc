"""Toxic passages by maximum-scoring segments.

Training counts in how many different labelled texts of either class a term occurs; terms are
words and word stems (leading letters), so inflected forms share evidence. A Dirichlet prior in
proportion to the overall counts shrinks the log-odds of a term, and only what exceeds its
sampling error counts as its score. Every other token costs a fixed amount, so the expected
score of a token is negative and a run of tokens with a high sum is a surprise.

Scoring reads each text once: a linear scan finds all maximal segments (the disjoint runs that
cannot gain from growing or shrinking), whose scores follow an extreme-value law on clean text.
Its parameters come from the clean token statistics, so each segment has an expected number of
chance rivals; the r best segments of a text together have a Poisson tail, and the smallest tail
over r is the evidence of the text. A logistic curve over that evidence gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import field, packed, slices, store

#: The model is fitted on at most so many labelled rows, those of the smallest hash of their id.
#: The rows that fit it, and so the model and what the driver holds, are bounded by this number.
LABELLED_ROWS = 20_000

#: Stems: leading letters of a longer word.
STEMS = (4, 5, 6)

#: Pseudo-documents that the Dirichlet prior adds to a class, as a share of all fitted ones; they
#: are dealt out by overall frequency.
PRIOR = 0.025

#: Standard errors taken off a log-odds, and what a token without evidence costs.
ERRORS, COST = 2.0, 0.25

#: A term counts if its log-odds is at least this much and exceeds its error by this much, and if it
#: occurs in this share of the toxic texts; rarer ones are mostly words that a few near copies share.
LEAST_ODDS, LEAST, LEAST_SHARE = 3.0, 0.5, 0.01

#: Expected chance rivals below which a segment is reported as a passage.
SIGNIFICANT = 0.05

#: Scores of tokens kept per worker before the memo starts anew.
MEMO = 200_000

_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Term scores and the calibration of their segment sums."""

    terms: dict[str, float] = member(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -4.0

    def memo(self) -> "Memo":
        return Memo(self.terms)


class Memo(dict):
    """Token scores, computed once per distinct token."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        best = max((self.terms.get(term, 0.0) for term in terms_of(word)), default=0.0)
        if len(self) > MEMO:
            self.clear()
        self[word] = value = best - COST
        return value


def terms_of(word: str) -> list[str]:
    """The word and its stems, a stem marked by a trailing dash."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, sum)`` of a score sequence, in linear time.

    Only tokens of positive score can open a segment, so the scan visits those and takes the
    cost of the gaps between them from prefix sums. The stack holds candidate segments with the
    prefix sum before and after each; a new one is merged to the left while an earlier candidate
    starts lower and ends lower than it does.
    """
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    prefix = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, prefix before, prefix after, index of the last lower start
    for hit in hits.tolist():
        piece = [hit, hit + 1, prefix[hit], prefix[hit + 1], -1]
        while True:
            below = len(stack) - 1
            while below >= 0 and stack[below][2] >= piece[2]:
                below = stack[below][4]
            piece[4] = below
            if below < 0 or stack[below][3] >= piece[3]:
                stack.append(piece)
                break
            piece = [stack[below][0], piece[1], stack[below][2], piece[3], -1]
            del stack[below:]
    return [(s, e, float(after - before)) for s, e, before, after, _ in stack]


def evidence(found: list[tuple[int, int, float]], length: int, rate: float, scale: float) -> float:
    """Minus log of the smallest Poisson tail over the r best segments of a text, for every r."""
    if not found:
        return 0.0
    best = np.sort(np.array([s for _, _, s in found]))[::-1]
    r = np.arange(1.0, len(best) + 1)
    logs = math.log(scale * max(length, 1)) - rate * best
    rivals = np.exp(logs)
    # A tail is no less than its first term and no more than Chernoff's bound; only what can be the
    # smallest is summed.
    first = rivals - r * logs + np.cumsum(np.log(r))
    bound = np.where(r > rivals, r * (np.log(r) - logs) - r + rivals, 0.0)
    left = np.flatnonzero(first >= bound.max() - 1e-9)
    worst, terms = 0.0, 50 + int(9 * math.sqrt(rivals[left].max()))
    for at in range(0, len(left), max(1, (1 << 20) // terms)):
        part = left[at : at + max(1, (1 << 20) // terms)]
        worst = max(worst, float(_tails(r[part], rivals[part], first[part], terms).max()))
    return min(worst, 200.0)


def _tails(r: np.ndarray, rivals: np.ndarray, first: np.ndarray, terms: int) -> np.ndarray:
    """Minus log of the chance of r or more at so many expected, ``first`` being that of r alone."""
    step, out = np.arange(1.0, terms + 1), np.zeros(len(r))
    above = r > rivals
    ratios = rivals[above, None] / (r[above, None] + step)
    out[above] = first[above] - np.log1p(np.cumprod(ratios, axis=1).sum(axis=1))
    # where r or more is the likelier side, the other one is summed
    r, rivals, first = r[~above], rivals[~above], first[~above]
    ratios = np.maximum(r[:, None] - step + 1, 0) / rivals[:, None]
    out[~above] = -np.log1p(-np.exp(-first) * np.cumprod(ratios, axis=1).sum(axis=1))
    return out


def probability(value: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, model.slope * value + model.offset))))


def score_text(text: str | None, model: Model, memo: Memo) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text and its significant passages as token spans with their expected rivals."""
    words = words_of(text)
    scores = np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))
    found = segments(scores)
    value = probability(evidence(found, len(words), model.rate, model.scale), model)
    passages = [(s, e, model.scale * len(words) * math.exp(-model.rate * x)) for s, e, x in found]
    return value, [p for p in passages if p[2] < SIGNIFICANT]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LABELLED_ROWS) -> DataFrame:
    """Different texts of the labelled rows the model may see, with their label (1: toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.select(field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text")).where("text IS NOT NULL").join(chosen, "doc_id")
    return rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in {t for w in set(words_of(text)) for t in terms_of(w)}:
                counts.setdefault(term, [0, 0])[toxic > 0] += 1
        if len(counts) > MEMO:
            yield _flat(counts)
            counts = {}
    if counts:
        yield _flat(counts)


def _flat(counts: dict[str, list[int]]) -> pa.RecordBatch:
    pairs = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["term", "toxic", "clean"])


def term_scores(rows: DataFrame) -> dict[str, float]:
    """Terms whose shrunk log-odds exceeds its error; their number is bounded by the fitted rows."""
    sizes = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    t, c = float(sizes["t"] or 0), float(sizes["c"] or 0)
    if not t or not c:
        return {}
    counted = rows.mapInArrow(_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("y"), F.sum("clean").alias("z"))
    added = PRIOR * (t + c)
    prior = F.lit(PRIOR) * (F.col("y") + F.col("z"))
    y, z = F.col("y") + prior, F.col("z") + prior
    odds = F.log(y / (F.lit(t + added) - y)) - F.log(z / (F.lit(c + added) - z))
    kept = counted.where(F.col("y") >= max(2.0, LEAST_SHARE * t)).where(odds >= LEAST_ODDS).select("term", (odds - F.lit(ERRORS) * F.sqrt(1 / y + 1 / z)).alias("score")).where(F.col("score") >= LEAST)
    return {r["term"]: r["score"] for r in kept.collect()}


def karlin_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``E[exp(rate * score)] = 1`` under the clean token statistics."""
    share = counts / counts.sum()
    if not (values[counts > 0] > 0).any():
        return math.log(2) / COST
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        total = float((share * np.exp(np.minimum(mid * values, 600))).sum())
        low, high = (mid, high) if total < 1 else (low, mid)
    return low


def _summaries(model: Model):
    """Per text: class, length and the scores of all its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in batches:
            length, sums, toxic = [], [], batch.column(1)
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                found = segments(np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words)))
                length.append(len(words))
                sums.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays([toxic, pa.array(length, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["toxic", "length", "sums"])

    return run


def _evidences(rate: float, scale: float):
    """Per text: class and evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence([(0, 0, s) for s in sums], n, rate, scale) for n, sums in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["toxic", "evidence"])

    return run


def _histogram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        counts: dict[float, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for value in map(memo.__getitem__, words_of(text)):
                    counts[value] = counts.get(value, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["value", "n"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, classes weighted as they come."""
    w = np.array([0.1, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    X = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (p - y) + ridge * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LABELLED_ROWS) -> Model:
    """A model from at most ``limit`` labelled rows; without both classes it calls nothing toxic."""
    rows = store(training_rows(docs, labels, usable, limit), "labelled")
    model = Model(terms=term_scores(rows))
    if not model.terms:
        return model
    histogram = rows.where("toxic = 0").mapInArrow(_histogram(model), "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    values, counts = np.array([r["value"] for r in histogram]), np.array([float(r["n"]) for r in histogram])
    model.rate = karlin_rate(values, counts)
    seen = store(rows.select("text", "toxic").mapInArrow(_summaries(model), "toxic int, length long, sums array<double>"), "segments")
    clean = seen.where("toxic = 0").select("length", F.coalesce(F.array_max("sums"), F.lit(0.0)).alias("best")).collect()
    # Maximum likelihood for the scale of the extreme-value law, one pseudo-text of no score added.
    model.scale = (len(clean) + 1) / (1 + math.fsum(r["length"] * math.exp(-model.rate * r["best"]) for r in clean))
    seen = seen.mapInArrow(_evidences(model.rate, model.scale), "toxic int, evidence double").orderBy("evidence", "toxic").collect()
    x = np.array([r["evidence"] for r in seen])
    y = np.array([float(r["toxic"] > 0) for r in seen])
    model.slope, model.offset = logistic(x, y)
    return model


_VERDICT = "score double, predicted int, passages array<struct<start_token:int,end_token:int,rivals:double>>"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``pack`` (the kept columns), ``score``, ``predicted`` and ``passages`` for every row.

    Null, empty and wordless texts score as texts without evidence; whole texts are read.
    Repeated rows come out as often as they came in; columns of any name may be kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        memo = known.memo()
        for whole in batches:
            for batch in slices(whole, "words"):
                found = [score_text(t, known, memo) for t in batch.column(1).to_pylist()]
                passages = pa.array([[{"start_token": s, "end_token": e, "rivals": x} for s, e, x in p] for _, p in found], pa.list_(pa.struct([("start_token", pa.int32()), ("end_token", pa.int32()), ("rivals", pa.float64())])))
                values = pa.array([v for v, _ in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array([int(v >= 0.5) for v, _ in found], pa.int32()), passages], ["pack", "score", "predicted", "passages"])

    rows = docs.select(packed(docs, *(keep or docs.columns)).alias("pack"), field(text).cast("string").alias("words"))
    schema = StructType([rows.schema["pack"], *StructType.fromDDL(_VERDICT).fields])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of the id as text divides by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
