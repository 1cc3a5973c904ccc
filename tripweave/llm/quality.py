"""Quality rules whose cutoffs are certified on labelled rows.

A rule rejects a text whose measure exceeds a cutoff. For every stratum (language) and rule the
cutoffs are tried from the most lenient on: the labelled good texts that a cutoff would reject
are a binomial count, and its exact lower tail at the tolerated risk is the p-value of "this
cutoff rejects too many good texts". The first cutoff that fails ends the sequence, so trying
many costs no confidence; over strata and rules the level is divided (Bonferroni). With
confidence ``1 - LEVEL`` no stratum then loses more than ``RULES * RISK`` of its good texts.
Of the certified cutoffs the one that catches most bad texts, less a price for each good one, is
taken, the more lenient of equals. A stratum with too few labels certifies nothing and keeps its texts.

Everything is DataFrame functions; a text's measures are written once and labels meet numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, packed, store

#: Tolerated share of good texts a single rule may reject, and the chance that any rule exceeds it.
RISK, LEVEL = 0.01, 0.1

#: Bad texts that must be caught for every good text rejected.
PRICE = 5

#: Strata whose cutoffs are broadcast to the rows, a few numbers each.
BROADCAST_STRATA = 10_000

#: Measure of each rule over the base columns, and its cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2, 0.15, 0.1)),
    "lines": ("n_dup_lines / n_lines", (0.8, 0.65, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("n_capitals / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "bars": ("n_bars / n_words", (0.8, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.15, 0.1)),
}

_SPACES = "\t\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _times(text: Column, chars: str) -> Column:
    """Characters of the text that are in ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more.

    Equal windows become neighbours by sorting them with their places; the places of windows
    with an equal neighbour, in order, cover three words each less what they share.
    """
    ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(rows: Column) -> Column:
        same = lambda x, k, d: F.coalesce(F.get(rows, k + d)["w"] == x["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(rows, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))

    # let ... in: a one-element array carries the sorted rows, so that they are computed once
    at = F.flatten(F.transform(F.array(ranked), places))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, keep: list[str], text: str = "text", stratum: str = "lang") -> DataFrame:
    """``pack`` (the kept columns), ``stratum`` and the measures of every whole text, null as empty."""
    rows = docs.select(packed(docs, *keep).alias("pack"), field(stratum).cast("string").alias("stratum"), F.coalesce(field(text).cast("string"), F.lit("")).alias("body"))
    lined = rows.withColumn("plain", F.translate("body", _SPACES, "    ")).withColumn("flat", F.translate("plain", "\n", " "))
    split = lined.withColumn("words", F.array_remove(F.split("flat", " "), "")).withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda line: F.length(F.trim(F.translate(line, _SPACES, "    "))) > 0)
    )
    sized = split.withColumn("n", F.size("words")).withColumn(
        "windows",
        F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<string>")),
    )
    return sized.select(
        "pack",
        "stratum",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.translate("flat", " ", "")).cast("long").alias("word_chars"),
        _times(F.col("body"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _times(F.col("body"), _CAPITALS).alias("n_capitals"),
        _times(F.col("body"), "|").alias("n_bars"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """Stirling's series, moved up by eight where its error is below 1e-13."""
    up = x + 8
    steps = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7)) - steps


def log_binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """log P(X <= k) for X binomial(n, risk): the top term, and the others in proportion to it.

    Above the mean the tail is no evidence of a low risk; it counts as 1.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    odds = (1 - risk) / risk
    rest = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k.cast("long")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, j: F.struct(
            (s["term"] * (k - j + 1) / (n - k + j) * odds).alias("term"), (s["total"] + s["term"] * (k - j + 1) / (n - k + j) * odds).alias("total")
        ),
        lambda s: F.log(s["total"]),
    )
    return F.when(k >= n * risk, F.lit(0.0)).when(k == 0, top).otherwise(top + rest)


def certify(measured: DataFrame, labels: DataFrame, doc_id: Column, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``(stratum, rule, cutoff, ...)``: the chosen certified cutoff of each stratum and rule.

    A repeated label counts once, as bad if any says so. Texts that fail the base rules are not
    the rules' to judge and are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = measured.where(~base_failed()).withColumn("key", doc_id.cast("long")).join(known, "key")
    trial = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (_value(r) > c).alias("hit")) for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts)])).alias("trial")
    good, hit = F.col("quality") > 0, F.col("trial.hit")
    counted = rows.select("stratum", "quality", trial).groupBy("stratum", "trial.rule", "trial.step", "trial.cutoff").agg(
        F.count_if(good).alias("n_good"), F.count_if(good & hit).alias("n_false"), F.count_if(~good & hit).alias("n_caught")
    )
    strata = counted.agg(F.count_distinct(F.coalesce("stratum", F.lit(""))).alias("n")).first()["n"]
    bar = math.log(level / (len(RULES) * max(strata, 1)))
    tested = counted.withColumn("passed", log_binomial_tail(F.col("n_false"), F.col("n_good"), risk) <= bar)
    keys = ["stratum", "rule"]
    upto = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = tested.withColumn("valid", F.min("passed").over(upto)).where("valid")
    gain = valid.withColumn("gain", F.col("n_caught") - PRICE * F.col("n_false")).where("gain > 0")
    first = gain.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gain").desc(), "step"))).where("rank = 1")
    return first.select("stratum", "rule", "cutoff", "n_good", "n_false", "n_caught")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``base_failed`` and ``kept`` added to measured rows."""
    fields = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    wide = cutoffs.groupBy(F.col("stratum").alias("of")).agg(*fields)
    wide = store(wide, "cutoffs")
    if wide.count() <= BROADCAST_STRATA:  # else a join that may shuffle the rows by stratum
        wide = F.broadcast(wide)
    rows = measured.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_value(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("of", *[f"cut_{r}" for r in RULES])


def assess(docs: DataFrame, labels: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``pack`` (the kept columns, the id among them), the measures, ``base_failed`` and ``kept`` for every row.

    A null text counts as empty and fails the base rules; a null stratum is one of its own.
    Repeated rows come out as often as they came in. Without labels nothing beyond the base
    rules is rejected. Kept columns may have any names.
    """
    measured = store(measure(docs, keep, text, stratum), "measures", compression="zstd")
    return judge(measured, certify(measured, labels, F.col("pack").getField(doc_id), risk, level))
