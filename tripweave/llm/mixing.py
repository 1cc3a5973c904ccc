"""Mixing sources to target weights by hash-threshold histograms.

Every text has a 60-bit hash, and a budget of a source is spent on the texts whose hash lies
below a threshold. To find it, words are summed by source and hash bucket; running sums name the
bucket in which the budget ends, and only the texts of that boundary bucket are summed again, by
the next bits of their hash, until one text is left: it is taken if that brings the sum nearer.
Thresholds are nested (a larger budget takes a superset) and the mix is a filter: nothing is
sorted but the sums, of which a source has 4,096 at most.

The last text may be long, so texts of a source are cut in classes, longer ones first, and what
a class misses or exceeds is made up by the next: the sum ends within half a text of the last
class. A text may be taken several times: whole copies of a class come first, the threshold
spends the rest.

All of it is DataFrame functions. Sources are ranked in one task, a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, packed, store

#: Weights of the sources in code-point order, repeating; words of the mix for each given word; most copies.
WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2

#: A class holds the texts above these multiples of their source's mean size; the last one all others.
CLASSES = (2.0, 0.25)

#: Bits of a hash, and of a histogram.
HASH_BITS, BUCKET_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space, null as none."""
    marked = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.char_length(marked), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """The hash of a text under its id: rows alike in both are taken together or not at all."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``sid, weight, target`` beside the given ``source, source_size, n_docs``.

    The weights share the budget; where a source would pass its ceiling it stops there and the
    excess goes to the others by weight. With sources in order of ceiling over weight, those
    before the water level stop and the rest divide what they leave.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("sid", F.row_number().over(by_name))
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("long"))
    named = named.withColumn("ceiling", ceiling * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    named = named.withColumn("place", F.row_number().over(order)).withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - (F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ceiling")))
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    reached = F.when(F.col("level") <= F.col("ceiling") / F.col("weight"), F.struct("place", "level"))
    level = F.min(reached).over(everything)["level"]
    target = F.least(F.col("ceiling").cast("double"), F.coalesce(F.col("weight") * level, F.col("ceiling").cast("double")))
    return named.withColumn("target", target).select("source", "sid", "weight", "source_size", "n_docs", "target")


def _bucket(level: int) -> Column:
    """The hash down to the bits of a level."""
    return F.shiftright("h", HASH_BITS - BUCKET_BITS * (level + 1))


def _boundary(sums: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """Where each budget ``rest`` ends: ``sid, prefix, before, total, n`` of the boundary bucket.

    A budget spent exactly ends before the bucket named; one that is not covered has no row.
    """
    run = Window.partitionBy("sid").orderBy("prefix")
    running = sums.withColumn("before", F.sum("total").over(run) - F.col("total"))
    met = running.join(budgets.select("sid", "rest"), "sid").where("before <= rest AND rest < before + total")
    return met.select("sid", "prefix", F.lit(level).alias("level"), "before", (F.col("rest") - F.col("before")).alias("rest"), "total", "n")


def thresholds(rows: DataFrame, sums: DataFrame, budgets: DataFrame, of_class: int) -> DataFrame:
    """``sid, cut, spent`` for each budget ``sid, rest`` over the class's ``rows (sid, class, h, size)``.

    ``sums`` holds the first histogram. A level reads the boundary buckets of the one before.
    """
    state = store(_boundary(sums.where(F.col("class") == of_class), budgets, 0), "boundary")
    done, rows, level = [], rows.where(F.col("class") == of_class), 0
    while True:
        last = (level + 1) * BUCKET_BITS >= HASH_BITS
        open_ = (F.col("n") > 1) & (F.col("rest") > 0) & F.lit(not last)
        done.append(state.where(~open_))
        if last or state.where(open_).isEmpty():
            break
        edge = state.where(open_).select("sid", "prefix", "rest")
        rows = store(rows.withColumn("prefix", _bucket(level)).join(edge.drop("rest"), ["sid", "prefix"], "left_semi").select("sid", "h", "size"), "edge")
        level += 1
        finer = rows.groupBy("sid", _bucket(level).alias("prefix")).agg(F.sum("size").alias("total"), F.count("*").alias("n"))
        state = store(_boundary(finer, edge, level), "boundary")
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    nearer = 2 * F.col("rest") >= F.col("total")
    width = F.lit(HASH_BITS) - BUCKET_BITS * (F.col("level") + 1)
    cut = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(w AS INT))") * (F.col("prefix") + nearer.cast("long"))
    found = ends.withColumn("w", width).select("sid", cut.alias("cut"), (F.when(nearer, F.col("total")).otherwise(F.lit(0)) - F.col("rest")).alias("over"))
    return budgets.join(found, "sid", "left").select(
        "sid", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.col("rest") + F.col("over")).cast("long").alias("spent")
    )


def mix(
    docs: DataFrame,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    ceiling: int = CEILING,
) -> DataFrame:
    """``pack`` (the kept columns), ``source_id, size, source_size, target, taken`` for every row.

    ``taken`` is a whole multiple of the text's size, ``ceiling`` times at most, and the same in
    every run. Null and empty texts have size 0. Null is a source of its own, the last one; a
    null id hashes as empty. Rows alike in id and text share a hash, so they are taken the same
    number of times; where a budget ends among them it misses by up to half their joint size.
    An empty table gives an empty result; other columns of ``docs`` may bear any name.
    """
    body = field(text).cast("string")
    sized = store(
        docs.select(packed(docs, *keep).alias("pack"), field(source).cast("string").alias("source"), n_words(body).alias("size"), hashed(field(doc_id), body).alias("h")), "sized"
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = store(targets(sizes, weights, share, ceiling), "sources")
    mean = F.col("source_size") / F.col("n_docs")
    rank = F.lit(len(CLASSES))
    for i, least in reversed(list(enumerate(CLASSES))):
        rank = F.when(F.col("size") > least * mean, i).otherwise(rank)
    classed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("pack", "sid", "size", "h", rank.alias("class"), "source_size", "target")
    some = classed.where("size > 0").select("sid", "class", "h", "size")
    sums = store(some.groupBy("sid", "class", _bucket(0).alias("prefix")).agg(F.sum("size").alias("total"), F.count("*").alias("n")), "histogram")
    whole = sums.groupBy("sid", "class").agg(F.sum("total").alias("class_size"))
    missed, cuts = sources.select("sid", F.lit(0).cast("long").alias("missed")), None
    for i in range(len(CLASSES) + 1):
        held = whole.where(F.col("class") == i).join(sources, "sid").join(missed, "sid")
        share_of = F.floor(F.col("target") * F.col("class_size") / F.col("source_size") + 0.5)
        budget = F.least(F.greatest(share_of + F.col("missed"), F.lit(0)), ceiling * F.col("class_size"))
        held = held.select("sid", "class_size", budget.alias("budget"), (share_of + F.col("missed")).alias("wanted"))
        held = store(held.withColumn("copies", F.expr("budget div class_size")).withColumn("rest", F.expr("budget % class_size")), "budgets")
        found = thresholds(some, sums, held, i)
        cut = store(held.join(found, "sid").select("sid", F.lit(i).alias("class"), "copies", "cut", (F.col("wanted") - F.col("copies") * F.col("class_size") - F.col("spent")).alias("left")), "cuts")
        missed = missed.join(cut.select("sid", "left"), "sid", "left").select("sid", F.coalesce("left", "missed").alias("missed"))
        cuts = cut.drop("left") if cuts is None else cuts.union(cut.drop("left"))
    times = F.coalesce("copies", F.lit(0).cast("long")) + F.coalesce((F.col("h") < F.col("cut")).cast("long"), F.lit(0).cast("long"))
    return classed.join(cuts, ["sid", "class"], "left").select(
        "pack", F.col("sid").alias("source_id"), "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )
