"""Route prices from a table of (from, to, departure bucket), found as of a departure.

A table row holds from a bucket of departure on until the next row of its pair. The price of a
departure is therefore the row of its directed pair with the latest bucket that is not later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store

PAIR = ("from_place", "to_place")
PRICE = ("minutes", "walk_minutes", "walk_m", "transfers")
ORDER = ("sid", "stop1", "s2", "order_no")


def bucket(departure: Column, width: int) -> Column:
    """Number of the departure bucket of ``width`` minutes; null for a null departure."""
    return F.floor(F.unix_timestamp(departure) / (60 * width)).cast("bigint")


def as_of(asked: DataFrame, table: DataFrame, width: int = 1) -> DataFrame:
    """Each distinct (from_place, to_place, bucket) of ``asked`` with the table's price as of that bucket.

    Keys without a price, or with a null in them, are not returned; of table rows with equal keys the
    cheapest counts, and rows without minutes do not count. Both sides are made distinct before they are
    dealt, and by day within a pair, so a pair that everyone asks for is spread over its
    days; what one day hands to the next is a single row.
    """
    days = F.floor(F.col("bucket") / max(1, 1440 // width)).cast("bigint")
    known = table.filter("minutes IS NOT NULL AND bucket IS NOT NULL").groupBy(*PAIR, "bucket").agg(F.min(F.struct(*PRICE)).alias("price"))
    keys = asked.select(*PAIR, "bucket").na.drop().distinct()
    rows = known.withColumn("is_asked", F.lit(False)).unionByName(keys.withColumn("is_asked", F.lit(True)), allowMissingColumns=True).withColumn("day", days)
    so_far = Window.partitionBy(*PAIR, "day").orderBy("bucket", "is_asked").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*PAIR).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    left_over = rows.groupBy(*PAIR, "day").agg(F.max_by("price", F.when(~F.col("is_asked"), F.col("bucket"))).alias("last_price"))
    left_over = left_over.select(*PAIR, "day", F.last("last_price", ignorenulls=True).over(earlier).alias("carried")).filter("carried IS NOT NULL")
    within = rows.withColumn("near", F.last("price", ignorenulls=True).over(so_far)).filter("is_asked")
    found = within.join(left_over, [*PAIR, "day"], "left").withColumn("price", F.coalesce("near", "carried"))
    return found.filter("price IS NOT NULL").select(*PAIR, "bucket", "price.*")


def along_the_clock(legs: DataFrame, starts: DataFrame, table: DataFrame, width: int = 1) -> DataFrame:
    """Legs of visit orders with the table's prices at the moments they are ridden.

    ``legs`` has a row per order and ``segment`` with a price, which stays where the table has none;
    ``starts`` has the departure of each order and its dwell minutes ``dwell_a``, ``dwell_b``. A leg leaves
    when the one before has arrived and the stop between is done, so legs are priced one place in
    the order after the other: three lookups, whatever the number of orders. Behind a leg without any
    price nothing is known: later legs have no departure and no price.
    """
    clock = starts.select(*ORDER, F.col("departure").alias("leaves"), "dwell_a", "dwell_b")
    dwell = {0: F.col("dwell_a"), 1: F.coalesce("dwell_b", F.lit(0.0)), 2: F.lit(0.0)}
    done = None
    for number in (0, 1, 2):
        here = legs.filter(F.col("segment") == number).join(clock, list(ORDER)).withColumn("bucket", bucket(F.col("leaves"), width))
        found = as_of(here, table, width).select(*PAIR, "bucket", F.struct(*PRICE).alias("as_of"))
        rows = here.join(found, [*PAIR, "bucket"], "left")
        timed = F.col("leaves").isNotNull()
        rows = rows.withColumns({c: F.when(timed, F.coalesce(F.col(f"as_of.{c}"), F.col(c))) for c in PRICE}).withColumn("from_table", F.col("as_of").isNotNull())
        rows = store(rows.drop("as_of"), f"legs-{number}")
        spent = F.round((F.col("minutes") + dwell[number]) * 60).cast("bigint")
        clock = rows.select(*ORDER, F.timestamp_seconds(F.unix_timestamp("leaves") + spent).alias("leaves"), "dwell_a", "dwell_b")
        done = rows if done is None else done.unionByName(rows)
    return done.drop("dwell_a", "dwell_b")
