"""Visit orders, their price against the direct trip, limits, class and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import geo


def visit_orders(options: DataFrame) -> DataFrame:
    """Both orders of a pair, one of a single stop, with places and dwell per stop."""
    low_first = F.struct(
        F.lit(0).alias("order_no"), F.col("stop1").alias("first_stop"), F.col("stop2").alias("second_stop"),
        F.col("lat1").alias("a_lat"), F.col("lon1").alias("a_lon"), F.col("lat2").alias("b_lat"), F.col("lon2").alias("b_lon"),
        F.col("dwell1").alias("dwell_a"), F.col("dwell2").alias("dwell_b"),
    )
    high_first = F.struct(
        F.lit(1).alias("order_no"), F.col("stop2").alias("first_stop"), F.col("stop1").alias("second_stop"),
        F.col("lat2").alias("a_lat"), F.col("lon2").alias("a_lon"), F.col("lat1").alias("b_lat"), F.col("lon1").alias("b_lon"),
        F.col("dwell2").alias("dwell_a"), F.col("dwell1").alias("dwell_b"),
    )
    orders = F.array_compact(F.array(low_first, F.when(F.col("n_stops") == 2, high_first)))
    return options.withColumn("v", F.explode(orders)).select(*options.columns, "v.*").drop("dwell1", "dwell2")


def with_dwell(options: DataFrame, categories: DataFrame) -> DataFrame:
    """Dwell minutes of the categories served at each stop."""
    one = categories.select(F.col("category_idx").alias("c1"), F.col("dwell_minutes").alias("d1"))
    two = categories.select(F.col("category_idx").alias("c2"), F.col("dwell_minutes").alias("d2"))
    rows = options.join(one, "c1", "left").join(two, "c2", "left")
    second = F.coalesce("d2", F.lit(0.0))
    both = F.col("d1") + second
    return rows.withColumn(
        "dwell1", F.when(F.col("n_stops") == 1, both).when(F.col("first_low"), F.col("d1")).otherwise(second)
    ).withColumn("dwell2", F.when(F.col("n_stops") == 2, F.when(F.col("first_low"), second).otherwise(F.col("d1")))).drop("d1", "d2")


def segments(orders: DataFrame) -> DataFrame:
    """One row per routed segment of a visit order, keyed by its directed place pair."""
    def part(index, a_lat, a_lon, b_lat, b_lon):
        return F.struct(
            F.lit(index).alias("segment"), geo.place_key(a_lat, a_lon).alias("from_place"), geo.place_key(b_lat, b_lon).alias("to_place")
        )

    two = F.col("n_stops") == 2
    parts = F.array_compact(
        F.array(
            part(0, "o_lat", "o_lon", "a_lat", "a_lon"),
            F.when(two, part(1, "a_lat", "a_lon", "b_lat", "b_lon")),
            F.when(two, part(2, "b_lat", "b_lon", "d_lat", "d_lon")).otherwise(part(1, "a_lat", "a_lon", "d_lat", "d_lon")),
        )
    )
    return orders.select("sid", "stop1", F.coalesce("stop2", F.lit(-1)).alias("s2"), "order_no", F.explode(parts).alias("p")).select(
        "sid", "stop1", "s2", "order_no", "p.*"
    )


def combine(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each visit order over its priced segments, dwell not yet included."""
    return priced.groupBy(*keys).agg(
        F.count("minutes").alias("n_priced"), F.count("*").alias("n_segments"),
        F.round(F.sum("minutes"), 2).alias("travel_minutes"), F.round(F.sum("walk_minutes"), 2).alias("walk_minutes"),
        F.round(F.sum("walk_m"), 1).alias("walk_m"), F.sum("transfers").alias("transfers"),
        F.min_by("minutes", "segment").alias("first_minutes"),
        F.max(F.when(F.col("segment") == 1, F.col("minutes"))).alias("second_minutes"),
    )


def violations(kind: str) -> Column:
    """Limits a visit order breaks, soft or hard."""
    def over(name: str, value: str, limit: str, hard: str) -> Column:
        applies = F.col(hard) if kind == "hard" else ~F.col(hard)
        return F.when((F.col(value) > F.col(limit)) & applies, name)

    parts = [
        over("added time", "added_minutes", "max_detour_minutes", "max_detour_is_hard"),
        over("walking", "added_walk_minutes", "max_walk_minutes", "max_walk_is_hard"),
        over("transfers", "added_transfers", "max_transfers", "max_transfers_is_hard"),
    ]
    if kind == "hard":
        parts.append(F.when(F.col("arrival") > F.col("arrive_by"), "arrival time"))
    return F.array_compact(F.array(*parts))


def score(orders: DataFrame) -> DataFrame:
    """Deltas, violations, class and score of priced visit orders.

    ``orders`` carry totals, the direct trip (base_*), dwell, the preferences of the
    trip and ``preferred_met``. The base score is rounded before the bonuses come off.
    """
    rows = orders.withColumn("dwell_minutes", F.col("dwell_a") + F.coalesce("dwell_b", F.lit(0.0)))
    rows = rows.withColumn("total_minutes", F.round(F.col("travel_minutes") + F.col("dwell_minutes"), 2))
    zero = F.lit(0.0)
    rows = (
        rows.withColumn("added_minutes", F.round(F.greatest(zero, F.col("total_minutes") - F.col("base_minutes")), 2))
        .withColumn("added_walk_minutes", F.round(F.greatest(zero, F.col("walk_minutes") - F.col("base_walk_minutes")), 2))
        .withColumn("added_walk_m", F.round(F.greatest(zero, F.col("walk_m") - F.col("base_walk_m")), 1))
        .withColumn("added_transfers", F.greatest(F.lit(0), F.col("transfers") - F.col("base_transfers")).cast("bigint"))
        .withColumn("arrival", F.col("departure") + F.make_dt_interval(mins=F.lit(0), secs=F.round(F.col("total_minutes") * 60, 6)))
    )
    rows = rows.withColumn("hard", violations("hard")).withColumn("soft", violations("soft"))
    has_preferred = F.col("has_preferred")
    met = F.col("preferred_met")
    label = (
        F.when(F.col("match_class") != "best_match", F.col("match_class"))
        .when(F.size("hard") > 0, "exceeds_limit")
        .when(F.size("soft") > 0, "closest_exact")
        .when(F.col("added_minutes") > params.REASONABLE_DETOUR_MIN, "best_available")
        .when(has_preferred & met, "exact_match")
        .when(has_preferred, "easier_alternative")
        .otherwise("best_match")
    )
    base = F.round(
        F.col("added_minutes") * params.WEIGHT_DETOUR * F.col("detour_factor")
        + F.col("added_walk_minutes") * params.WEIGHT_WALKING * F.col("walking_factor")
        + F.col("added_transfers") * params.WEIGHT_TRANSFER * F.col("transfer_factor")
        - F.col("quality") * params.BONUS_QUALITY
        + 1e-7,  # exact halves of the fourth decimal always round up
        3,
    )
    bonus = F.when(has_preferred & met, params.BONUS_BRAND).otherwise(0.0) + F.when(
        F.col("prefer_consolidated") & F.col("consolidated"), params.BONUS_CONSOLIDATED
    ).otherwise(0.0)
    too_far = (F.size("hard") > 0) | (F.size("soft") > 0) | (F.col("added_minutes") > params.REASONABLE_DETOUR_MIN)
    return (
        rows.withColumn("label", label)
        .withColumn("score", F.greatest(zero, F.round(base - bonus, 6)))
        .withColumn("hard_met", F.size("hard") == 0)
        .withColumn("excessive", too_far)
    )


def factors(trips: DataFrame, spark) -> DataFrame:
    """Weight multipliers of each trip's tolerances."""
    walking = params.small_table(spark, params.WALKING_MULTIPLIER, "walking_tolerance, walking_factor")
    transfer = params.small_table(spark, params.TRANSFER_MULTIPLIER, "transfer_tolerance, transfer_factor")
    urgency = params.small_table(spark, params.URGENCY_MULTIPLIER, "urgency, detour_factor")
    return trips.join(walking, "walking_tolerance").join(transfer, "transfer_tolerance").join(urgency, "urgency")


def preferred_met(options: DataFrame, trips: DataFrame, brands: DataFrame) -> DataFrame:
    """Options with whether every preferred (category, brand) of the trip is met.

    A preference counts only for categories the option serves; without any that apply
    the preference counts as met.
    """
    wants = trips.select("trip_id", F.col("preferred_category").alias("p_cat"), F.col("preferred_brand").alias("p_brand"))
    rows = options.join(wants, "trip_id", "left")
    rows = rows.withColumn("applies", F.coalesce((F.col("p_cat") == F.col("c1")) | (F.col("p_cat") == F.col("c2")), F.lit(False)))
    at_first = F.col("first_low") == (F.col("p_cat") == F.col("c1"))
    stop = F.when(F.col("n_stops") == 1, F.col("stop1")).when(at_first, F.col("stop1")).otherwise(F.col("stop2"))
    rows = rows.withColumn("p_stop", F.when(F.col("applies"), stop))
    offer = brands.select(F.col("hub_id").alias("p_stop"), F.col("category").alias("p_cat"), F.col("brand").alias("p_brand"), F.lit(True).alias("offered"))
    rows = rows.join(offer, ["p_stop", "p_cat", "p_brand"], "left")
    return rows.withColumn("has_preferred", F.col("p_brand").isNotNull()).withColumn(
        "preferred_met", ~F.col("applies") | F.coalesce("offered", F.lit(False))
    ).drop("p_stop", "p_cat", "p_brand", "applies", "offered")


def option_quality(options: DataFrame, quality: DataFrame) -> DataFrame:
    one = quality.select(F.col("hub_id").alias("stop1"), F.col("quality").alias("q1"))
    two = quality.select(F.col("hub_id").alias("stop2"), F.col("quality").alias("q2"))
    rows = options.join(one, "stop1", "left").join(two, "stop2", "left")
    mean = F.when(F.col("n_stops") == 2, (F.col("q1") + F.col("q2")) / 2).otherwise(F.col("q1"))
    return rows.withColumn("quality", F.round(mean, 3)).drop("q1", "q2")
