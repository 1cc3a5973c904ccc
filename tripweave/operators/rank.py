"""From scored visit orders to winners, further options, considered stops and outcome.

All of it works per trip on at most a few dozen rows, and all windows share one
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params

def trip():
    return Window.partitionBy("trip_id")

TIES = ("search_no", "position", "order_no")
OBJECTIVES = {
    "best_overall": ("score", "added_minutes", "added_walk_minutes"),
    "fastest": ("added_minutes", "score", "added_walk_minutes"),
    "least_walking": ("added_walk_minutes", "added_minutes", "score"),
}


def winner_pool(scored: DataFrame) -> DataFrame:
    """Full options meeting hard limits, else all full options, else fallbacks."""
    full = F.col("match_class") == "best_match"
    tier = F.when(full & F.col("hard_met"), 0).when(full, 1).otherwise(2)
    return scored.withColumn("tier", tier).withColumn("best_tier", F.min("tier").over(trip())).filter("tier = best_tier").drop("tier", "best_tier")


OUTCOME_FIELDS = (
    "sid", "search_no", "position", "order_no", "first_stop", "second_stop", "label", "match_class", "score", "added_minutes",
    "added_walk_minutes", "added_walk_m", "added_transfers", "dwell_minutes", "total_minutes", "consolidated", "hard_met",
)


def objectives(pool: DataFrame) -> DataFrame:
    """The three winners of each trip, one aggregate: (trip_id, best_overall, fastest, least_walking)."""
    row = F.struct(*OUTCOME_FIELDS)
    return pool.groupBy("trip_id").agg(
        *[F.min_by(row, F.struct(*keys, *TIES)).alias(name) for name, keys in OBJECTIVES.items()]
    )


def same_signature(a: Column, b: Column) -> Column:
    return (
        (a["first_stop"] == b["first_stop"]) & a["second_stop"].eqNullSafe(b["second_stop"])
        & (F.round(a["added_minutes"]) == F.round(b["added_minutes"]))
        & (F.round(a["added_walk_m"] / 50) == F.round(b["added_walk_m"] / 50))
        & (a["added_transfers"] == b["added_transfers"])
    )


def indistinguishable(a: Column, b: Column) -> Column:
    return (
        (a["added_transfers"] == b["added_transfers"])
        & (F.abs(a["added_minutes"] - b["added_minutes"]) < params.SAME_MINUTES)
        & (F.abs(a["added_walk_m"] - b["added_walk_m"]) < params.SAME_METRES)
    )


def distinct_winners(winners: DataFrame) -> DataFrame:
    """Winners that repeat, or cannot be told from, a kept one are dropped; slots count the kept. Long form."""
    best, fast, calm = F.col("best_overall"), F.col("fastest"), F.col("least_walking")
    drop_fast = same_signature(fast, best) | indistinguishable(fast, best)
    drop_calm = same_signature(calm, best) | indistinguishable(calm, best) | (
        ~drop_fast & (same_signature(calm, fast) | indistinguishable(calm, fast))
    )
    kept = F.array_compact(
        F.array(
            F.struct(F.lit("best_overall").alias("result"), best.alias("o")),
            F.when(~drop_fast, F.struct(F.lit("fastest").alias("result"), fast.alias("o"))),
            F.when(~drop_calm, F.struct(F.lit("least_walking").alias("result"), calm.alias("o"))),
        )
    )
    listed = winners.select("trip_id", F.posexplode(kept).alias("place", "k"))
    return listed.select("trip_id", "k.result", (F.col("place") + 1).alias("slot"), "k.o.*")


def stop_key(first: str = "first_stop", second: str = "second_stop") -> Column:
    return F.concat_ws(">", F.col(first).cast("string"), F.col(second).cast("string"))


def stop_set() -> Column:
    second = F.coalesce("second_stop", F.col("first_stop"))
    return F.concat_ws("+", F.least(F.col("first_stop"), second).cast("string"), F.when(F.col("second_stop").isNotNull(), F.greatest(F.col("first_stop"), second)).cast("string"))


def fill(winners: DataFrame, scored: DataFrame, categories: DataFrame) -> DataFrame:
    """Fallback options in score order under their own keys, until five results are held.

    Whether an option is shown depends on the ones before it, so each trip's handful of
    fallback rows (one option per fallback search) is folded in order.
    """
    slugs = categories.select(F.col("category_idx").alias("c1"), "slug")
    rows = scored.filter("match_class <> 'best_match'").join(slugs, "c1").withColumn(
        "result",
        F.when(F.col("label") == "easier_alternative", F.lit("easier_alternative")).otherwise(F.concat(F.lit("partial_"), "slug")),
    )
    item = F.struct("score", "added_minutes", *TIES, "result", stop_key().alias("shown"))
    listed = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    held = winners.groupBy("trip_id").agg(F.collect_set(stop_key()).alias("held"), F.count("*").alias("n"))
    listed = listed.join(held, "trip_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    pick_type = "array<struct<search_no:int,position:int,order_no:int,slot:int>>"
    start = F.struct(
        F.coalesce("held", empty).alias("shown"), empty.alias("keys"), F.coalesce(F.col("n").cast("int"), F.lit(0)).alias("n"),
        F.expr(f"cast(array() as {pick_type})").alias("picks"),
    )

    def step(state: Column, row: Column) -> Column:
        takes = (
            (state["n"] < params.MAX_RECOMMENDED) & ~F.array_contains(state["shown"], row["shown"])
            & ~F.array_contains(state["keys"], row["result"])
        )
        pick = F.struct(
            row["search_no"].cast("int").alias("search_no"), row["position"].cast("int").alias("position"),
            row["order_no"].cast("int").alias("order_no"), (state["n"] + 1).alias("slot"),
        )
        return F.struct(
            F.when(takes, F.concat(state["shown"], F.array(row["shown"]))).otherwise(state["shown"]).alias("shown"),
            F.when(takes, F.concat(state["keys"], F.array(row["result"]))).otherwise(state["keys"]).alias("keys"),
            F.when(takes, state["n"] + 1).otherwise(state["n"]).alias("n"),
            F.when(takes, F.concat(state["picks"], F.array(pick))).otherwise(state["picks"]).alias("picks"),
        )

    picks = listed.select("trip_id", F.explode(F.aggregate("items", start, step)["picks"]).alias("p")).select("trip_id", "p.*")
    return rows.join(picks, ["trip_id", *TIES]).select("trip_id", "result", "slot", *OUTCOME_FIELDS)


def considered(scored: DataFrame, recommended: DataFrame) -> DataFrame:
    """Best order of each compared stop set that was not recommended, first six."""
    offered = recommended.select("trip_id", stop_set().alias("stops")).distinct()
    order = ["score", "added_minutes", *TIES]
    rows = scored.withColumn("stops", stop_set()).join(offered, ["trip_id", "stops"], "left_anti")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("trip_id", "stops").orderBy(*order))).filter("rn = 1")
    place = F.row_number().over(trip().orderBy(*order))
    return rows.drop("rn").withColumn("place", place).filter(F.col("place") <= params.MAX_CONSIDERED)


def outcomes(trips: DataFrame, scored: DataFrame) -> DataFrame:
    """One outcome per trip, trips without any priced option included."""
    full = F.col("match_class") == "best_match"
    accepted = full & F.col("hard_met")
    facts = scored.groupBy("trip_id").agg(
        F.bool_or(accepted).alias("any_accepted"), F.bool_or(full).alias("any_full"),
        F.bool_and(F.when(accepted, F.col("label") == "best_available")).alias("all_far"), F.count("*").alias("evaluated"),
    )
    rows = trips.select("trip_id").join(facts, "trip_id", "left")
    label = (
        F.when(F.col("any_accepted") & F.col("all_far"), "best_available")
        .when(F.col("any_accepted"), "ok")
        .when(F.col("any_full"), "closest_option")
        .when(F.col("evaluated") > 0, "partial_or_substitute")
        .otherwise("no_practical_match")
    )
    return rows.select("trip_id", label.alias("outcome"))


RANK_METRICS = {
    "recommended": "score",
    "time": "travel_delta",
    "walking": "added_walk_m",
    "transfers": "transfer_metric",
}


def rerank(recommended: DataFrame) -> DataFrame:
    """Positions of the options under each of the four measures, partial ones last."""
    rows = recommended.withColumn("travel_delta", F.greatest(F.lit(0.0), F.col("added_minutes") - F.col("dwell_minutes")))
    rows = rows.withColumn("transfer_metric", F.col("added_transfers") * 1000 + F.col("travel_delta"))
    partial = F.when(F.col("label") == "partial_option", 1).otherwise(0)
    return rows.select(
        "trip_id", "result",
        *[
            F.row_number().over(trip().orderBy(partial, metric, "slot")).alias(f"by_{name}")
            for name, metric in RANK_METRICS.items()
        ],
    )


def tradeoffs(recommended: DataFrame) -> DataFrame:
    """Each option against the chosen one, and the spread of extra travel over the trip."""
    travel = F.greatest(F.lit(0.0), F.col("added_minutes") - F.col("dwell_minutes"))
    rows = recommended.withColumn("travel_delta", F.round(travel, 2))
    lead = trip().orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    minutes = F.col("travel_delta") - F.first("travel_delta").over(lead)
    metres = F.col("added_walk_m") - F.first("added_walk_m").over(lead)
    changes = F.col("added_transfers") - F.first("added_transfers").over(lead)
    silent = (F.col("label") == "partial_option") | (F.col("slot") == 1)
    return rows.select(
        "trip_id", "result",
        F.when(~silent & (F.abs(minutes) >= 0.5), F.round(minutes, 2)).alias("travel_minutes"),
        F.when(~silent & (F.abs(metres) >= 50), F.round(metres, 1)).alias("walk_metres"),
        F.when(~silent & (changes != 0), changes).alias("transfers"),
        F.greatest(F.lit(0.0), F.round(F.max("travel_delta").over(trip()) - F.first("travel_delta").over(lead), 2)).alias("spread_minutes"),
    )
