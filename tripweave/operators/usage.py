"""Usage reports over an event table.

Distinct counts go through one row per search (or user and day), so a hot search
or user is pre-aggregated before the shuffle and nothing is expanded per measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params

STAGES = {
    "started": "search_started",
    "completed": "optimization_completed",
    "corrected": "interpretation_corrected",
    "no_result": "no_convenient_option",
    "selected": "recommendation_selected",
    "alternative": "alternative_selected",
    "navigated": "navigation_clicked",
}


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


#: Parts of the fact table.
PARTS = ("type", "search", "value", "reason", "user", "latency")


def facts(events: DataFrame, *parts: str) -> DataFrame:
    """All a usage report needs of the events: one scan, one shuffle of partly counted facts.

    Rows are (part, key, day, value, n, flags): events per type, flags of the stages a search
    reached, feedback values and reasons, days of a user, and completed searches per latency.
    ``parts`` leaves out what is not asked for, with its columns.
    """
    kind = F.col("event_type")
    flags = sum((F.when(kind == name, 1 << i).otherwise(0) for i, name in enumerate(STAGES.values())), F.lit(0))
    rank_one = F.when((kind == "recommendation_selected") & (F.col("recommendation_rank") == 1), 1 << len(STAGES)).otherwise(0)

    def fact(part: str, key=None, day=None, value=None, bits=None) -> Column:
        some = lambda c, t: (F.lit(None) if c is None else c).cast(t)
        return F.struct(
            F.lit(part).alias("part"), some(key, "string").alias("key"), some(day, "date").alias("day"), some(value, "double").alias("value"),
            (F.lit(0) if bits is None else bits).cast("int").alias("flags"),
        )

    given = kind == "feedback_submitted"
    named = lambda c: given & F.col(c).isNotNull() & (F.col(c) != "")
    made = {
        "type": lambda: fact("type", kind),
        "search": lambda: F.when(F.col("search_id").isNotNull() & kind.isin(list(STAGES.values())), fact("search", F.col("search_id"), bits=flags + rank_one)),
        "value": lambda: F.when(named("feedback_value"), fact("value", F.col("feedback_value"))),
        "reason": lambda: F.when(named("feedback_reason"), fact("reason", F.col("feedback_reason"))),
        "user": lambda: fact("user", F.col("user_id"), day=F.to_date("occurred_at")),
        "latency": lambda: F.when((kind == "optimization_completed") & F.col("latency_ms").isNotNull(), fact("latency", value=F.col("latency_ms"))),
    }
    rows = events.select(F.explode(F.array_compact(F.array(*[made[p]() for p in parts or PARTS]))).alias("f")).select("f.*")
    return rows.groupBy("part", "key", "day", "value").agg(F.count("*").alias("n"), F.bit_or("flags").alias("flags"))


def event_counts(seen: DataFrame) -> DataFrame:
    return seen.filter("part = 'type'").select(F.col("key").alias("event_type"), "n")


def search_totals(seen: DataFrame) -> DataFrame:
    """One row: searches per stage, by distinct id, and raw counts for the fallback."""
    reached = [F.coalesce(F.sum(F.getbit("flags", F.lit(i)).cast("bigint")), F.lit(0)).alias(name) for i, name in enumerate((*STAGES, "rank_one"))]
    raw = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("n"))), F.lit(0))
    return one_row(
        seen.filter("part = 'search'").agg(*reached),
        event_counts(seen).agg(raw("search_started").alias("raw_started"), raw("optimization_completed").alias("raw_completed")),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables side by side."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def _denominators() -> tuple[Column, Column]:
    searches = F.coalesce(F.nullif(F.col("started"), F.lit(0)), F.col("raw_started"))
    completions = F.coalesce(F.nullif(F.col("completed"), F.lit(0)), F.col("raw_completed"))
    return searches, completions


def _search_measures() -> list[Column]:
    searches, completions = _denominators()
    return [
        searches.cast("bigint").alias("searches"),
        rate(completions, searches).alias("completion_rate"),
        rate(F.col("corrected"), searches).alias("parse_correction_rate"),
        rate(F.col("no_result"), searches).alias("no_result_rate"),
    ]


def _selection_measures() -> list[Column]:
    _, completions = _denominators()
    return [
        rate(F.col("rank_one"), completions).alias("rank_one_acceptance_rate"),
        rate(F.col("alternative"), F.col("selected")).alias("alternative_selection_rate"),
        rate(F.col("navigated"), completions).alias("navigation_click_rate"),
    ]


def search_rates(seen: DataFrame) -> DataFrame:
    return search_totals(seen).select(*_search_measures())


def selection_rates(seen: DataFrame) -> DataFrame:
    return search_totals(seen).select(*_selection_measures())


def feedback(seen: DataFrame) -> DataFrame:
    """Counts of feedback values and reasons."""
    return seen.filter("part IN ('value', 'reason')").select(F.col("part").alias("kind"), F.col("key").alias("name"), "n")


#: Buckets of a latency to the power of two, and parts of a bucket that holds a wanted rank.
OCTAVE, FINE = 64, 65536


def latency_percentiles(seen: DataFrame) -> DataFrame:
    """Median and p95 of completed-search latency under the four rank rules, exactly.

    Equal latencies are counted together. Buckets of one per cent, some 270,000 at most
    whatever the latencies, tell where a rank lies; that bucket is cut into 65,536 equal
    parts, and only the part that holds the rank is ordered.
    """
    size = F.floor(F.log2(F.abs("v")) * OCTAVE) + 1100 * OCTAVE
    bucket = F.when(F.isnan("v"), 1 << 20).when(F.col("v") == 0, 0).when(F.col("v") > 0, size).otherwise(-size).cast("bigint")
    values = seen.filter("part = 'latency'").select(F.col("value").alias("v"), "n").withColumn("bucket", bucket)
    buckets = values.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    placed = buckets.select(
        "bucket", "low", "high", "n", (F.expr("sum(n) OVER (ORDER BY bucket)") - F.col("n")).alias("before"), F.expr("sum(n) OVER ()").alias("total")
    )
    span = F.col("total") - 1
    rules = []
    for q in (0.5, 0.95):
        low = F.floor(span * q)
        share = span * q - low
        for rule, at, weight in (
            ("nearest_rank", F.floor(span * q + 0.999999), F.lit(1.0)), ("linear", low, 1.0 - share), ("linear", low + 1, share.cast("double")),
            ("scaled_count", F.floor(F.col("total") * q), F.lit(1.0)), ("scaled_span", low, F.lit(1.0)),
        ):
            rules.append(F.struct(F.lit(rule).alias("rule"), F.lit(q).alias("quantile"), F.least(span, at).alias("at"), weight.alias("weight")))

    def holding(rows: DataFrame) -> DataFrame:
        return rows.filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))

    wanted = holding(placed.select("bucket", "low", "high", "before", "n", F.explode(F.array(*rules)).alias("w")).select("*", "w.*").drop("w"))
    ranks = wanted.select("bucket", "rule", "quantile", "weight", (F.col("at") - F.col("before")).alias("at"))
    part = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * FINE)).otherwise(0)
    inside = values.join(wanted.select("bucket", "low", "high").distinct(), "bucket").select("bucket", "v", "n", part.alias("part"))
    parts = inside.groupBy("bucket", "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY bucket ORDER BY part)") - F.col("n"))
    ranks = holding(ranks.join(parts, "bucket")).select("bucket", "part", "rule", "quantile", "weight", (F.col("at") - F.col("before")).alias("at"))
    last = inside.join(ranks.select("bucket", "part").distinct(), ["bucket", "part"])
    last = last.withColumn("before", F.expr("sum(n) OVER (PARTITION BY bucket, part ORDER BY v)") - F.col("n"))
    hit = holding(ranks.join(last, ["bucket", "part"]))
    return hit.groupBy("rule", "quantile").agg(F.round(F.sum(F.col("v") * F.col("weight")), 2).alias("latency_ms"))


def per_user(seen: DataFrame) -> DataFrame:
    """One row per user: on how many days they came, and the last of them."""
    return seen.filter("part = 'user'").groupBy("key").agg(F.count("*").alias("days"), F.max("day").alias("last_day"))


def active_users(seen: DataFrame) -> DataFrame:
    """Users seen on the last day of the table, and in the seven days ending on it.

    Users are first counted per last day, so the last day of all meets one row a day.
    """
    days = per_user(seen).groupBy("last_day").agg(F.count("*").alias("n"))
    today = F.expr("max(last_day) OVER ()")
    return days.withColumn("today", today).agg(
        F.max("today").cast("string").alias("today"),
        F.coalesce(F.sum(F.when(F.col("last_day") == F.col("today"), F.col("n"))), F.lit(0)).alias("active_users_one_day"),
        F.coalesce(F.sum(F.when(F.col("last_day") >= F.date_sub("today", 6), F.col("n"))), F.lit(0)).alias("active_users_seven_day"),
    )


def returning_users(seen: DataFrame) -> DataFrame:
    return per_user(seen).agg(
        F.count("*").alias("unique_users"),
        F.count_if(F.col("days") >= 2).alias("returning_users"),
        rate(F.count_if(F.col("days") >= 2), F.count("*")).alias("return_usage_rate"),
    )


def usage_report(seen: DataFrame) -> DataFrame:
    """The whole report in one row, from stored facts: the events themselves are read once."""
    spread = feedback(seen).agg(
        F.coalesce(F.sum(F.when((F.col("kind") == "value") & (F.col("name") == "positive"), F.col("n"))), F.lit(0)).alias("positive_feedback"),
        F.coalesce(F.sum(F.when((F.col("kind") == "value") & (F.col("name") == "negative"), F.col("n"))), F.lit(0)).alias("negative_feedback"),
        F.concat_ws(
            ";",
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == "reason", F.struct((-F.col("n")).alias("n"), "name")))),
                lambda r: F.concat(r["name"], F.lit("="), (-r["n"]).cast("string")),
            ),
        ).alias("feedback_reasons"),
    )
    latency = latency_percentiles(seen).agg(
        F.max(F.when((F.col("rule") == "linear") & (F.col("quantile") == 0.5), F.col("latency_ms"))).alias("median_latency_ms"),
        F.max(F.when((F.col("rule") == "nearest_rank") & (F.col("quantile") == 0.95), F.col("latency_ms"))).alias("p95_latency_ms"),
    )
    counts = event_counts(seen).agg(
        F.concat_ws(";", F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string"))))).alias("event_counts"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "return_usage", F.col("n"))), F.lit(0)).alias("explicit_return_events"),
    )
    rows = one_row(search_totals(seen), spread, latency, active_users(seen), returning_users(seen), counts)
    return rows.select(
        "today", F.col("unique_users").alias("unique_anonymous_users"), *_search_measures(),
        rate(_denominators()[0], F.col("unique_users"), 3).alias("searches_per_user"),
        *_selection_measures(), "positive_feedback", "negative_feedback", "feedback_reasons", "median_latency_ms",
        "p95_latency_ms", "active_users_one_day", "active_users_seven_day", "returning_users", "return_usage_rate",
        "explicit_return_events", "event_counts",
    )


def split_by_contract(events: DataFrame) -> DataFrame:
    """Every event with the reason it is refused, or null when it is accepted."""
    return events.withColumn(
        "reject_reason",
        F.when(F.col("event_id").isNull() | F.col("user_id").isNull(), "missing id")
        .when(~F.col("event_type").isin(list(params.EVENT_TYPES)) | F.col("event_type").isNull(), "event type")
        .when(~F.col("recommendation_rank").between(1, 3), "rank")
        .when(~F.col("feedback_value").isin(list(params.FEEDBACK_VALUES)), "feedback value")
        .when(~F.col("feedback_reason").isin(list(params.FEEDBACK_REASONS)), "feedback reason")
        .when(~F.col("latency_ms").between(0, 300000), "latency"),
    )
