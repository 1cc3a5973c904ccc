"""Structured Streaming forms of the event, arrival and catalog work.

Every function takes a streaming DataFrame and returns one, or writes through
``foreachBatch``. Raw times without a zone are cast to timestamps, since a watermark
needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import params
from ..functions import clock
from ..operators import usage
from ..operators.timetable import CLOCK_FIELDS
from ..session import store


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def timed(events: DataFrame, column: str = "occurred_at", late: str = "1 day") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def ingest(events: DataFrame) -> DataFrame:
    """Contract filter and once-only by event id within the watermark."""
    accepted = usage.split_by_contract(timed(events)).filter("reject_reason IS NULL").drop("reject_reason")
    return accepted.dropDuplicatesWithinWatermark(["event_id"])


def event_counts(events: DataFrame) -> DataFrame:
    """Counts per type and tumbling day; final once the watermark has passed the day."""
    return timed(events).groupBy(F.window("occurred_at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("day"), "event_type", "n"
    )


def active_users(events: DataFrame) -> DataFrame:
    """Distinct users over seven days, sliding by one; a sketch, as exact sets would grow without bound."""
    return timed(events).groupBy(F.window("occurred_at", "7 days", "1 day")).agg(
        F.approx_count_distinct("user_id", 0.02).alias("users")
    ).select(F.col("window.end").alias("until"), "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Length and event count of each user's sessions."""
    return timed(events).groupBy(F.session_window("occurred_at", gap), "user_id").agg(F.count("*").alias("events")).select(
        "user_id", F.col("session_window.start").alias("started"), "events",
        (F.col("session_window.end").cast("double") - F.col("session_window.start").cast("double")).alias("seconds"),
    )


def once(events: DataFrame, column: str = "occurred_at", late: str = "1 hour") -> DataFrame:
    """Each event once: a repeat that comes within the watermark delay is dropped inside the stream."""
    return timed(events, column, late).dropDuplicatesWithinWatermark(["event_id"])


def search_outcome(events: DataFrame, other: DataFrame, seconds: int = params.SEARCH_TIMEOUT_S) -> DataFrame:
    """One row per started search: completed inside the limit, else timed out.

    ``other`` is the same source read again: a stream joins a stream with a watermark on
    each side and a time range, so state is dropped as soon as no match can come. A search with
    several completions meets each of them; they collapse in the stream, as soon as the
    watermark has passed the start. Both sides drop repeats before they pick their events: a
    filter would otherwise move below the watermark, which must follow events of every kind.
    """
    started = once(events).filter("event_type = 'search_started' AND search_id IS NOT NULL").select("event_id", "search_id", F.col("occurred_at").alias("started_at"))
    done = once(other.withColumnRenamed("occurred_at", "completed_at"), "completed_at").filter("event_type = 'optimization_completed'").select(
        F.col("search_id").alias("done_id"), "completed_at"
    )
    inside = F.expr(f"search_id = done_id AND completed_at BETWEEN started_at AND started_at + INTERVAL {seconds} SECONDS")
    met = started.join(done, inside, "left_outer")
    return met.groupBy("started_at", "event_id", "search_id").agg(F.count("done_id").alias("n")).select(
        "event_id", "search_id", F.when(F.col("n") > 0, "completed").otherwise("timed_out").alias("outcome")
    )


STAGE_RANK = (
    ("search_started", 1), ("optimization_completed", 2), ("no_convenient_option", 2), ("recommendation_selected", 3), ("alternative_selected", 3),
    ("navigation_clicked", 4), ("feedback_submitted", 5),
)


def search_funnel(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Furthest stage each search reached before it was quiet for the time to live.

    A session window per search keeps one small row per open search; it leaves the stream once,
    when the watermark has passed its end. A search that comes back later is a new row.
    """
    rank = F.lit(0)
    for kind, value in STAGE_RANK:
        rank = F.when(F.col("event_type") == kind, value).otherwise(rank)
    rows = once(events).filter("search_id IS NOT NULL").withColumn("stage", rank)
    return rows.groupBy(F.session_window("occurred_at", ttl), "search_id").agg(F.max("stage").alias("stage"), F.count("*").alias("events")).select(
        "search_id", F.col("session_window.start").alias("started"), "stage", "events"
    )


ARRIVAL_KEY = ("stop_code", "service_no", "slot")


def latest_arrivals(arrivals: DataFrame) -> DataFrame:
    """Newest estimate per (stop, service, slot), in update mode; the keys are bounded by the timetable.

    The estimate may be served until ``fresh_until``. Staleness follows event time, so a replay
    ends like the live run.
    """
    newest = F.max_by(F.struct("observed_at", "eta_seconds"), F.struct("observed_at", "event_id"))
    rows = arrivals.withColumn("observed_at", F.col("observed_at").cast("timestamp")).filter("observed_at IS NOT NULL")
    return rows.groupBy(*ARRIVAL_KEY).agg(newest.alias("x")).select(
        *ARRIVAL_KEY, "x.observed_at", "x.eta_seconds", (F.col("x.observed_at") + F.make_dt_interval(secs=F.lit(params.ARRIVAL_FRESH_S))).alias("fresh_until")
    )


def replace_keys(table: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ARRIVAL_KEY) -> DataFrame:
    """A batch of updated rows put in the place of the rows with their keys; null keys match each other."""
    same = [table[k].eqNullSafe(batch[k]) for k in keys]
    return table.join(batch, same, "left_anti").unionByName(batch)


def arrival_operation(arrivals: DataFrame, routes: DataFrame) -> DataFrame:
    """Arrivals against the static timetable: one row per direction, state kept three-valued."""
    table = routes.select("stop_code", "service_no", "direction", *CLOCK_FIELDS.values())
    rows = arrivals.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withColumn("weekday", clock.monday_zero("observed_at")).withColumn(
        "minute", clock.minute_of_day("observed_at")
    ).join(table, ["stop_code", "service_no"], "left")
    state, first, last = clock.service_state("weekday", "minute")
    return rows.select("event_id", "stop_code", "service_no", "direction", state.alias("in_operation"), clock.hours_text(first, last).alias("hours_text"))


def gap_terms(events: DataFrame, term: Column) -> DataFrame:
    """Running counts of unresolved terms per day, each event once."""
    rows = once(events, late="1 day").filter("event_type = 'no_convenient_option'").withColumn("term", term).filter("term IS NOT NULL")
    return rows.groupBy(F.window("occurred_at", "1 day"), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "term", "n")


def keep_top(table: DataFrame, batch: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most counted terms of each day after a batch of updated counts.

    Counts only grow, so a term that a batch does not touch can only lose ranks: one that is not in
    the table now cannot enter it without being in a batch, and ``k`` rows a day are enough.
    """
    rows = replace_keys(table, batch, ("day", "term"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "term"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def merge_into(stream: DataFrame, root: str, merge, first: DataFrame | None, checkpoint: str, mode: str = "append"):
    """Apply micro-batches to a versioned table, each exactly once.

    Without a ``first`` table the first batch that holds rows starts it. ``mode`` is the output mode of the stream.

    The table's log is keyed by batch number: a replayed batch that is in the log does nothing,
    and one that died before its commit starts again from the last version, whatever data it left.
    """
    from ..sources import sinks

    spark = stream.sparkSession
    if first is not None and not sinks.committed(spark, root, "start"):
        sinks.write_version(first, root, "start")

    def apply(batch: DataFrame, number: int) -> None:
        if sinks.committed(spark, root, str(number)):
            return
        rows = store(batch, "batch")  # read by the test and twice by the merge; a stateful plan should run once
        if not rows.isEmpty():
            known = sinks.read_version(spark, root) if sinks.versions(spark, root) else spark.createDataFrame([], rows.schema)
            sinks.write_version(merge(known, rows), root, str(number))

    return stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch=*" if mode != "append" else folder)
