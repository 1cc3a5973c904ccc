"""Streaming queries: the event and arrival tables read as files, drained with availableNow."""

import uuid

from pyspark.sql import functions as F

from .. import params
from ..operators import timetable
from ..session import checkpoint_root
from ..sources import sinks
from ..streaming import streams
from . import usage  # noqa: F401  its contract statement is checked here too
from .registry import ORACLES, query


def folder(g, name):
    return f"{checkpoint_root(g.spark)}/streams/{name}-{uuid.uuid4().hex}"


def event_files(g):
    """Usage events as files in time order; some rows repeat."""

    def build():
        path = folder(g, "events")
        whole = g.event.unionByName(g.event.filter("event_id % 10 = 0"))
        whole.repartitionByRange(4, "occurred_at").sortWithinPartitions("occurred_at").write.parquet(path)
        g._made["event path"] = path
        return g.spark.read.parquet(path)

    g.make("event files", build)
    return g._made["event path"], g._made["event files"].schema


def arrival_files(g):
    def build():
        path = folder(g, "arrivals")
        g.arrival.repartitionByRange(4, "observed_at").write.parquet(path)
        g._made["arrival path"] = path
        return g.spark.read.parquet(path)

    g.make("arrival files", build)
    return g._made["arrival path"], g._made["arrival files"].schema


def run(g, name, stream, mode="append"):
    return streams.drain(stream, folder(g, name), folder(g, f"{name}-state"), mode)


def merged(g, name, stream, merge):
    """The table that the updates of a stream were merged into, one row per key."""
    root = folder(g, f"{name}-table")
    streams.merge_into(stream, root, merge, None, folder(g, f"{name}-state"), "update").awaitTermination()
    return sinks.read_version(g.spark, root)


def events(g):
    return streams.file_stream(g.spark, *event_files(g))


@query("stream_event_ingest", f"""SELECT e.event_id, e.event_type, e.user_id FROM b_event e JOIN ({ORACLES['flt_event_contract']}) v ON v.event_id = e.event_id WHERE verdict = 'accepted'""")
def _(g):
    return run(g, "ingest", streams.ingest(events(g))).select("event_id", "event_type", "user_id")


@query("stream_event_counts", """SELECT epoch_ms(CAST(CAST(occurred_at AS DATE) AS TIMESTAMP))//1000 AS day, event_type, COUNT(*) AS n FROM (SELECT * FROM b_event UNION ALL SELECT * FROM b_event WHERE event_id % 10 = 0) z
 WHERE CAST(occurred_at AS DATE) + 1 <= (SELECT MAX(occurred_at) FROM b_event) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(g):
    rows = run(g, "counts", streams.event_counts(events(g)))
    return rows.select(F.unix_timestamp("day").alias("day"), "event_type", "n")


@query("stream_active_users")
def _(g):
    return run(g, "active", streams.active_users(events(g)))


@query("stream_sessions", """SELECT user_id, epoch_us(MIN(occurred_at))//1000000 AS started, COUNT(*) AS events, ROUND(epoch_us(MAX(occurred_at))/1e6 - epoch_us(MIN(occurred_at))/1e6 + 1800, 3) AS seconds FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (
  SELECT user_id, event_id, occurred_at, CASE WHEN occurred_at - LAG(occurred_at) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM (SELECT * FROM b_event UNION ALL SELECT * FROM b_event WHERE event_id % 10 = 0) u) a) b
 GROUP BY user_id, visit HAVING MAX(occurred_at) + INTERVAL 30 MINUTE <= (SELECT MAX(occurred_at) FROM b_event) - INTERVAL 1 DAY""")
def _(g):
    rows = run(g, "sessions", streams.sessions(events(g)))
    return rows.withColumn("started", F.unix_timestamp("started")).withColumn("seconds", F.round("seconds", 3))


# the watermark a drained stream ends with, by which rows that wait for it have left
LAST = "(SELECT MAX(occurred_at) FROM b_event) - INTERVAL 1 HOUR"


@query("stream_search_outcome", f"""SELECT s.event_id, s.search_id, CASE WHEN EXISTS (SELECT 1 FROM b_event d WHERE d.event_type = 'optimization_completed' AND d.search_id = s.search_id
   AND d.occurred_at BETWEEN s.occurred_at AND s.occurred_at + INTERVAL {params.SEARCH_TIMEOUT_S} SECOND) THEN 'completed' ELSE 'timed_out' END AS outcome
 FROM b_event s WHERE s.event_type = 'search_started' AND s.search_id IS NOT NULL AND s.occurred_at < {LAST} - INTERVAL {params.SEARCH_TIMEOUT_S} SECOND""")
def _(g):
    return run(g, "outcome", streams.search_outcome(events(g), events(g)))


_rank = " ".join(f"WHEN '{kind}' THEN {value}" for kind, value in streams.STAGE_RANK)


@query("stream_search_funnel", f"""SELECT search_id, epoch_us(MIN(occurred_at))//1000000 AS started, CAST(MAX(stage) AS INTEGER) AS stage, COUNT(*) AS events FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY search_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (
  SELECT search_id, event_id, occurred_at, CASE event_type {_rank} ELSE 0 END AS stage,
   CASE WHEN occurred_at - LAG(occurred_at) OVER (PARTITION BY search_id ORDER BY occurred_at, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
  FROM b_event WHERE search_id IS NOT NULL) a) b GROUP BY search_id, visit HAVING MAX(occurred_at) + INTERVAL 1 HOUR <= {LAST}""")
def _(g):
    return run(g, "funnel", streams.search_funnel(events(g))).withColumn("started", F.unix_timestamp("started"))


@query("stream_arrival_latest", f"""SELECT stop_code, service_no, slot, epoch_us(observed_at)//1000000 AS observed_at, eta_seconds, epoch_us(observed_at)//1000000 + {params.ARRIVAL_FRESH_S} AS fresh_until FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY stop_code, service_no, slot ORDER BY observed_at DESC, event_id DESC) AS rn FROM b_arrival WHERE observed_at IS NOT NULL) z WHERE rn = 1""")
def _(g):
    path, schema = arrival_files(g)
    rows = merged(g, "latest", streams.latest_arrivals(streams.file_stream(g.spark, path, schema, 1)), streams.replace_keys)
    return rows.select(*streams.ARRIVAL_KEY, F.unix_timestamp("observed_at").alias("observed_at"), "eta_seconds", F.unix_timestamp("fresh_until").alias("fresh_until"))


@query("stream_arrival_operation", "SELECT event_id, stop_code, service_no, direction, state AS in_operation, hours_text FROM x_arrival_state")
def _(g):
    return run(g, "operation", streams.arrival_operation(streams.file_stream(g.spark, *arrival_files(g)), g.keep("routes", lambda: timetable.routes(g.bus_route))))


@query("stream_gap_terms", """SELECT epoch_us(day)//1000000 AS day, term, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY n DESC, term) AS place FROM (
 SELECT date_trunc('day', occurred_at)::TIMESTAMP AS day, 'user term ' || CAST(user_id % 50 AS VARCHAR) AS term, COUNT(*) AS n FROM b_event WHERE event_type = 'no_convenient_option' AND user_id IS NOT NULL GROUP BY 1, 2) a) b
 WHERE place <= 20""")
def _(g):
    term = F.concat(F.lit("user term "), (F.col("user_id") % 50).cast("string"))
    # one batch: files written side by side have no order in time, and rows behind the watermark are dropped
    rows = merged(g, "gaps", streams.gap_terms(events(g), term), streams.keep_top)
    return rows.withColumn("day", F.unix_timestamp("day"))


@query("stream_catalog_merge")
def _(g):
    path, root = folder(g, "logos"), folder(g, "logo-table")
    g.logo_new.repartition(3, "brand_key").write.parquet(path)
    source = streams.file_stream(g.spark, path, g.logo_new.schema, 1)
    started = streams.merge_into(source, root, sinks.merge_logos, g.logo_old, folder(g, "logo-state"))
    started.awaitTermination()
    return sinks.read_version(g.spark, root)
