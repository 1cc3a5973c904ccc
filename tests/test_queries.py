"""The registry, and a sample of queries against their checking SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from tripweave.queries import QUERIES
from tripweave.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "agg_usage_report", "agg_latency_percentiles", "src_bus_routes", "join_arrival_operation", "join_nearest_node", "prj_categories",
    "win_outlet_dedupe", "join_corridor", "pipe_candidates", "pipe_plan", "agg_funnel", "text_entities", "top_catalog_search",
    "set_route_buckets", "join_route_asof", "stream_event_ingest", "stream_sessions", "stream_search_outcome", "stream_search_funnel", "stream_arrival_latest", "stream_gap_terms",
)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) == 170


@pytest.mark.parametrize("key", SAMPLE)
def test_query_agrees_with_sql(spark, engine, key):
    frame = entry.queries()[key](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    result = engine.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(names, result.fetchall())


def test_plan_invariants(spark):
    rows = entry.queries()["pipe_plan"](spark, FOLDER).collect()
    per = {}
    for r in rows:
        per.setdefault(r.trip_id, []).append(r)
    for group in per.values():
        shown = [r for r in group if r.role == "recommended"]
        also = [r for r in group if r.role == "considered"]
        assert len(shown) <= 5 and len(also) <= 6
        sets = lambda rs: {frozenset((r.first_stop, r.second_stop)) for r in rs}
        assert not sets(shown) & sets(also)


def test_legs_by_the_clock_agree_with_a_walk(spark):
    from tripweave.queries import trips
    from tripweave.queries.registry import workspace

    g = workspace(spark, FOLDER)
    p = trips.plan(g)
    table = {}
    for r in trips.leg_rows(g).collect():
        table.setdefault((r.from_place, r.to_place), []).append((r.bucket, r.minutes))
    starts = {(r.sid, r.stop1, r.s2, r.order_no): (int(r.departure.timestamp()), r.dwell_a, r.dwell_b or 0.0) for r in p.starts().collect()}
    plain, want = {}, {}
    for r in p.priced_segments().collect():
        plain.setdefault((r.sid, r.stop1, r.s2, r.order_no), {})[r.segment] = (r.from_place, r.to_place, r.minutes)
    for key, legs in plain.items():
        now, dwell = starts[key][0], (*starts[key][1:], 0.0)
        for n, (a, b, minutes) in sorted(legs.items()):
            known = [(k, m) for k, m in table.get((a, b), []) if k <= now // 60]
            minutes = max(known)[1] if known else minutes
            want[(*key, n)] = (now, minutes, bool(known))
            now += round((minutes + dwell[n]) * 60)
    rows = entry.queries()["win_leg_departures"](spark, FOLDER).collect()
    got = {(r.sid, r.stop1, r.s2, r.order_no, r.segment): (r.leaves, r.minutes, r.from_table) for r in rows}
    assert len(rows) == len(got) and {f for _, _, f in got.values()} == {True, False} and {k[-1] for k in got} == {0, 1, 2}
    off = {k for k in want if got.get(k, (0, 0, 0))[1:] != want[k][1:] or abs(got[k][0] - want[k][0]) > 1}
    assert set(got) == set(want) and not off


def test_a_plan_on_a_route_table(spark):
    from tripweave.plans.trips import TripPlan
    from tripweave.queries import trips
    from tripweave.queries.registry import workspace

    g = workspace(spark, FOLDER)
    plain = trips.plan(g)
    few = trips.trip_table(g).filter("trip_id <= 60")
    direct = trips.departures(g).filter("trip_id <= 60 AND trip_id % 2 = 0").selectExpr(
        "from_place", "to_place", "bucket - 5 AS bucket", "5e0 AS minutes", "1e0 AS walk_minutes", "78e0 AS walk_m", "0L AS transfers"
    )
    timed = TripPlan(spark, few, g.hub, g.outlet, g.node, g.station, g.category, route_table=direct)
    before = {r.trip_id: r.base_minutes for r in plain.routes().filter("trip_id <= 60").collect()}
    after = {r.trip_id: r.base_minutes for r in timed.routes().collect()}
    assert set(before) == set(after) and all(after[t] == (5.0 if t % 2 == 0 else before[t]) for t in after)
    whole = {r.trip_id: r.added_minutes for r in plain.scored().filter("trip_id <= 60 AND search_no = 0").collect() if r.order_no == 0}
    moved = {r.trip_id for r in timed.scored().filter("search_no = 0").collect()}
    assert moved and moved <= set(whole)


def test_entry_works_without_the_training_data_package():
    code = (
        "import sys\n"
        "class Hidden:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tripweave.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hidden())\n"
        "import __spark_entry__ as entry\n"
        "assert len(entry.queries()) == 170 and not any(k.startswith('op1_') or k == 'pipeline' for k in entry.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), check=True)
