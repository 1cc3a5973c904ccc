"""Operators on small inputs: against brute force, and on the cases their rules are about."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripweave.functions import clock, geo, text
from tripweave.operators import candidates, catalog, foci, journey, rank, requests, search, spatial, timetable, usage
from tripweave.sources import elements, feeds, sinks


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_equals_exhaustive_scan(spark):
    rng = random.Random(7)
    spot = lambda: (round(rng.uniform(1.22, 1.46), 5), round(rng.uniform(103.62, 104.05), 5))
    sites = [(f"n{i:04d}", *spot()) for i in range(2000)] + [("z", 1.3, 103.8), ("a", 1.3, 103.8)]
    probes = [spot() for _ in range(60)] + [(1.3, 103.8)]
    found = spatial.nearest(
        spark.createDataFrame(probes, "lat double, lon double"), spark.createDataFrame(sites, "site_id string, lat double, lon double")
    ).collect()
    assert len(found) == len(set(probes))
    for row in found:
        best = min((round(km(row.lat, row.lon, s[1], s[2]), 9), s[0]) for s in sites)
        assert row.site_id == best[1]
        assert row.distance_m == pytest.approx(best[0] * 1000, abs=0.06)


def test_k_nearest_equals_exhaustive_scan(spark):
    rng = random.Random(3)
    sites = [(i, f"s{i % 40}", rng.uniform(1.25, 1.44), rng.uniform(103.65, 104.0)) for i in range(60)]
    probes = [(rng.uniform(1.22, 1.46), rng.uniform(103.62, 104.05)) for _ in range(30)]
    rows = spatial.k_nearest(
        spark.createDataFrame(probes, "lat double, lon double"), spark.createDataFrame(sites, "site_id int, name string, s_lat double, s_lon double"), 4
    ).collect()
    for row in rows:
        seen, want = set(), []
        for d, i, n in sorted((km(row.lat, row.lon, s[2], s[3]), s[0], s[1]) for s in sites):
            if n not in seen:
                seen.add(n)
                want.append(i)
        assert [n.site_id for n in row.near] == want[:4]


def test_far_points_keep_their_nearest_site(spark):
    sites = [("a", 1.3, 103.8), ("b", 1.31, 103.9), ("c", 8.0, 110.0)]
    probes = [(1.3, 103.81), (4.9, 105.0), (-33.9, 151.2), (51.5, -0.1), (9.0, 111.0)]
    frame = spark.createDataFrame(probes, "lat double, lon double")
    found = spatial.nearest(frame, spark.createDataFrame(sites, "site_id string, lat double, lon double")).collect()
    want = {p: min((km(*p, s[1], s[2]), s[0]) for s in sites) for p in probes}
    assert {(r.lat, r.lon): r.site_id for r in found} == {p: w[1] for p, w in want.items()}
    assert all(r.distance_m == pytest.approx(want[r.lat, r.lon][0] * 1000, abs=0.06) for r in found)
    named = spark.createDataFrame([(i, n, a, o) for i, (n, a, o) in enumerate(sites + [("a", 1.29, 103.79)])], "site_id int, name string, s_lat double, s_lon double")
    near = {(r.lat, r.lon): [n.name for n in r.near] for r in spatial.k_nearest(frame, named, 2).collect()}
    assert set(near) == set(probes) and near[9.0, 111.0] == ["c", "b"] and near[1.3, 103.81] == ["a", "b"]


def test_least_detour_equals_exhaustive_scan(spark):
    rng = random.Random(11)
    spot = lambda: (rng.uniform(1.22, 1.46), rng.uniform(103.62, 104.05))
    hubs = [(i, *spot(), rng.choice([0, 0, 0, 1, 2])) for i in range(400)] + [(400, 1.3, 103.8, 0), (401, 1.3, 103.8, 0), (402, 5.0, 101.0, 3), (403, None, 1.0, 0)]
    ends = [(i, *spot(), *spot(), rng.choice([0, 1, 2])) for i in range(40)] + [(40, 1.3, 103.8, 1.3, 103.8, 0), (41, 1.3, 103.8, 1.4, 103.9, 3), (42, 1.3, 103.8, 1.4, 103.9, 9), (43, 30.0, 90.0, 31.0, 91.0, 1)]
    base = [(*e, km(*e[1:5])) for e in ends]
    chord = F.round(F.greatest(F.lit(0.0), geo.haversine_km("o_lat", "o_lon", "lat", "lon") + geo.haversine_km("lat", "lon", "d_lat", "d_lon") - F.col("base_km")), 6)
    found = foci.least_detour(
        spark.createDataFrame(base, "need int, o_lat double, o_lon double, d_lat double, d_lon double, key int, base_km double"),
        spark.createDataFrame(hubs, "hub_id int, lat double, lon double, key int"), ["need"], ["key"], 5, chord, [F.col("hub_id")], ["hub_id"],
    ).collect()
    got = {}
    for r in found:
        got.setdefault(r.need, []).append((r.chord_km, r.hub_id))
    for n, a, b, c, d, key, straight in base:
        want = sorted((round(max(0.0, km(a, b, h[1], h[2]) + km(h[1], h[2], c, d) - straight), 6), h[0]) for h in hubs if h[3] == key and h[1])[:5]
        assert [h for _, h in sorted(got.get(n, []))] == [h for _, h in want], n


def test_strip_cells_cover_the_corridor(spark):
    rng = random.Random(2)
    spot = lambda: (rng.uniform(1.22, 1.46), rng.uniform(103.62, 104.05))
    lines = [(i, *spot(), *spot()) for i in range(30)] + [(30, 1.3, 103.7, 1.3, 103.9), (31, 1.3, 103.7, 1.4, 103.7), (32, 1.3, 103.7, 1.3, 103.7)]
    hubs = [(i, *spot()) for i in range(1500)]
    rows = spark.createDataFrame(lines, "line int, a_lat double, a_lon double, b_lat double, b_lon double")
    sited = spark.createDataFrame(hubs, "hub int, lat double, lon double")
    exact = geo.segment_km("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon") <= 2.5
    by_cell = rows.withColumn("cell", F.explode(candidates._segment_cells("a_lat", "a_lon", "b_lat", "b_lon"))).join(sited.withColumn("cell", candidates._cell_of("lat", "lon")), "cell")
    everything = rows.crossJoin(sited)
    pick = lambda frame: sorted(map(tuple, frame.filter(exact).select("line", "hub").collect()))
    assert pick(by_cell) == pick(everything)
    assert by_cell.count() < 0.5 * everything.count()


def test_long_repeats_do_not_overflow(spark):
    texts = ["coffee" + " please" * 20_000, "just " * 20_000 + "coffee", "coffee" + " - " * 9_000 + "please", "buy coffee  please too - as well"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("norm", text.normalize("text"))
    assert [r.clause for r in requests.clauses(frame).collect()] == ["coffee"] * 4


def test_service_state_keeps_unknown_and_yesterday(spark):
    fields = "weekday_first string, weekday_last string, saturday_first string, saturday_last string, sunday_first string, sunday_last string"
    row = spark.createDataFrame([("0530", "2352", "0530", "0015", None, None)], fields)
    state = lambda day, minute: row.select(clock.service_state(F.lit(day), F.lit(minute))[0].alias("s")).first().s
    assert state(1, 12 * 60) is True
    assert state(1, 3 * 60) is False
    assert state(6, 10) is True  # Saturday's last bus, after midnight
    assert state(6, 12 * 60) is None  # no Sunday window: unknown, not stopped
    assert state(0, 60) is None  # before the first bus and yesterday is unknown


@pytest.mark.parametrize("hours, at, dwell, want", [
    ("24/7", "2026-01-05T03:00:00", 10, "open"), ("Mo-Fr 09:00-22:00", "2026-01-05T21:55:00", 10, "closing_soon"),
    ("Mo-Fr 09:00-22:00", "2026-01-04T12:00:00", 10, "closed"), ("22:00-02:00", "2026-01-05T01:00:00", 10, "open"),
    ("PH off", "2026-01-05T12:00:00", 10, "unknown"), ("09:00-22:00; Su off", "2026-01-05T12:00:00", 10, "unknown"),
    ("Mo-Sa 08:00-20:00; Su off", "2026-01-04T12:00:00", 10, "closed"), ("10:00-10:00", "2026-01-04T12:00:00", 5, "unknown"),
])
def test_opening_hours(spark, hours, at, dwell, want):
    frame = spark.createDataFrame([(hours, datetime.fromisoformat(at), float(dwell))], "opening_hours string, arrival timestamp, dwell_minutes double")
    assert timetable.open_status(frame).first().status == want


def test_greedy_dedupe_equals_sequential_rule(spark):
    rng = random.Random(11)
    rows = [(f"p{i:04d}", f"k{i % 3}", 1.3 + rng.randrange(40) * 1e-4, 103.8 + rng.randrange(4) * 1e-4) for i in range(200)]
    kept = {r.id for r in catalog.dedupe_places(spark.createDataFrame(rows, "id string, key string, lat double, lon double"), "key").collect()}
    want = []
    for row in sorted(rows):
        if not any(w[1] == row[1] and km(w[2], w[3], row[2], row[3]) <= 0.025 for w in want):
            want.append(row)
    assert kept == {w[0] for w in want}


def test_unique_names_are_unique(spark):
    rows = [(f"n{i:03d}", "city", "7-Eleven", ["Orchard Road"] if i % 2 else []) for i in range(150)] + [("x", "city", "7-Eleven 2", [])]
    named = catalog.unique_names(spark.createDataFrame(rows, "id string, scope string, base string, qualifiers array<string>")).collect()
    assert len(named) == len(rows) and len({r.name for r in named}) == len(rows)
    assert {r.id: r.name for r in named}["n000"] == "7-Eleven"


def test_option_counts_match_the_pairs_built(spark):
    rng = random.Random(5)
    rows = []
    for sid in range(30):
        for hub in range(14):
            has1, has2 = rng.random() < 0.5, rng.random() < 0.5
            rows.append((sid, sid, 0, 1, 2, None, None, "best_match", 6, 1.3, 103.8, 1.35, 103.9, 10.0, hub, 1.3 + hub / 1e3, 103.8, 1, 50.0, has1, has2, int(has1) + int(has2), rng.random(), 1.0, 2.0, rng.random(), has1 and rng.random() < 0.7, has2))
    schema = "sid bigint, trip_id bigint, search_no int, c1 bigint, c2 bigint, brand1 bigint, brand2 bigint, match_class string, max_candidates int, o_lat double, o_lon double, d_lat double, d_lon double, base_km double, hub_id bigint, lat double, lon double, kind int, node_m double, has1 boolean, has2 boolean, coverage int, line_km double, from_o double, to_d double, chord_km double, sat1 boolean, sat2 boolean"
    frame = spark.createDataFrame(rows, schema)
    counted = {r.sid: r.n_options for r in candidates.option_counts(frame).collect()}
    ranked = {}
    for r in rows:
        ranked.setdefault(r[0], []).append(r)
    for sid, group in ranked.items():
        group.sort(key=lambda r: (-r[21], r[17], r[25], r[18], r[14]))
        pairs, seen = 0, set()
        for a in group:
            for b in group:
                if a[14] == b[14] or not a[19] or not b[20]:
                    continue
                key = frozenset((a[14], b[14]))
                if key in seen:
                    continue
                seen.add(key)
                pairs += a[26] and b[27]
        alone = sum(r[26] and r[27] for r in group)
        assert counted[sid] == pairs + alone


def test_similar_pairs_miss_nothing(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    left = spark.createDataFrame([(w,) for w in set(words[:30])], "q string")
    right = spark.createDataFrame([(w,) for w in set(words[30:])], "n string")
    got = {(r.q, r.n) for r in search.similar_pairs(left, "q", right, "n", 0.6).collect()}
    every = left.crossJoin(right).withColumn("s", text.similarity("q", "n")).filter("s >= 0.6")
    assert got == {(r.q, r.n) for r in every.collect()}


def test_map_payload_file(spark, tmp_path):
    body = '{"capture_metadata":{"captured_at":"x"},"elements":[{"type":"node","id":1,"lat":1.3,"lon":103.8,"tags":{"shop":"supermarket"}},{"type":"way","id":2,"bounds":{"minlat":1.2,"maxlat":1.4,"minlon":103.7,"maxlon":103.9},"tags":{"shop":"mall","disused:shop":"yes"}}]}'
    (tmp_path / "a.json").write_text(body)
    rows = elements.located(elements.read_map_payloads(spark, str(tmp_path))).withColumn("closed", elements.is_closed()).orderBy("id").collect()
    assert [(r.source_id, round(r.lat, 6), r.closed) for r in rows] == [("node/1", 1.3, False), ("way/2", 1.3, True)]


def test_itinerary_fallbacks(spark):
    leg = '{"mode":"WALK","duration":240,"distance":310.2},{"mode":"BUS","duration":1800,"distance":9000},{"mode":"SUBWAY","duration":600,"distance":5000}'
    texts = [(1, '{"plan":{"itineraries":[{"legs":[%s]}]}}' % leg), (2, '{"data":{"plan":{"itineraries":[{"duration":2520,"walkTime":480,"transfers":1,"legs":[]}]}}}'), (3, '{"error":"No path"}'), (4, '{"plan":{"itineraries":[]}}')]
    routes, rejects = feeds.itineraries(spark.createDataFrame(texts, "id int, payload string"), "id")
    got = {r.id: (r.minutes, r.walk_minutes, r.transfers) for r in routes.collect()}
    assert got == {1: (44.0, 4.0, 1), 2: (42.0, 8.0, 1)}
    assert {r.id: r.reject_reason for r in rejects.collect()} == {3: "no route", 4: "no route"}


def test_polyline_decodes(spark):
    points = spark.range(1).select(journey.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")).alias("p")).first().p
    assert [(round(p.lat, 3), round(p.lon, 3)) for p in points] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_clauses_and_entities(spark):
    texts = requests.distinct_texts(spark.createDataFrame([("need to grab some panadol and cat food",), ("hello",), ("KFC then bubble tea, prefer walking less",)], "text string"))
    clauses = {(r.text, r.clause_no): r.clause for r in requests.clauses(texts).collect()}
    assert clauses[("need to grab some panadol and cat food", 1)] == "panadol"
    assert not any(t == "hello" for t, _ in clauses)
    found = requests.entities(texts, requests.dictionary(spark)).collect()
    assert {r.category for r in found if r.text.startswith("need")} == {"pharmacy", "pet_supplies"}
    assert {r.category for r in found if r.text.startswith("KFC")} == {"fried_chicken", "bubble_tea"}


def test_logo_merge_and_empty_capture(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "brand_key string, url string")
    new = spark.createDataFrame([("a", "9"), ("b", None)], "brand_key string, url string")
    assert {tuple(r) for r in sinks.merge_logos(old, new).collect()} == {("a", "9"), ("c", "3")}
    with pytest.raises(ValueError):
        sinks.write_version(old.filter("false"), str(tmp_path / "t"), "1")


def test_indistinguishable_winners_are_dropped(spark):
    fields = ["sid", "search_no", "position", "order_no", "first_stop", "second_stop", "label", "match_class", "score", "added_minutes", "added_walk_minutes", "added_walk_m", "added_transfers", "dwell_minutes", "total_minutes", "consolidated", "hard_met"]
    row = lambda stop, score, minutes, walk: (1, stop, 0, 1, 0, stop, None, "best_match", "best_match", score, minutes, walk, walk * 78.0, 0, 5.0, 40.0, False, True)
    schema = "trip_id bigint, sid bigint, search_no int, position int, order_no int, first_stop bigint, second_stop bigint, label string, match_class string, score double, added_minutes double, added_walk_minutes double, added_walk_m double, added_transfers bigint, dwell_minutes double, total_minutes double, consolidated boolean, hard_met boolean"
    assert len(fields) + 1 == len(schema.split(","))
    frame = spark.createDataFrame([row(1, 1.0, 10.0, 2.0), row(2, 2.0, 9.0, 2.5), row(3, 9.0, 30.0, 0.0)], schema)
    kept = {r.result: r.first_stop for r in rank.distinct_winners(rank.objectives(rank.winner_pool(frame))).collect()}
    assert kept == {"best_overall": 1, "least_walking": 3}


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    rows = lambda *values: spark.createDataFrame(values, "source string, hub_id int")
    sinks.write_version(rows(("a", 1), ("b", 2), ("c d", 3)), root, "1", partition_by="source")
    first = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table" / "versions" / "1").rglob("*.parquet")}

    # the job dies after its data are written and before they are committed
    commit = sinks._commit
    monkeypatch.setattr(sinks, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.write_version(rows(("b", 8), ("b", 9)), root, "2", "source", keep_others=True)
    assert sorted(map(tuple, sinks.read_version(spark, root).collect())) == [("a", 1), ("b", 2), ("c d", 3)]
    monkeypatch.setattr(sinks, "_commit", commit)

    # the replay writes the partition of b alone; the others keep their files
    sinks.write_version(rows(("b", 8)), root, "2", "source", keep_others=True)
    assert sorted(map(tuple, sinks.read_version(spark, root).collect())) == [("a", 1), ("b", 8), ("c d", 3)]
    assert [p.name for p in (tmp_path / "table" / "versions" / "2").iterdir() if p.is_dir()] == ["_part=b"]
    assert first == {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table" / "versions" / "1").rglob("*.parquet")}
    with pytest.raises(ValueError):
        sinks.write_version(rows(("b", 7)), root, "2", "source", keep_others=True)


def test_batches_of_a_merge_count_once(spark, tmp_path, monkeypatch):
    from tripweave.streaming import streams

    source, root, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    first = spark.createDataFrame([("a", 1)], "k string, n int")
    first.withColumn("n", F.lit(10)).write.parquet(source)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").cast("int").alias("n"))
    stream = spark.readStream.schema(first.schema).parquet(source)
    commit, tried = sinks._commit, []

    def die_once(spark, root, version, parts):
        if version == "0" and not tried:
            tried.append(version)
            raise OSError("lost")
        commit(spark, root, version, parts)

    monkeypatch.setattr(sinks, "_commit", die_once)
    with pytest.raises(Exception):
        streams.merge_into(stream, root, add, first, state).awaitTermination()
    assert tried and [tuple(r) for r in sinks.read_version(spark, root).collect()] == [("a", 1)]
    for _ in range(2):  # the replay, and a restart with nothing new
        streams.merge_into(stream, root, add, first, state).awaitTermination()
        assert [tuple(r) for r in sinks.read_version(spark, root).collect()] == [("a", 11)]


def test_route_prices_as_of_a_departure(spark):
    import random

    from tripweave.operators import routes

    pick = random.Random(3)
    fields = "from_place long, to_place long, bucket long, minutes double, walk_minutes double, walk_m double, transfers long"
    # one pair holds a third of all rows; buckets reach over many days and below zero
    pair = lambda: (1, 2) if pick.random() < 0.33 else (pick.randrange(4), pick.randrange(4))
    rows = [(*pair(), pick.randrange(-300, 900), float(pick.randrange(5, 60)), 1.0, 78.0, pick.randrange(3)) for _ in range(300)]
    rows += rows[:20] + [(1, 2, None, 9.0, 1.0, 1.0, 0), (None, 2, 5, 9.0, 1.0, 1.0, 0), (1, 2, 890, None, 1.0, 1.0, 0)]
    asked = [(*pair(), pick.randrange(-320, 5000)) for _ in range(200)] + [(9, 9, 1), (1, None, 1), (1, 2, None)]
    for width in (15, 60, 1):
        want = set()
        for a, b, k in asked:
            known = [r for r in rows if r[:2] == (a, b) and None not in (a, b, k, r[2], r[3]) and r[2] <= k]
            if known:
                newest = max(r[2] for r in known)
                want.add((a, b, k, *min(r[3:] for r in known if r[2] == newest)))
        found = routes.as_of(spark.createDataFrame(asked, "from_place long, to_place long, bucket long"), spark.createDataFrame(rows, fields), width)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    empty = routes.as_of(spark.createDataFrame(asked, "from_place long, to_place long, bucket long"), spark.createDataFrame([], fields))
    assert empty.count() == 0


def test_top_terms_of_growing_counts(spark):
    import random

    from tripweave.streaming import streams

    pick, counts = random.Random(5), {}
    top = spark.createDataFrame([], "day int, term string, n long")
    for _ in range(6):
        seen = [(pick.randrange(2), pick.choice("abcdefghij")) for _ in range(8)]
        for key in seen:
            counts[key] = counts.get(key, 0) + 1
        batch = spark.createDataFrame([(*key, counts[key]) for key in set(seen)], top.schema)
        top = streams.keep_top(top, batch, 3)
        rows = [tuple(r) for r in top.collect()]
        top = spark.createDataFrame(rows, top.schema)
        want = [(d, t, n) for day in (0, 1) for n, t, d in sorted(((n, t, d) for (d, t), n in counts.items() if d == day), key=lambda x: (-x[0], x[1]))[:3]]
        assert sorted(rows) == sorted(want)


def test_a_batch_replaces_rows_with_its_keys(spark):
    from tripweave.streaming import streams

    fields = "k string, n int"
    table, batch = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], fields), spark.createDataFrame([(None, 9), ("d", 4)], fields)
    assert {tuple(r) for r in streams.replace_keys(table, batch, ("k",)).collect()} == {("a", 1), (None, 9), ("c", 3), ("d", 4)}


def test_a_captured_source_rewrites_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "hubs")
    fields = "hub_id long, name string, lat double, lon double, source string"
    old = [(1, "Mall", 1.3, 103.8, "old"), (2, "Inn", 1.31, 103.8, "map"), (3, "Hall", 1.35, 103.9, "other/x"), (4, "Shop", 1.4, 103.9, "new")]
    sinks.write_version(spark.createDataFrame(old, fields), root, "1", partition_by="source")
    fresh = spark.createDataFrame([(9, "Mall", 1.3001, 103.8, "new")], fields)
    assert sinks.replace_source_in(root, "2", fresh, "new") == ["new", "old"]
    # the only row of "old" is superseded, so its folder goes; "map" and "other/x" stay as they were
    after = {(r.hub_id, r.source) for r in sinks.read_version(spark, root).collect()}
    assert after == {(9, "new"), (2, "map"), (3, "other/x")}
    assert [p.name for p in (tmp_path / "hubs" / "versions" / "2").iterdir() if p.is_dir()] == ["_part=new"]


def test_discovery_equals_exhaustive_scan(spark):
    shops = [
        (1, "restaurants", None, "Malan Road Food Hall", None, "malan road food hall"), (2, "restaurants", None, "Mala House", None, "mala house"),
        (3, "electronics", "Gadget", "Tower A", "1 Cable Road", "gadget | electronics | tower a | 1 cable road"), (4, "restaurants", None, "Food Barn", None, "food barn"),
        (5, "electronics", None, "Phone Accessories", None, "phone accessories"), (6, "bakeries", None, "Mala House", None, "mala house"),
    ]
    docs = spark.createDataFrame(
        [(i, c, b, n, a, b or n, "openstreetmap", d) for i, c, b, n, a, d in shops],
        "outlet_id long, category string, brand_name string, name string, address string, label string, source string, doc string",
    )
    typed = requests.need_types(spark.createDataFrame([("mala", "mala"), ("usb c cable", "usb c cable"), ("zzz", "zzz")], "raw string, norm string"), spark)
    found = search.discovery(typed, docs, search.postings(docs))
    got = {(r.norm, r.outlet_id): (list(r.evidence), r.evidence_exact) for r in found.collect()}
    assert got == {
        ("mala", 1): (["mala", "food"], True), ("mala", 2): (["mala"], True), ("mala", 4): (["food"], False),
        ("usb c cable", 3): (["electronics"], False), ("usb c cable", 5): (["phone accessories", "electronics"], False),
    }
    assert [r.outlet_id for r in search.discovery_order(found).filter("norm = 'mala'").orderBy("place").collect()] == [1, 2, 4]
    places = {(r.norm, r.outlet_id): (r.tier, r.suitability, r.relevance) for r in search.need_places(typed, docs, search.postings(docs)).collect()}
    # A dish needs direct evidence; a hall that only serves food is none, and goods take the category as support.
    assert ("mala", 4) not in places and places["mala", 2] == ("strong", "business_verified", 1.0)
    assert places["usb c cable", 5] == ("strong", "category_likely", 1.0)


def test_hours_at_both_stops(spark):
    timed = spark.createDataFrame(
        [(1, 0, 0.0, 10.0), (1, 1, 8.0, 40.0), (1, 2, 15.0, 90.0), (2, 0, 0.0, 30.0), (2, 1, 5.0, 60.0)], "trip_id long, segment int, dwell_before double, end_min double"
    )
    trips = spark.createDataFrame(
        [(1, datetime(2026, 1, 5, 21, 30), 7, 9), (2, datetime(2026, 1, 4, 23, 50), 7, None)], "trip_id long, departure timestamp, first_stop long, second_stop long"
    )
    called = journey.calls(timed, trips)
    assert sorted((r.trip_id, r.stop_no, r.hub_id, r.arrival, r.dwell_minutes) for r in called.collect()) == [
        (1, 1, 7, datetime(2026, 1, 5, 21, 40), 8.0), (1, 2, 9, datetime(2026, 1, 5, 22, 10), 15.0), (2, 1, 7, datetime(2026, 1, 5, 0, 20), 5.0),
    ]
    shops = spark.createDataFrame(
        [(7, "groceries", 1, "Mart", "Mo-Fr 09:00-21:45"), (7, "coffee", 2, "Mart", "24/7"), (7, "coffee", 3, "Cup", None), (9, "groceries", 4, "Late", "22:00-02:00")],
        "hub_id long, errand string, outlet_id long, shop string, opening_hours string",
    )
    lines = journey.errand_lines(timetable.open_status(called.join(shops, "hub_id")))
    got = {(r.trip_id, r.stop_no, r.errand): (r.shop, r.status, r.others) for r in lines.collect()}
    # The name decides the status: the second Mart is read as the first.
    assert got == {
        (1, 1, "groceries"): ("Mart", "closing_soon", 0), (1, 1, "coffee"): ("Mart", "closing_soon", 1), (1, 2, "groceries"): ("Late", "open", 0),
        (2, 1, "groceries"): ("Mart", "closed", 0), (2, 1, "coffee"): ("Mart", "closed", 1),
    }
    notes = {(r.trip_id, r.stop_no): r.note for r in journey.hours_summary(lines).collect()}
    assert notes[1, 1].startswith("May close before") and notes[1, 2].startswith("Listed open") and notes[2, 1].startswith("Listed closed")
    mixed = spark.createDataFrame([(1, 1, 7, "a", "B", "unknown", 0, 9), (1, 1, 7, "b", "A", "open", 0, 1), (2, 1, 7, "a", "B", "closed", 0, 9), (2, 1, 7, "b", "A", "closing_soon", 0, 1)],
        "trip_id long, stop_no int, hub_id long, errand string, shop string, status string, others long, first_outlet long")
    notes = {r.trip_id: r.note for r in journey.hours_summary(mixed).collect()}
    assert notes[1].startswith("Hours not confirmed for B ·") and notes[2].startswith("A and B may be closed")
    assert spark.range(1).select(journey.errand_label(F.lit("bubble_tea")).alias("w")).first().w == "Bubble tea"


def test_latency_ranks_equal_a_sorted_list(spark):
    rng = random.Random(5)
    for values in ([rng.lognormvariate(6, 2) for _ in range(500)] + [7.0] * 300 + [0.0, -1.5, 1e12], [3.25], [5.0, 5.0 + 1e-9, 5.0 + 2e-9]):
        seen = usage.facts(spark.createDataFrame([("optimization_completed", v) for v in values], "event_type string, latency_ms double"), "latency")
        got = {(r.rule, r.quantile): r.latency_ms for r in usage.latency_percentiles(seen).collect()}
        ranked, n = sorted(values), len(values)
        for q in (0.5, 0.95):
            low = math.floor((n - 1) * q)
            share = (n - 1) * q - low
            want = {
                "nearest_rank": ranked[min(n - 1, math.floor((n - 1) * q + 0.999999))], "scaled_count": ranked[min(n - 1, math.floor(n * q))],
                "scaled_span": ranked[low], "linear": ranked[low] * (1 - share) + ranked[min(n - 1, low + 1)] * share,
            }
            for rule, value in want.items():
                assert got[rule, q] == pytest.approx(value, abs=0.006)


def test_usage_report_reads_events_once(spark):
    rows = [
        (1, "2026-01-01 10:00:00", 1, 10, "search_started", None, None, None, None), (2, "2026-01-01 10:01:00", 1, 10, "optimization_completed", None, 100.0, None, None),
        (3, "2026-01-05 09:00:00", 1, 10, "recommendation_selected", 1, None, None, None), (4, "2026-01-09 09:00:00", 2, 11, "search_started", None, None, None, None),
        (5, "2026-01-09 09:00:00", 2, 11, "search_started", None, None, None, None), (6, "2026-01-09 09:00:00", None, None, "feedback_submitted", None, None, "positive", ""),
    ]
    events = spark.createDataFrame(
        [(a, datetime.fromisoformat(b), *rest) for a, b, *rest in rows],
        "event_id long, occurred_at timestamp, user_id long, search_id long, event_type string, recommendation_rank int, latency_ms double, feedback_value string, feedback_reason string",
    )
    seen = usage.facts(events)
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    row = usage.usage_report(seen).first()
    assert (row.searches, row.completion_rate, row.rank_one_acceptance_rate, row.positive_feedback, row.median_latency_ms) == (2, 0.5, 1.0, 1, 100.0)
    assert (row.today, row.unique_anonymous_users, row.active_users_one_day, row.active_users_seven_day, row.returning_users) == ("2026-01-09", 3, 2, 3, 1)
    empty = usage.usage_report(usage.facts(events.limit(0))).first()
    assert empty.searches == 0 and empty.median_latency_ms is None and empty.unique_anonymous_users == 0


def test_searches_leave_with_the_newest_event_of_any_kind(spark, tmp_path):
    from tripweave.streaming import streams

    fields = "event_id bigint, occurred_at string, search_id bigint, event_type string"
    rows = [
        (1, "2024-01-01 08:00:00", 7, "search_started"), (2, "2024-01-01 08:00:05", 7, "optimization_completed"), (2, "2024-01-01 08:00:05", 7, "optimization_completed"),
        (3, "2024-01-01 09:00:00", 8, "search_started"), (4, "2024-01-01 20:00:00", 9, "recommendation_selected"),
    ]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, fields).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).write.parquet(source)
    events = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    found = streams.drain(streams.search_outcome(events, events), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in found.collect()} == {(1, 7, "completed"), (3, 8, "timed_out")}


def test_close_pairs_are_whole_and_never_broadcast(spark):
    rnd = random.Random(5)
    rows = [(f"p{i:04d}", "k" if i % 3 else "l", 1.3 + rnd.random() / 100, 103.8 + rnd.random() / 100) for i in range(300)]
    rows += [("p9000", "k", *rows[1][2:]), ("p9001", "k", *rows[1][2:]), ("p9002", "k", 1.31, 103.9)]
    frame = spark.createDataFrame(rows, "id string, key string, lat double, lon double")
    pairs = catalog.close_pairs(frame, "key", 0.15)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    apart = frame.alias("a").crossJoin(frame.alias("b")).filter("a.key = b.key AND b.id < a.id").filter(geo.haversine_km("a.lat", "a.lon", "b.lat", "b.lon") <= 0.15)
    want = sorted(tuple(r) for r in apart.select("a.id", "b.id").collect())
    assert want and sorted(tuple(r) for r in pairs.collect()) == want


def test_the_planner_writes_corridor_rows_once(spark, monkeypatch):
    from tripweave.plans import trips as planner
    from tripweave.queries.registry import Given
    from tripweave.queries.trips import plan

    written, store = [], planner.store
    monkeypatch.setattr(planner, "store", lambda frame, name, **options: written.append(name) or store(frame, name, **options))
    p = plan(Given(spark, "/root/testdata/sf0.001"))
    got = p.corridor_rows().select("sid", "hub_id", "tag", "line_km")
    assert "near_lists" not in written and "corridor_rows" not in written
    both = candidates.full_cover(p.searches(), p.hub_rows(), p.line_hubs())
    near = store(p.near_lists(), "lists")
    assert near.select("sid").distinct().exceptAll(p.corridor_near().select("sid").distinct()).isEmpty()
    want = candidates.transit_access(near.unionByName(both).unionByName(p.far_rows())).select("sid", "hub_id", "tag", "line_km")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()


def test_running_counts_equal_a_count_of_every_row(spark):
    rng = random.Random(28)
    clocks = lambda: rng.choice([("0530", "0015"), ("0600", "2400"), ("1427", "2349"), (None, None), ("0620", None)])
    rows = [(str(i % 3), 1, i, f"{10000 + i}", *clocks(), *clocks(), *clocks()) for i in range(400)] + [("lone", 1, 1, "10000", *[None] * 6)]
    named = ", ".join(f"{c} string" for c in timetable.CLOCK_FIELDS.values())
    routes = spark.createDataFrame(rows, f"service_no string, direction int, stop_sequence int, stop_code string, {named}")
    each = timetable.service_state_at(routes, (0, 5, 6), (10, 720)).groupBy("service_no", "weekday", "minute").agg(
        F.count_if("in_operation"), F.count_if(~F.col("in_operation")), F.count_if(F.col("in_operation").isNull()), F.min("hours_text")
    )
    got = timetable.running_counts(routes, (0, 5, 6), (10, 720))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, each.collect()), key=repr) and got.count() == 24


def test_malls_and_places_of_one_spot_meet_once(spark, monkeypatch):
    met = []
    for name in ("inside_boxes", "within"):
        plain = getattr(spatial, name)

        def counted(spots, sites, *rest, plain=plain):
            met.append((spots.count(), sites.count()))
            return plain(spots, sites, *rest)

        monkeypatch.setattr(catalog.spatial, name, counted)
    places = spark.createDataFrame([(f"p{i}", 1.3, 103.8) for i in range(30)] + [("far", 1.4, 103.9)], "source_id string, lat double, lon double")
    malls = spark.createDataFrame(
        [(f"m{i}", 1.3, 103.8, 1.29, 1.31, 103.79, 103.81) for i in range(20, 9, -1)] + [("a", 1.3, 103.8, None, None, None, None)],
        "mall_id string, lat double, lon double, minlat double, maxlat double, minlon double, maxlon double",
    )
    rows = catalog.mall_of(places, malls, "source_id").collect()
    assert {tuple(r) for r in rows} == {(f"p{i}", "m10", "containment") for i in range(30)} and len(rows) == 30
    assert met == [(2, 1), (2, 1)]
