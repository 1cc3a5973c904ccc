"""Tables that are small on disk and large in memory are not broadcast."""

from tripweave.operators import catalog, spatial


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_repeated_sites_are_not_broadcast(spark):
    points = spark.createDataFrame([(1.3, 103.8), (1.31, 103.9)], "lat double, lon double")
    sites = spark.createDataFrame([("a", 1.3, 103.81), ("b", 1.31, 103.9)], "site_id string, lat double, lon double")
    near = spatial.nearest(points, sites)
    assert "BroadcastHashJoin [level" not in plan_of(near) and {(r.lat, r.site_id) for r in near.collect()} == {(1.3, "a"), (1.31, "b")}


def test_names_and_ids_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"i{i}", "s", "Shop", ["North"]) for i in range(4)], "id string, scope string, base string, qualifiers array<string>")
    named = catalog.unique_names(rows)
    assert "BroadcastHashJoin" not in plan_of(named)
    assert sorted(r.name for r in named.collect()) == ["Shop", "Shop (North)", "Shop (North) 2", "Shop (North) 3"]


def test_searched_sites_are_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tripweave.functions import geo
    from tripweave.operators import foci

    plans, store = [], foci.store
    monkeypatch.setattr(foci, "store", lambda frame, name: plans.append(plan_of(frame)) or store(frame, name))
    needs = spark.createDataFrame([(1, "a", 1.3, 103.8, 1.32, 103.9)], "id long, key string, o_lat double, o_lon double, d_lat double, d_lon double").withColumn("base_km", geo.haversine_km("o_lat", "o_lon", "d_lat", "d_lon"))
    sites = spark.createDataFrame([(7, "a", 1.31, 103.85), (8, "a", 1.4, 103.7), (9, "b", 1.31, 103.85)], "hub_id long, key string, lat double, lon double")
    chord = F.greatest(F.lit(0.0), geo.haversine_km("o_lat", "o_lon", "lat", "lon") + geo.haversine_km("lat", "lon", "d_lat", "d_lon") - F.col("base_km"))
    found = foci.least_detour(needs, sites, ["id"], ["key"], 1, chord, [F.col("hub_id")], ["hub_id"])
    assert [r.hub_id for r in found.collect()] == [7]
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans[1:])


def test_pieces_of_names_are_not_broadcast(spark):
    from tripweave.operators import search

    queries = spark.createDataFrame([("red bolt",), ("redbolt7",)], "q string")
    hubs = spark.createDataFrame([(1, "Red Bolt 7", "unknown"), (2, "Blue Nut", "unknown")], "hub_id long, name string, closure_status string")
    found = search.hub_search(queries, hubs)
    assert "BroadcastHashJoin [_gram" not in plan_of(found)
    assert sorted((r.q, r.hub_id) for r in found.collect()) == [("red bolt", 1), ("redbolt7", 1)]
