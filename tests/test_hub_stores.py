"""Hubs with their stores: every left join of the method, and none of them loses a store."""

from tripweave.operators import catalog
from tripweave.queries import QUERIES


def test_stores_carry_logo_and_hubs_their_mall(spark):
    hubs = [(1, "Mall", 1.3, 103.8, "mall", "unknown", "curated", None), (2, "Shop", 1.3005, 103.8, "standalone", "unknown", "curated", "1 Road"), (3, "Far", 1.4, 103.9, "standalone", "unknown", "curated", None)]
    hubs = spark.createDataFrame(hubs, "hub_id long, name string, lat double, lon double, semantic_type string, closure_status string, source string, address string")
    outlets = [(10, 1, 0, 5, "unknown", None, "Q5"), (20, 2, 0, 5, "unknown", "24/7", "Q5"), (21, 2, 99, None, "unknown", None, None), (22, 2, 0, 6, "closed", None, "Q6"), (30, 3, 0, 6, "unknown", None, "Q6")]
    outlets = spark.createDataFrame(outlets, "outlet_id long, hub_id long, category_idx long, brand_idx long, closure_status string, opening_hours string, brand_key string")
    brands = spark.createDataFrame([(5, "Five"), (6, "Six")], "brand_idx long, brand_name string")
    categories = spark.createDataFrame([(0, "groceries")], "category_idx long, slug string")
    nodes = spark.createDataFrame([("n", "Stop", 1.3, 103.8)], "node_id string, name string, lat double, lon double")
    facts = spark.createDataFrame([(1, "n", 0.0), (2, "n", 55.6), (3, "n", 15000.0)], "hub_id long, nearest_node string, node_m double")
    logos = spark.createDataFrame([("Q5", "five.png"), ("Q6", None)], "brand_key string, url string")
    rows = {r.hub_id: r for r in catalog.hub_stores(hubs, outlets, brands, categories, facts, nodes, logos).collect()}
    assert set(rows) == {1, 2, 3}
    assert [(s.outlet_id, s.category, s.brand_name, s.logo_url) for s in rows[2].stores] == [(20, "groceries", "Five", "five.png"), (21, None, None, None)]
    assert [s.logo_url for s in rows[3].stores] == [None]
    assert rows[2].nearby_mall == "Mall" and rows[1].nearby_mall is None and rows[3].nearby_mall is None
    assert (rows[2].node_name, rows[3].node_name) == ("Stop", None)


def test_query_finds_logos(spark):
    rows = QUERIES["join_hub_stores"](spark, "/root/testdata/sf0.1")
    assert rows.selectExpr("exists(stores, s -> s.logo_url IS NOT NULL) AS marked").filter("marked").count() > 0
