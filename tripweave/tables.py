"""The given tables read as trips, places, timetables and events.

Each binding is one SQL statement, the same text for Spark and for the checking
engine: integer modulus and double literals only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

BINDINGS = {
    "b_category": """
SELECT * FROM (VALUES
 (0,'groceries','retail',20e0),(1,'pharmacy','retail',10e0),(2,'parcel','services',8e0),
 (3,'electronics','retail',15e0),(4,'banking','services',15e0),(5,'fast_food','food_drink',15e0),
 (6,'fried_chicken','fast_food',15e0),(7,'bubble_tea','food_drink',8e0),(8,'coffee','food_drink',12e0),
 (9,'convenience','retail',5e0),(10,'restaurants','food_drink',30e0),(11,'burgers','food_drink',20e0),
 (12,'japanese_food','food_drink',30e0),(13,'korean_food','food_drink',30e0),(14,'chinese_food','food_drink',30e0),
 (15,'bakeries','food_drink',8e0),(16,'dessert','food_drink',12e0),(17,'stationery','retail',10e0),
 (18,'hardware','retail',15e0),(19,'florists','retail',10e0),(20,'pet_supplies','retail',15e0),
 (21,'clothing','retail',20e0),(22,'household','retail',20e0),(23,'printing','services',10e0),
 (24,'haircuts','services',30e0),(25,'optical','services',20e0),(26,'repairs','services',20e0),
 (27,'food_drink',NULL,0e0),(28,'retail',NULL,0e0),(29,'services',NULL,0e0)
) AS t(category_idx, slug, parent_slug, dwell_minutes)
""",
    "b_hub": """
SELECT p_partkey AS hub_id,
       p_name || ' ' || CAST(p_partkey % 97 AS STRING) AS name,
       1.22e0 + ((p_partkey * 7919) % 2500) / 1e4 AS lat,
       103.62e0 + ((p_partkey * 104729) % 4600) / 1e4 AS lon,
       CASE WHEN p_partkey % 20 = 0 THEN 'mall' WHEN p_partkey % 9 = 0 THEN 'station_area'
            ELSE 'standalone' END AS semantic_type,
       CASE WHEN p_partkey % 50 = 49 THEN 'closed' ELSE 'unknown' END AS closure_status,
       CASE WHEN p_partkey % 5 = 0 THEN 'curated' ELSE 'openstreetmap' END AS source,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) || ' ' || p_type || ' Road, Singapore '
            || LPAD(CAST((p_partkey * 37) % 820000 + 10000 AS STRING), 6, '0') END AS address
FROM part
""",
    "b_outlet": """
SELECT l_partkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS outlet_id, l_partkey AS hub_id,
       (MIN(l_suppkey) * 31 + l_partkey * 7) % 27 AS category_idx,
       CASE WHEN MIN(l_suppkey) % 3 = 0 THEN MIN(l_suppkey) % 21 END AS brand_idx,
       CASE WHEN MIN(l_suppkey) % 20 = 7 THEN 'closed' ELSE 'unknown' END AS closure_status,
       CASE (l_partkey + MIN(l_suppkey)) % 7 WHEN 0 THEN '24/7' WHEN 1 THEN 'Mo-Fr 09:00-22:00'
            WHEN 2 THEN 'Mo-Sa 08:00-20:00; Su off' WHEN 3 THEN '22:00-02:00'
            WHEN 4 THEN 'PH off' WHEN 5 THEN '09:00-22:00; Su off' END AS opening_hours
FROM lineitem
GROUP BY l_partkey, l_returnflag
""",
    "b_station": """
SELECT n_nationkey AS station_id, 'L' || CAST(n_regionkey AS STRING) AS line,
       ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ordinal, n_name AS name,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 3 THEN 'centre' END AS interchange,
       1.24e0 + n_regionkey * 0.04e0 + (n_nationkey % 5) * 0.005e0 AS lat,
       103.66e0 + ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) * 0.06e0 AS lon
FROM nation
""",
    "b_node": """
SELECT 'rail:' || CAST(n_nationkey AS STRING) AS node_id, n_name AS name, 'station' AS node_type,
       1.24e0 + n_regionkey * 0.04e0 + (n_nationkey % 5) * 0.005e0 AS lat,
       103.66e0 + ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) * 0.06e0 AS lon
FROM nation
UNION ALL
SELECT 'bus:' || CAST(s_suppkey AS STRING), 'Opp ' || s_name, 'bus_stop',
       1.22e0 + ((s_suppkey * 6113) % 2500) / 1e4, 103.62e0 + ((s_suppkey * 3571) % 4600) / 1e4
FROM supplier
""",
    "b_trip": """
SELECT o_orderkey AS trip_id, o_orderdate AS departure, (o_orderkey * 37 + o_custkey * 11) % 1440 AS departure_minute,
       1.22e0 + ((o_custkey * 4871) % 2500) / 1e4 AS o_lat,
       103.62e0 + ((o_custkey * 9973) % 4600) / 1e4 AS o_lon,
       1.22e0 + ((o_custkey * 13 + o_orderkey * 7) % 2500) / 1e4 AS d_lat,
       103.62e0 + ((o_custkey * 17 + o_orderkey * 29) % 4600) / 1e4 AS d_lon,
       o_orderkey % 27 AS category_1,
       CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 11) % 27 END AS category_2,
       CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 21 END AS exact_brand_idx,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 21 END AS preferred_brand_idx,
       CASE WHEN o_orderkey % 5 = 0 THEN 20e0 END AS max_detour_minutes,
       o_orderkey % 10 = 0 AS max_detour_is_hard,
       CASE o_orderkey % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'low' WHEN 2 THEN 'standard' ELSE 'high' END AS walking_tolerance,
       CASE o_orderkey % 3 WHEN 0 THEN 'no_extra' WHEN 1 THEN 'prefer_fewer' ELSE 'standard' END AS transfer_tolerance
FROM orders
""",
    "b_request": """
SELECT o_orderkey AS request_id,
       CASE o_orderkey % 6 WHEN 0 THEN p_name
            WHEN 1 THEN 'need to grab ' || p_name || ' and some groceries'
            WHEN 2 THEN 'please find ' || p_name || ', must be KFC, under 15 minutes max'
            WHEN 3 THEN 'coffee if convenient and ' || p_name || ', do not want to walk much'
            WHEN 4 THEN 'bubble tea then pharmacy, no extra transfer, go home to ' || n_name
            ELSE 'hello' END AS text
FROM orders JOIN part ON p_partkey = CAST(FLOOR(o_orderkey * 2e0 / 15e0) AS BIGINT) JOIN nation ON n_nationkey = o_orderkey % 25
""",
    "b_event": """
SELECT event_id, ts AS occurred_at, user_id, user_id * 20 + event_id % 20 AS search_id,
       CASE event_type WHEN 'signup' THEN 'search_started' WHEN 'view' THEN 'optimization_completed'
            WHEN 'click' THEN 'recommendation_selected' WHEN 'purchase' THEN 'navigation_clicked'
            ELSE CASE event_id % 3 WHEN 0 THEN 'no_convenient_option' WHEN 1 THEN 'feedback_submitted'
                 ELSE 'alternative_selected' END END AS event_type,
       1 + event_id % 3 AS recommendation_rank, value AS latency_ms,
       CASE event_id % 2 WHEN 0 THEN 'positive' ELSE 'negative' END AS feedback_value,
       CASE WHEN event_id % 2 = 1 THEN CASE event_id % 3 WHEN 0 THEN 'too_much_walking'
            WHEN 1 THEN 'shop_closed' ELSE 'other' END END AS feedback_reason
FROM events
""",
    "b_bus_route": """
SELECT CAST(l_partkey % 150 AS STRING) AS service_no, 1 + l_linenumber % 2 AS direction,
       l_suppkey AS stop_sequence, LPAD(CAST(10000 + l_suppkey AS STRING), 5, '0') AS stop_code,
       l_orderkey * 10 + l_linenumber AS capture_seq, l_quantity AS distance_km,
       CASE l_orderkey % 5 WHEN 0 THEN '0530' WHEN 1 THEN '2025' WHEN 2 THEN '0600' WHEN 3 THEN '1427' ELSE '-' END AS wd_first,
       CASE l_orderkey % 5 WHEN 0 THEN '0015' WHEN 1 THEN '2352' WHEN 2 THEN '2400' WHEN 3 THEN '2349' ELSE '' END AS wd_last,
       CASE l_orderkey % 4 WHEN 0 THEN '0530' WHEN 1 THEN '0620' ELSE '-' END AS sat_first,
       CASE l_orderkey % 4 WHEN 0 THEN '0015' WHEN 1 THEN '2349' ELSE '' END AS sat_last,
       CASE l_orderkey % 3 WHEN 0 THEN '0620' ELSE '-' END AS sun_first,
       CASE l_orderkey % 3 WHEN 0 THEN '2349' ELSE '2561' END AS sun_last
FROM lineitem
""",
    "b_arrival": """
SELECT event_id, ts AS observed_at, LPAD(CAST(10000 + event_id % 10 AS STRING), 5, '0') AS stop_code,
       CAST(user_id % 150 AS STRING) AS service_no, 1 + event_id % 3 AS slot,
       CAST(FLOOR(value * 3) AS BIGINT) AS eta_seconds, event_id % 2 = 0 AS live,
       CASE event_id % 4 WHEN 0 THEN 'SEA' WHEN 1 THEN 'SDA' WHEN 2 THEN 'LSD' END AS load
FROM events
""",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One binding as a DataFrame; only the tables it names are read."""
    text = BINDINGS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for table in used:
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **{t: given(spark, sf_dir, t) for t in used})
