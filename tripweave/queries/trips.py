"""Trip queries: network, corridor, options, evaluation and ranking."""

from pyspark.sql import functions as F

from .. import params
from ..functions import geo
from ..operators import candidates, evaluate, network, rank, routes, spatial
from ..plans.trips import TripPlan
from .registry import define, query


def H(a, b, c, d):
    """Great-circle km in SQL."""
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(12742e0*atan2(sqrt({h}),sqrt(1-{h})))"


def S(p, q, a, b, c, d):
    """Point to segment km in SQL."""
    w = f"(111.32e0*cos(radians(({a}+{c}+{p})/3)))"
    px, py = f"(({q}-{b})*{w})", f"(({p}-{a})*110.57e0)"
    dx, dy = f"(({d}-{b})*{w})", f"(({c}-{a})*110.57e0)"
    t = f"(CASE WHEN {dx}*{dx}+{dy}*{dy}>0 THEN GREATEST(0e0,LEAST(1e0,({px}*{dx}+{py}*{dy})/({dx}*{dx}+{dy}*{dy}))) ELSE 0e0 END)"
    return f"sqrt(pow({px}-{t}*{dx},2)+pow({py}-{t}*{dy},2))"


def trip_table(g):
    """The trips binding in the planner's columns."""
    no_more = F.col("transfer_tolerance") == "no_extra"
    return g.trip.select(
        "trip_id", (F.col("departure").cast("timestamp") + F.make_dt_interval(mins=F.col("departure_minute").cast("int"))).alias("departure"), "o_lat", "o_lon", "d_lat", "d_lon", "category_1", "category_2",
        F.col("exact_brand_idx").alias("exact_brand_1"), F.lit(None).cast("bigint").alias("exact_brand_2"),
        F.when(F.col("preferred_brand_idx").isNotNull(), F.col("category_1")).alias("preferred_category"),
        F.col("preferred_brand_idx").alias("preferred_brand"), "max_detour_minutes", "max_detour_is_hard",
        F.lit(None).cast("double").alias("max_walk_minutes"), F.lit(False).alias("max_walk_is_hard"),
        F.when(no_more, 0).alias("max_transfers"), no_more.alias("max_transfers_is_hard"), "walking_tolerance", "transfer_tolerance",
        F.lit("normal").alias("urgency"), F.lit(False).alias("prefer_consolidated"), F.lit(None).cast("timestamp").alias("arrive_by"),
    )


def plan(g) -> TripPlan:
    if "trip plan" not in g._made:
        g._made["trip plan"] = TripPlan(g.spark, trip_table(g), g.hub, g.outlet, g.node, g.station, g.category)
    return g._made["trip plan"]


_subs = ",".join(f"({params.CATEGORY_INDEX[a]},{params.CATEGORY_INDEX[b]})" for a, b in params.SUBSTITUTES)
RANK = "-coverage, kind, chord_km, COALESCE(node_m, 99999e0), hub_id"
define(
    x_closure="""SELECT category_idx AS ancestor, category_idx AS category FROM b_category
 UNION SELECT p.category_idx, c.category_idx FROM b_category p JOIN b_category c ON c.parent_slug=p.slug
 UNION SELECT p.category_idx, k.category_idx FROM b_category p JOIN b_category c ON c.parent_slug=p.slug JOIN b_category k ON k.parent_slug=c.slug""",
    x_open_outlet="SELECT * FROM b_outlet WHERE closure_status<>'closed'",
    x_hubcat="""SELECT DISTINCT h.hub_id, o.category_idx AS category FROM b_hub h JOIN x_open_outlet o ON o.hub_id=h.hub_id WHERE h.closure_status<>'closed'""",
    x_hubbrand="SELECT DISTINCT hub_id, category_idx AS category, brand_idx AS brand FROM x_open_outlet WHERE brand_idx IS NOT NULL",
    x_nearest=f"""SELECT hub_id, node_id AS nearest_node, ROUND(m,1) AS node_m FROM (SELECT h.hub_id, n.node_id, {H('h.lat','h.lon','n.lat','n.lon')}*1000 AS m,
 ROW_NUMBER() OVER (PARTITION BY h.hub_id ORDER BY {H('h.lat','h.lon','n.lat','n.lon')}, n.node_id) AS rn FROM b_hub h, b_node n) t WHERE rn=1""",
    x_fact="""SELECT h.hub_id, h.name, h.lat, h.lon, h.semantic_type, CASE WHEN h.semantic_type IN ('mall','station_area') THEN 0 ELSE 1 END AS kind,
 n.nearest_node, n.node_m FROM b_hub h JOIN x_nearest n ON n.hub_id=h.hub_id WHERE h.closure_status<>'closed' AND h.hub_id IN (SELECT hub_id FROM x_open_outlet)""",
    x_edge1=f"""SELECT a, b, {H('la','lo','lb','lp')}*1.15e0/40*60+0.5e0 AS minutes, FALSE AS is_transfer FROM (
 SELECT station_id AS a, lat AS la, lon AS lo, LEAD(station_id) OVER w AS b, LEAD(lat) OVER w AS lb, LEAD(lon) OVER w AS lp FROM b_station WINDOW w AS (PARTITION BY line ORDER BY ordinal)) e WHERE b IS NOT NULL
 UNION ALL SELECT x.station_id, y.station_id, 4e0, TRUE FROM b_station x JOIN b_station y ON x.interchange=y.interchange AND x.station_id<y.station_id""",
    x_edge="SELECT a, b, minutes, is_transfer FROM x_edge1 UNION ALL SELECT b, a, minutes, is_transfer FROM x_edge1",
    x_walk="""SELECT station_id AS s, station_id AS t, 0e0 AS minutes, [station_id] AS path FROM b_station
 UNION ALL SELECT w.s, e.b, w.minutes+e.minutes, list_append(w.path, e.b) FROM x_walk w JOIN x_edge e ON e.a=w.t WHERE NOT list_contains(w.path, e.b)""",
    x_matrix="SELECT s, t, MIN(minutes) AS minutes, arg_min(path, minutes) AS path FROM x_walk GROUP BY s, t",
    x_hop="""SELECT s, t, i, path[i] AS a, path[i+1] AS b FROM (SELECT s, t, path, UNNEST(range(1, len(path))) AS i FROM x_matrix) p""",
    x_hop_line="""SELECT h.s, h.t, h.i, h.a, h.b, e.minutes, e.is_transfer, p.line AS a_line, q.line AS b_line, SUM(CASE WHEN e.is_transfer THEN 1 ELSE 0 END) OVER (PARTITION BY h.s, h.t ORDER BY h.i) AS part
 FROM x_hop h JOIN x_edge e ON e.a=h.a AND e.b=h.b JOIN b_station p ON p.station_id=h.a JOIN b_station q ON q.station_id=h.b""",
    x_ride="""SELECT s, t, ROW_NUMBER() OVER (PARTITION BY s, t ORDER BY MIN(i)) AS ride, MAX(b_line) AS service, SUM(minutes) AS minutes, COUNT(*) AS stops, arg_min(a, i) AS first_station, arg_max(b, i) AS last_station
 FROM x_hop_line WHERE NOT is_transfer GROUP BY s, t, part""",
    x_plan="""SELECT s, t, arg_min(first_station, ride) AS first_station, arg_max(last_station, ride) AS last_station, SUM(minutes) AS ride_minutes, COUNT(*) AS n_rides FROM x_ride GROUP BY s, t""",
    x_plan_at="""SELECT p.*, f.lat AS f_lat, f.lon AS f_lon, l.lat AS l_lat, l.lon AS l_lon FROM x_plan p JOIN b_station f ON f.station_id=p.first_station JOIN b_station l ON l.station_id=p.last_station""",
    x_line_point="""SELECT p.s, p.t, 0 AS i, f.lat, f.lon FROM x_plan p JOIN b_station f ON f.station_id=p.first_station
 UNION ALL SELECT h.s, h.t, h.i, q.lat, q.lon FROM x_hop_line h JOIN b_station q ON q.station_id=h.b WHERE NOT h.is_transfer""",
    x_line_segment="""SELECT s, t, lat AS a_lat, lon AS a_lon, b_lat, b_lon FROM (SELECT *, LEAD(lat) OVER w AS b_lat, LEAD(lon) OVER w AS b_lon FROM x_line_point WINDOW w AS (PARTITION BY s, t ORDER BY i)) z WHERE b_lat IS NOT NULL""",
    x_spot="SELECT o_lat AS lat, o_lon AS lon FROM b_trip UNION SELECT d_lat, d_lon FROM b_trip UNION SELECT lat, lon FROM x_fact",
    x_choice=f"""SELECT lat, lon, station_id, km, CASE WHEN GREATEST(km,0.12e0)<=1.1e0 THEN GREATEST(km,0.12e0)*1000*1.25e0/78 ELSE 4+GREATEST(km,0.12e0)*1.3e0/18*60 END AS minutes FROM (
 SELECT p.lat, p.lon, s.station_id, {H('p.lat','p.lon','s.lat','s.lon')} AS km, ROW_NUMBER() OVER (PARTITION BY p.lat, p.lon ORDER BY {H('p.lat','p.lon','s.lat','s.lon')}, s.station_id) AS rn FROM x_spot p, b_station s) c WHERE rn<=4""",
)


def price_sql(pairs: str) -> str:
    """Price of distinct pairs (a_lat, a_lon, b_lat, b_lon) of ``pairs``."""
    access = "(CASE WHEN {k}<=1.1e0 THEN {k}*1000*1.25e0/78 ELSE 4+{k}*1.3e0/18*60 END)"
    on, off = access.format(k="on_km"), access.format(k="off_km")
    return f"""SELECT a_lat, a_lon, b_lat, b_lon, alone AS walk_only, CASE WHEN NOT alone THEN s END AS s, CASE WHEN NOT alone THEN t END AS t,
 f_lat, f_lon, l_lat, l_lon,
 ROUND(CASE WHEN alone THEN GREATEST(km*1250,1)/78 ELSE {on}+3+ride_minutes+4*(n_rides-1)+CASE WHEN off_km>1.1e0 THEN 3 ELSE 0 END+{off} END,2) AS minutes,
 ROUND(CASE WHEN alone THEN GREATEST(km*1250,1)/78 ELSE (CASE WHEN on_km>1.1e0 THEN 0 ELSE ROUND({on},2) END)+(CASE WHEN off_km>1.1e0 THEN 0 ELSE ROUND({off},2) END) END,2) AS walk_minutes,
 ROUND(CASE WHEN alone THEN GREATEST(km*1250,1) ELSE (CASE WHEN on_km>1.1e0 THEN 0 ELSE ROUND(on_km*1250,1) END)+(CASE WHEN off_km>1.1e0 THEN 0 ELSE ROUND(off_km*1250,1) END) END,1) AS walk_m,
 CAST(CASE WHEN alone THEN 0 ELSE n_rides-1+CASE WHEN on_km>1.1e0 THEN 1 ELSE 0 END+CASE WHEN off_km>1.1e0 THEN 1 ELSE 0 END END AS BIGINT) AS transfers
 FROM (SELECT k.*, p.ride_minutes, p.n_rides, p.f_lat, p.f_lon, p.l_lat, p.l_lon, {H('a_lat','a_lon','b_lat','b_lon')} AS km, {H('a_lat','a_lon','b_lat','b_lon')}<=1 OR p.n_rides IS NULL AS alone,
  GREATEST(0.12e0,{H('a_lat','a_lon','p.f_lat','p.f_lon')}) AS on_km, GREATEST(0.12e0,{H('p.l_lat','p.l_lon','b_lat','b_lon')}) AS off_km
  FROM (SELECT a_lat, a_lon, b_lat, b_lon, s, t FROM (SELECT q.a_lat, q.a_lon, q.b_lat, q.b_lon, m.s, m.t,
    ROW_NUMBER() OVER (PARTITION BY q.a_lat, q.a_lon, q.b_lat, q.b_lon ORDER BY ROUND(x.minutes+3+m.minutes+y.minutes,9), m.s, m.t) AS rn
    FROM {pairs} q LEFT JOIN x_choice x ON x.lat=q.a_lat AND x.lon=q.a_lon LEFT JOIN x_choice y ON y.lat=q.b_lat AND y.lon=q.b_lon LEFT JOIN x_matrix m ON m.s=x.station_id AND m.t=y.station_id) r WHERE rn=1) k
  LEFT JOIN x_plan_at p ON p.s=k.s AND p.t=k.t) z"""


define(
    x_direct_pair="SELECT DISTINCT o_lat AS a_lat, o_lon AS a_lon, d_lat AS b_lat, d_lon AS b_lon FROM b_trip",
    x_direct_price=price_sql("x_direct_pair"),
    x_route_of=f"""SELECT b.trip_id, o_lat, o_lon, d_lat, d_lon, p.s, p.t, walk_only, p.f_lat, p.f_lon, p.l_lat, p.l_lon, minutes AS base_minutes, walk_minutes AS base_walk_minutes, walk_m AS base_walk_m, transfers AS base_transfers,
 {H('o_lat','o_lon','d_lat','d_lon')} AS base_km FROM b_trip b JOIN x_direct_price p ON p.a_lat=o_lat AND p.a_lon=o_lon AND p.b_lat=d_lat AND p.b_lon=d_lon""",
    x_sub=f"SELECT * FROM (VALUES {_subs}) AS t(category, substitute)",
    x_variant="""SELECT trip_id, 1 AS search_no, substitute AS c1, category_2 AS c2, CAST(NULL AS BIGINT) AS brand1, 'easier_alternative' AS match_class FROM b_trip JOIN x_sub ON category=category_1 WHERE exact_brand_idx IS NULL
 UNION ALL SELECT trip_id, 2, category_1, substitute, exact_brand_idx, 'easier_alternative' FROM b_trip JOIN x_sub ON category=category_2
 UNION ALL SELECT trip_id, 3, category_1, NULL, exact_brand_idx, 'partial_option' FROM b_trip WHERE category_2 IS NOT NULL
 UNION ALL SELECT trip_id, 4, category_2, NULL, NULL, 'partial_option' FROM b_trip WHERE category_2 IS NOT NULL""",
    x_search="""SELECT z.trip_id*8+z.search_no AS sid, z.*, r.* EXCLUDE (trip_id) FROM (
 SELECT trip_id, 0 AS search_no, category_1 AS c1, category_2 AS c2, exact_brand_idx AS brand1, 'best_match' AS match_class, CASE WHEN trip_id IN (SELECT trip_id FROM x_variant) THEN 4 ELSE 6 END AS max_candidates FROM b_trip
 UNION ALL SELECT *, 1 FROM x_variant) z JOIN x_route_of r ON r.trip_id=z.trip_id""",
    x_cat_hub="""SELECT DISTINCT s.sid, s.trip_id, h.hub_id FROM x_search s JOIN x_closure c ON c.ancestor=s.c1 OR c.ancestor=s.c2 JOIN x_hubcat h ON h.category=c.category""",
    x_trip_hub="SELECT DISTINCT trip_id, hub_id FROM x_cat_hub",
    x_trip_segment="""SELECT trip_id, o_lat AS a_lat, o_lon AS a_lon, COALESCE(CASE WHEN walk_only THEN NULL ELSE f_lat END, d_lat) AS b_lat, COALESCE(CASE WHEN walk_only THEN NULL ELSE f_lon END, d_lon) AS b_lon FROM x_route_of
 UNION ALL SELECT trip_id, l_lat, l_lon, d_lat, d_lon FROM x_route_of WHERE NOT walk_only
 UNION ALL SELECT trip_id, g.a_lat, g.a_lon, g.b_lat, g.b_lon FROM x_route_of r JOIN x_line_segment g ON g.s=r.s AND g.t=r.t WHERE NOT walk_only""",
    x_line_km=f"""SELECT x.trip_id, x.hub_id, MIN({S('h.lat','h.lon','g.a_lat','g.a_lon','g.b_lat','g.b_lon')}) AS line_km FROM x_trip_hub x JOIN x_fact h ON h.hub_id=x.hub_id JOIN x_trip_segment g ON g.trip_id=x.trip_id GROUP BY x.trip_id, x.hub_id""",
    x_meet=f"""SELECT s.sid, s.trip_id, s.c1, s.c2, s.brand1, s.max_candidates, h.hub_id, h.lat, h.lon, h.kind, h.node_m, l.line_km, s.base_km,
 {H('s.o_lat','s.o_lon','h.lat','h.lon')} AS from_o, {H('h.lat','h.lon','s.d_lat','s.d_lon')} AS to_d,
 k1.hub_id IS NOT NULL AS has1, k2.hub_id IS NOT NULL AS has2
 FROM x_cat_hub x JOIN x_search s ON s.sid=x.sid JOIN x_fact h ON h.hub_id=x.hub_id JOIN x_line_km l ON l.trip_id=x.trip_id AND l.hub_id=x.hub_id
 LEFT JOIN x_hubcat k1 ON k1.hub_id=h.hub_id AND k1.category=s.c1 LEFT JOIN x_hubcat k2 ON k2.hub_id=h.hub_id AND k2.category=s.c2""",
    x_ranked="""SELECT *, CAST(has1 AS INTEGER)+CAST(has2 AS INTEGER) AS coverage, GREATEST(0, from_o+to_d-base_km) AS chord_km,
 line_km<=2.5 OR LEAST(from_o,to_d)<=2 AS inside, kind=0 OR COALESCE(node_m<=1200,FALSE) OR LEAST(from_o,to_d)<=2 AS transit FROM x_meet""",
    x_corridor=f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, {RANK}) AS rn, bool_or(inside) OVER (PARTITION BY sid) AS any_inside FROM x_ranked) r
 WHERE inside OR (NOT any_inside AND rn<=GREATEST(3*max_candidates,8))""",
    x_transit="SELECT * EXCLUDE (rn) FROM (SELECT *, bool_or(transit) OVER (PARTITION BY sid) AS any_transit FROM x_corridor) r WHERE transit OR NOT any_transit",
    x_best1=f"""SELECT sid, hub_id FROM (SELECT sid, hub_id, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY {RANK}) AS rn FROM x_ranked WHERE has1 AND sid NOT IN (SELECT sid FROM x_transit WHERE has1)) r WHERE rn<=2""",
    x_served1="SELECT sid, hub_id FROM x_transit UNION SELECT sid, hub_id FROM x_best1",
    x_served2="SELECT DISTINCT v.sid FROM x_served1 v JOIN x_ranked r ON r.sid=v.sid AND r.hub_id=v.hub_id WHERE r.has2",
    x_best2=f"""SELECT sid, hub_id FROM (SELECT sid, hub_id, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY {RANK}) AS rn FROM x_ranked WHERE has2 AND sid NOT IN (SELECT sid FROM x_served2)) r WHERE rn<=2""",
    x_rescued="SELECT r.* FROM x_ranked r JOIN (SELECT * FROM x_served1 UNION SELECT * FROM x_best2) v ON v.sid=r.sid AND v.hub_id=r.hub_id",
    x_listed=f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY {RANK}) AS place, ROW_NUMBER() OVER (PARTITION BY sid, has1 ORDER BY {RANK}) AS r1, ROW_NUMBER() OVER (PARTITION BY sid, has2 ORDER BY {RANK}) AS r2 FROM x_rescued""",
    x_selected="""SELECT * FROM x_listed WHERE CASE WHEN c2 IS NULL THEN has1 AND place<=GREATEST(3*max_candidates,8) ELSE (has1 AND has2) OR (has1 AND r1<=8) OR (has2 AND r2<=8) END""",
    x_sat="""SELECT l.*, l.has1 AND (l.brand1 IS NULL OR b.hub_id IS NOT NULL) AS sat1, l.has2 AS sat2 FROM x_selected l LEFT JOIN x_hubbrand b ON b.hub_id=l.hub_id AND b.category=l.c1 AND b.brand=l.brand1""",
)


def options_sql(source: str) -> str:
    ab = H("a.lat", "a.lon", "b.lat", "b.lon")
    cost = "(2*{p}.line_km+COALESCE({p}.node_m/1000,0))"
    return f"""SELECT sid, hub_id AS stop1, CAST(NULL AS BIGINT) AS stop2, TRUE AS first_low, c2 IS NOT NULL AS consolidated, chord_km, {cost.format(p='q')} AS cost_km, 1 AS n_stops, from_o AS o_reach, to_d AS d_reach,
  lat AS lat1, lon AS lon1, CAST(NULL AS DOUBLE) AS lat2, CAST(NULL AS DOUBLE) AS lon2, max_candidates FROM {source} q WHERE sat1 AND (c2 IS NULL OR sat2)
 UNION ALL SELECT a.sid, LEAST(a.hub_id,b.hub_id), GREATEST(a.hub_id,b.hub_id), a.hub_id<b.hub_id, FALSE, GREATEST(0,LEAST(a.from_o+{ab}+b.to_d, b.from_o+{ab}+a.to_d)-a.base_km), {cost.format(p='a')}+{cost.format(p='b')}, 2,
  GREATEST(a.from_o,b.from_o), GREATEST(a.to_d,b.to_d), CASE WHEN a.hub_id<b.hub_id THEN a.lat ELSE b.lat END, CASE WHEN a.hub_id<b.hub_id THEN a.lon ELSE b.lon END, CASE WHEN a.hub_id<b.hub_id THEN b.lat ELSE a.lat END, CASE WHEN a.hub_id<b.hub_id THEN b.lon ELSE a.lon END, a.max_candidates
  FROM {source} a JOIN {source} b ON a.sid=b.sid AND a.hub_id<>b.hub_id AND a.sat1 AND b.has2 AND b.sat2 AND a.c2 IS NOT NULL AND NOT (a.has2 AND b.has1 AND a.place>b.place)"""


define(
    x_option1=options_sql("x_sat"),
    x_retry=f"""SELECT * FROM (SELECT r.*, r.has1 AND b.hub_id IS NOT NULL AS sat1, r.has2 AS sat2, ROW_NUMBER() OVER (PARTITION BY r.sid ORDER BY {RANK.replace('hub_id','r.hub_id')}) AS place,
  ROW_NUMBER() OVER (PARTITION BY r.sid, r.has1 AND b.hub_id IS NOT NULL ORDER BY {RANK.replace('hub_id','r.hub_id')}) AS q1, ROW_NUMBER() OVER (PARTITION BY r.sid, r.has2 ORDER BY {RANK.replace('hub_id','r.hub_id')}) AS q2
  FROM x_ranked r LEFT JOIN x_hubbrand b ON b.hub_id=r.hub_id AND b.category=r.c1 AND b.brand=r.brand1
  WHERE r.brand1 IS NOT NULL AND r.sid NOT IN (SELECT sid FROM x_option1)) z WHERE (sat1 AND q1<=8) OR (sat2 AND q2<=8)""",
    x_option="SELECT * FROM x_option1 UNION ALL " + options_sql("x_retry"),
    x_pool="""SELECT *, ROUND(cost_km,3) AS cost3 FROM (SELECT *, bool_or(chord_km<=12) OVER (PARTITION BY sid) AS any_capped FROM x_option) c WHERE chord_km<=12 OR NOT any_capped""",
    x_order="""SELECT *, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY cost3, chord_km, n_stops, stop1, COALESCE(stop2,-1)) AS pos,
 o_reach<=1 AND ROW_NUMBER() OVER (PARTITION BY sid ORDER BY CASE WHEN o_reach<=1 THEN 0 ELSE 1 END, n_stops, o_reach, stop1, COALESCE(stop2,-1))=1 AS by_o,
 d_reach<=1 AND ROW_NUMBER() OVER (PARTITION BY sid ORDER BY CASE WHEN d_reach<=1 THEN 0 ELSE 1 END, n_stops, d_reach, stop1, COALESCE(stop2,-1))=1 AS by_d FROM x_pool""",
    x_outside="""SELECT sid, stop1, stop2, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY CASE WHEN by_o THEN 0 ELSE 1 END) AS turn FROM x_order WHERE (by_o OR by_d) AND pos>max_candidates AND max_candidates>=2""",
    x_free="""SELECT sid, pos, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY pos DESC) AS from_end FROM x_order WHERE pos<=max_candidates AND NOT by_o AND NOT by_d""",
    x_slot="SELECT f.sid, f.pos, f.from_end FROM x_free f JOIN (SELECT sid, COUNT(*) AS n FROM x_outside GROUP BY sid) o ON o.sid=f.sid WHERE f.from_end<=o.n",
    x_pruned0="""SELECT o.*, CASE WHEN o.pos<=o.max_candidates THEN o.pos ELSE s.pos END AS position FROM x_order o
 LEFT JOIN x_outside u ON u.sid=o.sid AND u.stop1=o.stop1 AND u.stop2 IS NOT DISTINCT FROM o.stop2 LEFT JOIN x_slot s ON s.sid=o.sid AND s.from_end=u.turn
 LEFT JOIN x_slot gone ON gone.sid=o.sid AND gone.pos=o.pos WHERE (o.pos<=o.max_candidates AND gone.sid IS NULL) OR u.sid IS NOT NULL""",
    x_area="SELECT hub_id, semantic_type, CASE WHEN node_m<=1200 THEN nearest_node END AS area FROM x_fact",
    x_pruned=f"""SELECT p.*, s.trip_id, s.search_no, s.c1, s.c2, s.match_class, CASE WHEN p.consolidated THEN CASE WHEN a.semantic_type='mall' THEN 'same_mall' ELSE 'same_place' END WHEN p.n_stops=1 THEN 'single_stop'
 WHEN a.area=b.area THEN 'same_transport_hub' WHEN {H('p.lat1','p.lon1','p.lat2','p.lon2')}<=0.5 THEN 'nearby_separate_stores' ELSE 'separate_stops' END AS stop_relationship
 FROM x_pruned0 p JOIN x_search s ON s.sid=p.sid JOIN x_area a ON a.hub_id=p.stop1 LEFT JOIN x_area b ON b.hub_id=p.stop2""",
)
MAIN = "WHERE sid % 8 = 0"


def of_trip(rows):
    return rows.filter("sid % 8 = 0").withColumn("trip_id", F.expr("cast(sid / 8 as bigint)"))


@query("join_nearest_node", "SELECT hub_id, CASE WHEN node_m<=1200 THEN nearest_node END AS node_id, node_m FROM x_nearest")
def _(g):
    near = spatial.nearest(g.hub, g.node, "node_id")
    return g.hub.join(near, ["lat", "lon"]).select(
        "hub_id", F.when(F.col("distance_m") <= params.TRANSIT_M, F.col("node_id")).alias("node_id"), F.col("distance_m").alias("node_m")
    )


@query(
    "join_station_area",
    f"""SELECT h.hub_id, MIN({H('h.lat','h.lon','n.lat','n.lon')}*1000)<=150 AS is_station_area FROM b_hub h, b_node n WHERE n.node_type='station' GROUP BY h.hub_id""",
)
def _(g):
    rail = g.node.filter("node_type = 'station'")
    near = spatial.nearest(g.hub, rail, "node_id")
    return g.hub.join(near, ["lat", "lon"]).select("hub_id", (F.col("distance_m") <= params.STATION_AREA_M).alias("is_station_area"))


@query("win_rail_edges", "SELECT a, b, ROUND(minutes,6) AS minutes, is_transfer FROM x_edge")
def _(g):
    return plan(g).edges().withColumn("minutes", F.round("minutes", 6))


@query("graph_station_matrix", "SELECT s, t, ROUND(minutes,6) AS minutes, array_to_string(path,'>') AS path FROM x_matrix")
def _(g):
    return plan(g).matrix().select("s", "t", F.round("minutes", 6).alias("minutes"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("win_rides", "SELECT s, t, ride, service, ROUND(minutes,6) AS minutes, stops, first_station, last_station FROM x_ride")
def _(g):
    return plan(g).rides().select(
        "s", "t", F.row_number().over(rank.Window.partitionBy("s", "t").orderBy("ride")).cast("bigint").alias("ride"), "service",
        F.round("minutes", 6).alias("minutes"), "stops", "first_station", "last_station",
    )


@query("top_k_stations", "SELECT ROUND(lat,6) AS lat, ROUND(lon,6) AS lon, station_id, ROUND(km,6) AS km FROM x_choice")
def _(g):
    ends = g.trip.select(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")).union(g.trip.select("d_lat", "d_lon")).union(plan(g).facts().select("lat", "lon"))
    sites = g.station.select(F.col("station_id").alias("site_id"), "name", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = spatial.k_nearest(ends, sites, params.NEAREST_STATIONS)
    return near.select("lat", "lon", F.explode("near").alias("n")).select(
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("n.site_id").alias("station_id"), F.round("n.km", 6).alias("km")
    )


@query("graph_trip_route", "SELECT trip_id, walk_only, base_minutes, base_walk_minutes, base_walk_m, base_transfers, s, t FROM x_route_of")
def _(g):
    return plan(g).routes().select("trip_id", "walk_only", "base_minutes", "base_walk_minutes", "base_walk_m", "base_transfers", "s", "t")


@query("graph_category_closure", """SELECT c.ancestor, c.category, COUNT(o.outlet_id) AS outlets FROM x_closure c LEFT JOIN b_outlet o ON o.category_idx=c.category GROUP BY c.ancestor, c.category""")
def _(g):
    counts = g.outlet.groupBy(F.col("category_idx").alias("category")).agg(F.count("*").alias("n"))
    return candidates.category_closure(g.category).join(counts, "category", "left").select(
        "ancestor", "category", F.coalesce("n", F.lit(0)).cast("bigint").alias("outlets")
    )


@query("join_hubs_for_categories", f"SELECT trip_id, COUNT(*) AS hubs, MIN(hub_id) AS first_hub, MAX(hub_id) AS last_hub FROM x_cat_hub {MAIN} GROUP BY trip_id")
def _(g):
    # Trips ask for few distinct category pairs, so hubs are counted per pair and joined back. The main
    # search of a trip asks for its own categories; only trips with both ends have a route.
    p = plan(g)
    ends = " AND ".join(f"{c} IS NOT NULL" for c in candidates.ROUTE_FIELDS)
    asked = candidates.searches(p.trips.filter(ends), None).select("trip_id", "c1", "c2")
    pairs = asked.select("c1", "c2").distinct().withColumn("sid", F.monotonically_increasing_id())
    met = candidates.once_per_hub(candidates.expand_categories(pairs, p.closure()).join(p.hub_rows(), "category"))
    per = met.groupBy("c1", "c2").agg(F.count("*").alias("hubs"), F.min("hub_id").alias("first_hub"), F.max("hub_id").alias("last_hub"))
    return asked.join(per, (asked.c1 == per.c1) & asked.c2.eqNullSafe(per.c2)).select("trip_id", "hubs", "first_hub", "last_hub")


@query("join_corridor", f"SELECT trip_id, hub_id, ROUND(MIN(line_km),6) AS line_km FROM x_ranked {MAIN} AND inside GROUP BY trip_id, hub_id")
def _(g):
    p = plan(g)
    rows = candidates.expand_categories(p.searches().filter("sid % 8 = 0"), p.closure())
    met = candidates.once_per_hub(candidates.near_route(rows, p.hub_rows(), p.line_hubs(), ["category"])).filter("inside")
    return met.groupBy("trip_id", "hub_id").agg(F.round(F.min("line_km"), 6).alias("line_km"))


@query("join_corridor_fallback", f"SELECT trip_id, hub_id FROM x_corridor {MAIN} AND NOT any_inside")
def _(g):
    return of_trip(plan(g).far_rows()).select("trip_id", "hub_id").distinct()


@query("join_transit_access", f"SELECT trip_id, COUNT(*) AS hubs, CAST(SUM(hub_id) AS BIGINT) AS hub_sum FROM x_transit {MAIN} GROUP BY trip_id")
def _(g):
    p = plan(g)
    rows = candidates.expand_categories(p.searches().filter("sid % 8 = 0"), p.closure())
    met = candidates.once_per_hub(candidates.near_route(rows, p.hub_rows(), p.line_hubs(), ["category"]))
    met = candidates.flags(met).filter("inside").groupBy("trip_id", "hub_id").agg(F.bool_or("transit").alias("transit"))
    far = of_trip(p.far_rows())
    met = met.unionByName(far.groupBy("trip_id", "hub_id").agg(F.bool_or("transit").alias("transit")))
    sums = met.groupBy("trip_id").agg(
        F.count_if("transit").alias("n"), F.count("*").alias("m"),
        F.sum(F.when(F.col("transit"), F.col("hub_id"))).alias("a"), F.sum("hub_id").alias("b"),
    )
    return sums.select(
        "trip_id", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("m")).alias("hubs"),
        F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b")).alias("hub_sum"),
    )


@query("join_coverage_rescue", "SELECT sid, hub_id FROM x_best1 UNION SELECT sid, hub_id FROM x_best2")
def _(g):
    return plan(g).rescued().select("sid", "hub_id").distinct()


@query("win_hub_coverage_rank", f"SELECT trip_id, hub_id, coverage, ROUND(chord_km,6) AS chord_km FROM x_selected {MAIN}")
def _(g):
    return of_trip(plan(g).shortlist()).select("trip_id", "hub_id", "coverage", F.round("chord_km", 6).alias("chord_km"))


@query("join_single_stop", f"SELECT sid, stop1, ROUND(chord_km,6) AS chord_km FROM x_option1 WHERE n_stops=1 AND NOT consolidated")
def _(g):
    return candidates.options(plan(g).shortlist()).filter("n_stops = 1 AND NOT consolidated").select("sid", "stop1", F.round("chord_km", 6).alias("chord_km"))


@query("join_consolidated", "SELECT sid, stop1, ROUND(cost_km,6) AS cost_km FROM x_option1 WHERE consolidated")
def _(g):
    return candidates.options(plan(g).shortlist()).filter("consolidated").select("sid", "stop1", F.round("cost_km", 6).alias("cost_km"))


@query("join_stop_pairs", "SELECT sid, stop1, stop2, first_low, ROUND(chord_km,6) AS chord_km FROM x_option1 WHERE n_stops=2")
def _(g):
    return candidates.options(plan(g).shortlist()).filter("n_stops = 2").select("sid", "stop1", "stop2", "first_low", F.round("chord_km", 6).alias("chord_km"))


@query("join_exact_brand", "SELECT sid, stop1, stop2 FROM x_option1 WHERE sid IN (SELECT sid FROM x_search WHERE brand1 IS NOT NULL)")
def _(g):
    # searches that ask for a brand keep their whole short list when others are cut
    return candidates.options(plan(g).shortlist(cut=True).filter("brand1 IS NOT NULL")).select("sid", "stop1", "stop2")


@query("join_exact_fallback", "SELECT sid, hub_id, sat1, sat2 FROM x_retry WHERE sid IN (SELECT sid FROM x_retry WHERE sat1)")
def _(g):
    return plan(g).exact_shortlist().select("sid", "hub_id", "sat1", "sat2")


@query("win_prune", "SELECT sid, stop1, stop2, CAST(pos AS INTEGER) AS place FROM x_order WHERE pos<=max_candidates")
def _(g):
    p = plan(g)
    rows = candidates.options(p.shortlist()).unionByName(candidates.options(p.exact_shortlist()))
    return candidates.network_order(candidates.within_cap(rows)).filter("at <= max_candidates").select("sid", "stop1", "stop2", F.col("at").alias("place"))


@query("win_endpoint_reserve", "SELECT sid, stop1, stop2, CAST(position AS INTEGER) AS position FROM x_pruned0")
def _(g):
    return plan(g).pruned().select("sid", "stop1", "stop2", "position")


@query("pipe_candidates", """SELECT sid, stop1, stop2, CAST(position AS INTEGER) AS position, consolidated, ROUND(chord_km,6) AS chord_km, cost3, stop_relationship FROM x_pruned""")
def _(g):
    return plan(g).pruned().select("sid", "stop1", "stop2", "position", "consolidated", F.round("chord_km", 6).alias("chord_km"), "cost3", "stop_relationship")


@query("top_visit_order", f"""SELECT sid, stop1, stop2, {H('s.o_lat','s.o_lon','lat1','lon1')}+{H('lat2','lon2','s.d_lat','s.d_lon')}<={H('s.o_lat','s.o_lon','lat2','lon2')}+{H('lat1','lon1','s.d_lat','s.d_lon')} AS low_first
 FROM x_pruned0 p JOIN x_search s USING (sid) WHERE n_stops=2""")
def _(g):
    from ..functions.geo import haversine_km as km

    low = km("o_lat", "o_lon", "lat1", "lon1") + km("lat2", "lon2", "d_lat", "d_lon")
    high = km("o_lat", "o_lon", "lat2", "lon2") + km("lat1", "lon1", "d_lat", "d_lon")
    return plan(g).pruned().filter("n_stops = 2").select("sid", "stop1", "stop2", (low <= high).alias("low_first"))


@query(
    "join_near_miss",
    f"""SELECT trip_id, asked, substitute, hub_id, ROUND(km,6) AS chord_km FROM (SELECT r.trip_id, x.category AS asked, x.substitute, h.hub_id, ROUND(GREATEST(0,{H('r.o_lat','r.o_lon','f.lat','f.lon')}+{H('f.lat','f.lon','r.d_lat','r.d_lon')}-r.base_km),9) AS km,
 ROW_NUMBER() OVER (PARTITION BY r.trip_id, x.category, x.substitute ORDER BY ROUND(GREATEST(0,{H('r.o_lat','r.o_lon','f.lat','f.lon')}+{H('f.lat','f.lon','r.d_lat','r.d_lon')}-r.base_km),9), h.hub_id) AS rn
 FROM b_trip t JOIN x_route_of r ON r.trip_id=t.trip_id JOIN x_sub x ON x.category=t.category_1 OR x.category=t.category_2 JOIN x_closure c ON c.ancestor=x.substitute JOIN x_hubcat h ON h.category=c.category JOIN x_fact f ON f.hub_id=h.hub_id) z WHERE rn=1""",
)
def _(g):
    p = plan(g)
    needs = g.trip.select("trip_id", F.explode(F.array_compact(F.array("category_1", "category_2"))).alias("asked")).join(p.routes(), "trip_id")
    return candidates.near_misses(needs, p.hub_rows(), p.substitutes(), p.closure()).withColumn("chord_km", F.round("chord_km", 6)).select("trip_id", F.col("asked").cast("int").alias("asked"), F.col("substitute").cast("int").alias("substitute"), "hub_id", "chord_km")


@query("win_budget_admission", "SELECT trip_id, sid, stop1, stop2, CAST(position AS INTEGER) AS position FROM x_admitted")
def _(g):
    return plan(g).admitted().select("trip_id", "sid", "stop1", "stop2", "position")


# Admission, folded per trip in list order, as a recursion over the list.
QUALITY = """CASE WHEN h.address IS NOT NULL AND h.address<>'' THEN 1e0 WHEN h.semantic_type='mall' THEN 0.95e0 WHEN h.semantic_type='station_area' AND f.node_m<=1200 THEN 0.88e0
 WHEN m.hub_id IS NOT NULL THEN 0.82e0 WHEN f.node_m<=1200 THEN 0.72e0 ELSE 0.5e0 END"""
define(
    x_admit_list="""SELECT trip_id, sid, stop1, stop2, CASE WHEN n_stops=1 THEN 2 ELSE 6 END AS calls, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY search_no, position) AS i FROM x_pruned""",
    x_admit="""SELECT trip_id, sid, stop1, stop2, i, calls<=19 AS taken, 19-CASE WHEN calls<=19 THEN calls ELSE 0 END AS budget FROM x_admit_list WHERE i=1
 UNION ALL SELECT l.trip_id, l.sid, l.stop1, l.stop2, l.i, l.calls<=a.budget, a.budget-CASE WHEN l.calls<=a.budget THEN l.calls ELSE 0 END FROM x_admit a JOIN x_admit_list l ON l.trip_id=a.trip_id AND l.i=a.i+1""",
    x_admitted="""SELECT p.* FROM x_pruned p JOIN x_admit a ON a.sid=p.sid AND a.stop1=p.stop1 AND a.stop2 IS NOT DISTINCT FROM p.stop2 WHERE a.taken""",
    x_near_mall="""SELECT hub_id, mall_name, m FROM (SELECT h.hub_id, k.name AS mall_name, sqrt(pow((h.lat-k.lat)*110570e0,2)+pow((h.lon-k.lon)*111320e0*cos(radians((h.lat+k.lat)/2)),2)) AS m,
 ROW_NUMBER() OVER (PARTITION BY h.hub_id ORDER BY sqrt(pow((h.lat-k.lat)*110570e0,2)+pow((h.lon-k.lon)*111320e0*cos(radians((h.lat+k.lat)/2)),2)), k.name) AS rn
 FROM b_hub h JOIN b_hub k ON k.semantic_type='mall' AND k.closure_status<>'closed' WHERE h.semantic_type<>'mall') z WHERE rn=1 AND m<=350""",
    x_quality=f"""SELECT h.hub_id, ROUND(LEAST(1e0, {QUALITY} + CASE WHEN h.hub_id IN (SELECT hub_id FROM x_open_outlet WHERE opening_hours IS NOT NULL AND opening_hours<>'') THEN 0.05e0 ELSE 0e0 END),6) AS quality
 FROM b_hub h JOIN x_fact f ON f.hub_id=h.hub_id LEFT JOIN x_near_mall m ON m.hub_id=h.hub_id""",
    x_visit_option="""SELECT a.*, ROUND(CASE WHEN a.n_stops=2 THEN (q1.quality+q2.quality)/2 ELSE q1.quality END,3) AS quality, d1.dwell_minutes AS dc1, COALESCE(d2.dwell_minutes,0) AS dc2,
 t.preferred_brand_idx IS NOT NULL AS has_preferred, CASE WHEN t.preferred_brand_idx IS NULL OR NOT COALESCE(t.category_1=a.c1 OR t.category_1=a.c2, FALSE) THEN TRUE ELSE b.hub_id IS NOT NULL END AS preferred_met
 FROM x_admitted a JOIN b_trip t ON t.trip_id=a.trip_id JOIN x_quality q1 ON q1.hub_id=a.stop1 LEFT JOIN x_quality q2 ON q2.hub_id=a.stop2
 JOIN b_category d1 ON d1.category_idx=a.c1 LEFT JOIN b_category d2 ON d2.category_idx=a.c2
 LEFT JOIN x_hubbrand b ON b.category=t.category_1 AND b.brand=t.preferred_brand_idx AND (t.category_1=a.c1 OR t.category_1=a.c2) AND b.hub_id=CASE WHEN a.n_stops=1 THEN a.stop1 WHEN a.first_low=(t.category_1=a.c1) THEN a.stop1 ELSE a.stop2 END""",
    x_visit_order="""SELECT *, 0 AS order_no, stop1 AS first_stop, stop2 AS second_stop, lat1 AS a_lat, lon1 AS a_lon, lat2 AS b_lat, lon2 AS b_lon FROM x_visit_option
 UNION ALL SELECT *, 1, stop2, stop1, lat2, lon2, lat1, lon1 FROM x_visit_option WHERE n_stops=2""",
    x_leg="""SELECT v.sid, v.stop1, v.stop2, v.order_no, 0 AS segment, s.o_lat AS p_lat, s.o_lon AS p_lon, v.a_lat AS q_lat, v.a_lon AS q_lon FROM x_visit_order v JOIN x_search s ON s.sid=v.sid
 UNION ALL SELECT v.sid, v.stop1, v.stop2, v.order_no, 1, v.a_lat, v.a_lon, v.b_lat, v.b_lon FROM x_visit_order v WHERE n_stops=2
 UNION ALL SELECT v.sid, v.stop1, v.stop2, v.order_no, v.n_stops, CASE WHEN n_stops=2 THEN b_lat ELSE a_lat END, CASE WHEN n_stops=2 THEN b_lon ELSE a_lon END, s.d_lat, s.d_lon FROM x_visit_order v JOIN x_search s ON s.sid=v.sid""",
    x_leg_pair="SELECT DISTINCT p_lat AS a_lat, p_lon AS a_lon, q_lat AS b_lat, q_lon AS b_lon FROM x_leg",
    x_leg_price=price_sql("x_leg_pair"),
    x_total="""SELECT l.sid, l.stop1, l.stop2, l.order_no, ROUND(SUM(minutes),2) AS travel_minutes, ROUND(SUM(walk_minutes),2) AS walk_minutes, ROUND(SUM(walk_m),1) AS walk_m, SUM(transfers) AS transfers, COUNT(*) AS n_segments,
 MAX(CASE WHEN segment=0 THEN minutes END) AS first_minutes, MAX(CASE WHEN segment=1 THEN minutes END) AS second_minutes
 FROM x_leg l JOIN x_leg_price p ON p.a_lat=p_lat AND p.a_lon=p_lon AND p.b_lat=q_lat AND p.b_lon=q_lon GROUP BY l.sid, l.stop1, l.stop2, l.order_no""",
    x_delta="""SELECT v.*, z.travel_minutes, z.walk_minutes, z.walk_m, z.transfers, z.first_minutes, z.second_minutes, z.n_segments, ROUND(z.travel_minutes+v.dc1+v.dc2,2) AS total_minutes, v.dc1+v.dc2 AS dwell_minutes,
 ROUND(GREATEST(0,ROUND(z.travel_minutes+v.dc1+v.dc2,2)-r.base_minutes),2) AS added_minutes, ROUND(GREATEST(0,z.walk_minutes-r.base_walk_minutes),2) AS added_walk_minutes,
 ROUND(GREATEST(0,z.walk_m-r.base_walk_m),1) AS added_walk_m, CAST(GREATEST(0,z.transfers-r.base_transfers) AS BIGINT) AS added_transfers, t.max_detour_minutes, t.max_detour_is_hard, t.transfer_tolerance, t.walking_tolerance
 FROM x_visit_order v JOIN x_total z ON z.sid=v.sid AND z.stop1=v.stop1 AND z.stop2 IS NOT DISTINCT FROM v.stop2 AND z.order_no=v.order_no JOIN x_route_of r ON r.trip_id=v.trip_id JOIN b_trip t ON t.trip_id=v.trip_id""",
    x_limit="""SELECT *, COALESCE(added_minutes>max_detour_minutes AND max_detour_is_hard,FALSE) AS hard_time, COALESCE(added_minutes>max_detour_minutes AND NOT max_detour_is_hard,FALSE) AS soft_time, transfer_tolerance='no_extra' AND added_transfers>0 AS hard_change,
 CASE walking_tolerance WHEN 'minimal' THEN 2.25e0 WHEN 'low' THEN 1.5e0 WHEN 'standard' THEN 1e0 ELSE 0.55e0 END AS wf, CASE transfer_tolerance WHEN 'no_extra' THEN 2.5e0 WHEN 'prefer_fewer' THEN 1.75e0 ELSE 1e0 END AS tf FROM x_delta""",
    x_scored="""SELECT *, NOT (hard_time OR hard_change) AS hard_met, CASE WHEN match_class<>'best_match' THEN match_class WHEN hard_time OR hard_change THEN 'exceeds_limit' WHEN soft_time THEN 'closest_exact' WHEN added_minutes>45 THEN 'best_available'
  WHEN has_preferred AND preferred_met THEN 'exact_match' WHEN has_preferred THEN 'easier_alternative' ELSE 'best_match' END AS label,
 GREATEST(0e0, ROUND(ROUND(added_minutes+added_walk_minutes*0.65e0*wf+added_transfers*6e0*tf-quality*2.5e0+1e-7,3)-CASE WHEN has_preferred AND preferred_met THEN 2e0 ELSE 0e0 END,6)) AS score FROM x_limit""",
    x_tier="""SELECT *, CASE WHEN match_class='best_match' AND hard_met THEN 0 WHEN match_class='best_match' THEN 1 ELSE 2 END AS tier FROM x_scored""",
    x_win_pool="SELECT * FROM (SELECT *, MIN(tier) OVER (PARTITION BY trip_id) AS best_tier FROM x_tier) z WHERE tier=best_tier",
    x_win="""SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY score, added_minutes, added_walk_minutes, search_no, position, order_no) AS w1,
 ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY added_minutes, score, added_walk_minutes, search_no, position, order_no) AS w2,
 ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY added_walk_minutes, added_minutes, score, search_no, position, order_no) AS w3 FROM x_win_pool""",
    x_w1="SELECT *, 'best_overall' AS result, 1 AS slot FROM x_win WHERE w1=1",
    x_w2="SELECT *, 'fastest' AS result, 2 AS slot FROM x_win WHERE w2=1",
    x_w3="SELECT *, 'least_walking' AS result, 3 AS slot FROM x_win WHERE w3=1",
)


def _same(a, b):
    return f"""(({a}.first_stop={b}.first_stop AND {a}.second_stop IS NOT DISTINCT FROM {b}.second_stop AND ROUND({a}.added_minutes)=ROUND({b}.added_minutes) AND ROUND({a}.added_walk_m/50)=ROUND({b}.added_walk_m/50) AND {a}.added_transfers={b}.added_transfers)
 OR ({a}.added_transfers={b}.added_transfers AND ABS({a}.added_minutes-{b}.added_minutes)<2 AND ABS({a}.added_walk_m-{b}.added_walk_m)<100))"""


SHOWN = "trip_id, result, slot, first_stop, second_stop, label, match_class, score, added_minutes, added_walk_minutes, added_walk_m, added_transfers, dwell_minutes"
define(
    x_keep2=f"SELECT f.* FROM x_w2 f JOIN x_w1 b ON b.trip_id=f.trip_id WHERE NOT {_same('f','b')}",
    x_keep3=f"""SELECT f.* FROM x_w3 f JOIN x_w1 b ON b.trip_id=f.trip_id LEFT JOIN x_keep2 k ON k.trip_id=f.trip_id WHERE NOT {_same('f','b')} AND NOT COALESCE({_same('f','k')}, FALSE)""",
    x_kept=f"SELECT {SHOWN} FROM x_w1 UNION ALL SELECT {SHOWN} FROM x_keep2 UNION ALL SELECT {SHOWN} FROM x_keep3",
    x_winner=f"SELECT {SHOWN.replace(' slot,', ' ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY slot) AS slot,')} FROM x_kept",
    x_fill_list="""SELECT s.trip_id, CASE WHEN s.label='easier_alternative' THEN s.label ELSE 'partial_' || c.slug END AS result, CAST(first_stop AS VARCHAR) || COALESCE('>' || CAST(second_stop AS VARCHAR),'') AS shown, sid, stop1, stop2, order_no,
 ROW_NUMBER() OVER (PARTITION BY s.trip_id ORDER BY score, added_minutes, search_no, position, order_no) AS i FROM x_scored s JOIN b_category c ON c.category_idx=s.c1 WHERE match_class<>'best_match'""",
    x_held="""SELECT trip_id, list(CAST(first_stop AS VARCHAR) || COALESCE('>' || CAST(second_stop AS VARCHAR),'')) AS held, CAST(COUNT(*) AS INTEGER) AS n FROM x_winner GROUP BY trip_id""",
    x_fill="""SELECT trip_id, CAST(0 AS BIGINT) AS i, held AS shown, CAST([] AS VARCHAR[]) AS keys, n, FALSE AS taken FROM x_held
 UNION ALL SELECT f.trip_id, l.i, CASE WHEN f.n<5 AND NOT list_contains(f.shown,l.shown) AND NOT list_contains(f.keys,l.result) THEN list_append(f.shown,l.shown) ELSE f.shown END,
 CASE WHEN f.n<5 AND NOT list_contains(f.shown,l.shown) AND NOT list_contains(f.keys,l.result) THEN list_append(f.keys,l.result) ELSE f.keys END,
 CASE WHEN f.n<5 AND NOT list_contains(f.shown,l.shown) AND NOT list_contains(f.keys,l.result) THEN f.n+1 ELSE f.n END,
 f.n<5 AND NOT list_contains(f.shown,l.shown) AND NOT list_contains(f.keys,l.result) FROM x_fill f JOIN x_fill_list l ON l.trip_id=f.trip_id AND l.i=f.i+1""",
    x_filled="""SELECT l.trip_id, l.result, f.n AS slot, s.first_stop, s.second_stop, s.label, s.match_class, s.score, s.added_minutes, s.added_walk_minutes, s.added_walk_m, s.added_transfers, s.dwell_minutes
 FROM x_fill f JOIN x_fill_list l ON l.trip_id=f.trip_id AND l.i=f.i JOIN x_scored s ON s.sid=l.sid AND s.stop1=l.stop1 AND s.stop2 IS NOT DISTINCT FROM l.stop2 AND s.order_no=l.order_no WHERE f.taken""",
    x_recommended=f"SELECT {SHOWN} FROM x_winner UNION ALL SELECT {SHOWN} FROM x_filled",
    x_considered="""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY score, added_minutes, search_no, position, order_no) AS place FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id, stop1, stop2 ORDER BY score, added_minutes, search_no, position, order_no) AS rn FROM x_scored s
 WHERE NOT EXISTS (SELECT 1 FROM x_recommended r WHERE r.trip_id=s.trip_id AND LEAST(r.first_stop,COALESCE(r.second_stop,r.first_stop))=s.stop1 AND CASE WHEN r.second_stop IS NULL THEN s.stop2 IS NULL ELSE GREATEST(r.first_stop,r.second_stop)=s.stop2 END)) z WHERE rn=1) y WHERE place<=6""",
    x_outcome="""SELECT t.trip_id, CASE WHEN acc>0 AND far=acc THEN 'best_available' WHEN acc>0 THEN 'ok' WHEN fulls>0 THEN 'closest_option' WHEN n>0 THEN 'partial_or_substitute' ELSE 'no_practical_match' END AS outcome FROM b_trip t LEFT JOIN (
 SELECT trip_id, COUNT(*) AS n, COUNT(CASE WHEN match_class='best_match' THEN 1 END) AS fulls, COUNT(CASE WHEN match_class='best_match' AND hard_met THEN 1 END) AS acc, COUNT(CASE WHEN match_class='best_match' AND hard_met AND label='best_available' THEN 1 END) AS far FROM x_scored GROUP BY trip_id) z ON z.trip_id=t.trip_id""",
)


@query("join_preferred_brand", "SELECT sid, stop1, stop2, has_preferred, preferred_met FROM x_visit_option")
def _(g):
    p = plan(g)
    return evaluate.preferred_met(p.admitted(), p.trips, p.brands()).select("sid", "stop1", "stop2", "has_preferred", "preferred_met")


@query("set_route_keys", """SELECT CAST(ROUND(a_lat*1e6) AS BIGINT)*1000000000+CAST(ROUND(a_lon*1e6) AS BIGINT) AS from_place, CAST(ROUND(b_lat*1e6) AS BIGINT)*1000000000+CAST(ROUND(b_lon*1e6) AS BIGINT) AS to_place FROM x_leg_pair""")
def _(g):
    return plan(g).route_keys()


@query("join_route_matrix", """SELECT CAST(ROUND(a_lat*1e6) AS BIGINT)*1000000000+CAST(ROUND(a_lon*1e6) AS BIGINT) AS from_place, CAST(ROUND(b_lat*1e6) AS BIGINT)*1000000000+CAST(ROUND(b_lon*1e6) AS BIGINT) AS to_place,
 minutes, walk_minutes, walk_m, transfers, s, t FROM x_leg_price""")
def _(g):
    p = plan(g)
    return p.price(p.route_keys()).select("from_place", "to_place", "minutes", "walk_minutes", "walk_m", "transfers", "s", "t")


_key = "CAST(ROUND({0}_lat*1e6) AS BIGINT)*1000000000+CAST(ROUND({0}_lon*1e6) AS BIGINT)"
define(
    x_departure=f"""SELECT trip_id, {_key.format('o')} AS from_place, {_key.format('d')} AS to_place, CAST(FLOOR(epoch_us(CAST(departure AS TIMESTAMP))/6e7) AS BIGINT) + departure_minute AS bucket FROM b_trip""",
    x_route_key="SELECT DISTINCT from_place, to_place, bucket + step.n*45 AS bucket FROM x_departure, (VALUES (0),(1),(2)) AS step(n)",
    x_route_row="""SELECT from_place, to_place, bucket - step.n*45 + trip_id % 60 - 20 AS bucket, 20e0 + (trip_id*7 + step.n*13) % 70 AS minutes, 1e0 + (trip_id + step.n) % 12 AS walk_minutes,
 78e0 * (1 + (trip_id + step.n) % 12) AS walk_m, (trip_id + step.n) % 3 AS transfers FROM x_departure, (VALUES (0),(1),(2),(3),(40)) AS step(n) WHERE trip_id % 9 <> 0""",
    x_route_once="""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_place, to_place, bucket ORDER BY minutes, walk_minutes, walk_m, transfers) AS rn FROM x_route_row) z WHERE rn=1""",
)


def departures(g):
    return trip_table(g).select("trip_id", geo.place_key("o_lat", "o_lon").alias("from_place"), geo.place_key("d_lat", "d_lon").alias("to_place"), routes.bucket(F.col("departure"), 1).alias("bucket"))


def route_keys(g):
    """What trips ask for: their direct pair when they leave, and 45 and 90 minutes later."""
    return departures(g).select("from_place", "to_place", F.explode(F.array(*[F.col("bucket") + 45 * n for n in range(3)])).alias("bucket")).distinct()


def route_rows(g):
    """A route table captured at several times around the departures; one trip in nine has no rows."""
    step, trip = F.col("n"), F.col("trip_id")
    rows = departures(g).filter("trip_id % 9 <> 0").withColumn("n", F.explode(F.array(*[F.lit(n) for n in (0, 1, 2, 3, 40)])))
    walk = (1 + (trip + step) % 12).cast("double")
    return rows.select(
        "from_place", "to_place", (F.col("bucket") - step * 45 + trip % 60 - 20).alias("bucket"), (20 + (trip * 7 + step * 13) % 70).cast("double").alias("minutes"),
        walk.alias("walk_minutes"), (78 * walk).alias("walk_m"), ((trip + step) % 3).alias("transfers"),
    )


@query("set_route_buckets", "SELECT from_place, to_place, bucket FROM x_route_key")
def _(g):
    return route_keys(g)


@query("join_route_asof", """SELECT k.from_place, k.to_place, k.bucket, r.minutes, r.walk_minutes, r.walk_m, r.transfers FROM x_route_key k
 ASOF JOIN x_route_once r ON r.from_place=k.from_place AND r.to_place=k.to_place AND r.bucket<=k.bucket""")
def _(g):
    return routes.as_of(route_keys(g), route_rows(g))


def leg_rows(g):
    """A route table of the legs of the plan: a price a year for two pairs of directed places in three."""
    pairs = plan(g).route_keys().withColumn("h", F.xxhash64("from_place", "to_place")).filter("pmod(h, 3) <> 0")
    rows = pairs.withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(6))))
    walk = F.expr("double(1 + pmod(h, 9))")
    return rows.select(
        "from_place", "to_place", (11_570_400 + F.col("year") * 525_600).cast("bigint").alias("bucket"), F.expr("double(10 + pmod(h + 7 * year, 50))").alias("minutes"),
        walk.alias("walk_minutes"), (78 * walk).alias("walk_m"), F.expr("pmod(h, 3)").alias("transfers"),
    )


@query("win_leg_departures")
def _(g):
    p = plan(g)
    legs = routes.along_the_clock(p.priced_segments(), p.starts(), g.keep("leg_rows", lambda: leg_rows(g)))
    return legs.select(*routes.ORDER, "segment", *routes.PAIR, F.unix_timestamp("leaves").alias("leaves"), "bucket", "minutes", "walk_minutes", "walk_m", "transfers", "from_table")


@query("agg_combine_segments", "SELECT sid, stop1, stop2, order_no, travel_minutes, walk_minutes, walk_m, CAST(transfers AS BIGINT) AS transfers FROM x_total")
def _(g):
    return plan(g).totals().select("sid", "stop1", "stop2", "order_no", "travel_minutes", "walk_minutes", "walk_m", "transfers")


@query("pipe_visit_orders", "SELECT sid, first_stop, second_stop, order_no, total_minutes, walk_minutes, walk_m, CAST(transfers AS BIGINT) AS transfers, n_segments FROM x_delta")
def _(g):
    return plan(g).scored().select("sid", "first_stop", "second_stop", "order_no", "total_minutes", "walk_minutes", "walk_m", "transfers", "n_segments")


@query("prj_score_options", "SELECT sid, first_stop, second_stop, order_no, added_minutes, added_walk_minutes, added_walk_m, added_transfers, label, hard_met, ROUND(score,3) AS score FROM x_scored")
def _(g):
    return plan(g).scored().select(
        "sid", "first_stop", "second_stop", "order_no", "added_minutes", "added_walk_minutes", "added_walk_m", "added_transfers", "label", "hard_met", F.round("score", 3).alias("score")
    )


@query("top_objectives", """SELECT a.trip_id, a.first_stop AS best_first, a.second_stop AS best_second, b.first_stop AS fast_first, b.second_stop AS fast_second, c.first_stop AS calm_first, c.second_stop AS calm_second
 FROM x_w1 a JOIN x_w2 b ON b.trip_id=a.trip_id JOIN x_w3 c ON c.trip_id=a.trip_id""")
def _(g):
    rows = rank.objectives(rank.winner_pool(plan(g).scored()))
    names = {"best_overall": "best", "fastest": "fast", "least_walking": "calm"}
    return rows.select("trip_id", *[F.col(f"{k}.{w}_stop").alias(f"{v}_{w}") for k, v in names.items() for w in ("first", "second")])


@query("win_dedupe_winners", "SELECT trip_id, result, first_stop, second_stop, added_minutes FROM x_winner")
def _(g):
    return plan(g).winners().select("trip_id", "result", "first_stop", "second_stop", "added_minutes")


@query("win_fallback_fill", "SELECT trip_id, result, slot, first_stop, second_stop, ROUND(score,3) AS score FROM x_filled")
def _(g):
    p = plan(g)
    return rank.fill(p.winners(), p.scored(), p.categories).select("trip_id", "result", "slot", "first_stop", "second_stop", F.round("score", 3).alias("score"))


@query("win_considered", "SELECT trip_id, CAST(place AS INTEGER) AS place, first_stop, second_stop, ROUND(score,3) AS score FROM x_considered")
def _(g):
    return plan(g).considered().select("trip_id", "place", "first_stop", "second_stop", F.round("score", 3).alias("score"))


@query("agg_outcome", "SELECT * FROM x_outcome")
def _(g):
    return plan(g).outcomes()


@query(
    "pipe_plan",
    """SELECT o.trip_id, o.outcome, role, name, place, first_stop, second_stop, label, ROUND(score,3) AS score, added_minutes, added_walk_m, added_transfers FROM x_outcome o LEFT JOIN (
 SELECT trip_id, 'recommended' AS role, result AS name, CAST(slot AS INTEGER) AS place, first_stop, second_stop, label, score, added_minutes, added_walk_m, added_transfers FROM x_recommended
 UNION ALL SELECT trip_id, 'considered', 'compared', CAST(place AS INTEGER), first_stop, second_stop, label, score, added_minutes, added_walk_m, added_transfers FROM x_considered) r ON r.trip_id=o.trip_id""",
)
def _(g):
    return plan(g).result().withColumn("score", F.round("score", 3))
