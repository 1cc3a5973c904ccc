"""Feed and sink queries."""

import uuid

from pyspark.sql import functions as F

from .. import params
from ..functions import text
from ..operators import timetable
from ..session import checkpoint_root
from ..sources import feeds, sinks
from ..tables import BINDINGS
from .catalog import _compact, _norm, incoming
from .registry import define, query
from .trips import H, plan

BINDINGS["b_grid"] = "SELECT c_custkey AS point_id, c_nationkey AS nation, 30000e0 + (c_custkey * 7919) % 18000 AS northing, 6000e0 + (c_custkey * 104729) % 38000 AS easting FROM customer"
BINDINGS["b_point"] = "SELECT 'Nation ' || CAST(c_nationkey AS STRING) AS name, 1.2e0 + ((c_custkey * 37) % 2000) / 1e4 AS lat, 103.65e0 + ((c_custkey * 91) % 3000) / 1e4 AS lon FROM customer"
BINDINGS["b_code_list"] = "SELECT replace(n_name, '_', ' ') AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'BP' WHEN n_nationkey % 6 = 1 THEN 'NS' ELSE 'CC' END || CAST(n_nationkey AS STRING) AS code FROM nation WHERE n_nationkey < 22"


@query("src_stations")
def _(g):
    rows = g.supplier.select(F.col("s_name").alias("canonical_name"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.concat(F.lit("NS"), F.col("s_suppkey").cast("string")), F.concat(F.lit("CC"), F.col("s_suppkey").cast("string")))).otherwise(F.array(F.concat(F.lit("EW"), F.col("s_suppkey").cast("string")))).alias("station_codes"), F.lit(1.3).alias("latitude"), (103.7 + F.col("s_suppkey") / 1e4).alias("longitude"))
    payload = rows.groupBy(F.pmod(F.hash("canonical_name"), F.lit(16)).alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("stations"))).alias("payload"))
    return feeds.stations(payload.select(F.from_json("payload", feeds.STATION_LIST).alias("p")).select("p.*"))


@query("src_station_merge", f"""SELECT p.name, COALESCE(c.codes,'') AS codes, p.lat, p.lon, p.n_points, CASE WHEN c.heavy THEN 'MRT' ELSE 'LRT' END AS kind, CAST(4+2*COALESCE(c.n,0) AS INTEGER) AS n_aliases FROM (SELECT {_compact('name')} AS key, MIN(name) AS name, ROUND(AVG(lat),7) AS lat, ROUND(AVG(lon),7) AS lon, COUNT(*) AS n_points FROM b_point GROUP BY 1) p
 LEFT JOIN (SELECT {_compact('name')} AS key, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, COUNT(DISTINCT code) AS n, bool_or(NOT regexp_matches(code,'^(BP|SE|SW|PE|PW|STC|PTC)')) AS heavy FROM b_code_list GROUP BY 1) c ON c.key=p.key""")
def _(g):
    return feeds.merge_stations(g.point, g.code_list)


def _grid_sql():
    import math

    a, f = 6378137.0, 1 / 298.257223563
    e2 = 2 * f - f * f
    c0, c2 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128)
    c4, c6 = 15 / 256 * (e2**2 + 3 * e2**3 / 4), 35 * e2**3 / 3072
    p = math.radians(1.366666)
    m0 = a * (c0 * p - c2 * math.sin(2 * p) + c4 * math.sin(4 * p) - c6 * math.sin(6 * p))
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    j = (3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512)
    ep2 = e2 / (1 - e2)
    L = params.literal
    return f"""SELECT point_id, ROUND(degrees(fp-n*tan(fp)/r*(d*d/2-(5+3*t+10*k-4*k*k-9*{L(ep2)})*pow(d,4)/24+(61+90*t+298*k+45*t*t-252*{L(ep2)}-3*k*k)*pow(d,6)/720)),7) AS lat,
 ROUND(degrees({L(math.radians(103.833333))}+(d-(1+2*t+k)*pow(d,3)/6+(5-2*k+28*t-3*k*k+8*{L(ep2)}+24*t*t)*pow(d,5)/120)/cos(fp)),7) AS lon FROM (
 SELECT *, (easting-28001.642e0)/n AS d FROM (SELECT *, pow(tan(fp),2) AS t, {L(ep2)}*cos(fp)*cos(fp) AS k, {L(a)}/sqrt(1-{L(e2)}*sin(fp)*sin(fp)) AS n, {L(a * (1 - e2))}/pow(1-{L(e2)}*sin(fp)*sin(fp),1.5) AS r FROM (
 SELECT *, mu+{L(j[0])}*sin(2*mu)+{L(j[1])}*sin(4*mu)+{L(j[2])}*sin(6*mu)+{L(j[3])}*sin(8*mu) AS fp FROM (SELECT *, ({L(m0)}+northing-38744.572e0)/{L(a * c0)} AS mu FROM b_grid) a) b) c) z"""


@query("prj_grid_reproject", _grid_sql())
def _(g):
    return feeds.grid_to_degrees(g.grid).select("point_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("src_itineraries", """SELECT capture_id, CASE WHEN k<5 THEN ROUND((ride + CASE WHEN k=1 THEN 420 ELSE 600 END)/6e1,2) END AS minutes, CASE WHEN k<5 THEN 7e0 END AS walk_minutes, CASE WHEN k<5 THEN 820.6e0 END AS walk_m,
 CASE WHEN k<5 THEN CASE WHEN k=3 THEN 1 ELSE 0 END END AS transfers, CASE WHEN k<5 THEN 3 END AS n_legs, CASE WHEN k=5 THEN 'no route' END AS reject_reason
 FROM (SELECT o_orderkey AS capture_id, 600 + o_custkey % 3000 AS ride, o_orderkey % 6 AS k FROM orders) z""")
def _(g):
    base = g.orders.select(F.col("o_orderkey").alias("capture_id"), (600 + F.col("o_custkey") % 3000).alias("ride"), (F.col("o_orderkey") % 6).alias("k"))
    leg = lambda mode, dur: F.struct(F.lit(mode).alias("mode"), dur.cast("string").alias("duration"), F.lit("410.25").alias("distance"))
    legs = F.array(leg("WALK", F.lit(240)), leg("SUBWAY", F.col("ride")), leg("WALK", F.lit(180)))
    it = F.struct(F.when(F.col("k") != 1, (F.col("ride") + 600).cast("string")).alias("duration"), F.when(F.col("k") != 2, F.lit("420")).alias("walkTime"), F.when(F.col("k") == 3, F.lit("1")).alias("transfers"), legs.alias("legs"))
    plan_ = F.struct(F.array(it).alias("itineraries"))
    none = F.lit(None)
    body = F.when(F.col("k") == 4, F.to_json(F.struct(F.struct(plan_.alias("plan")).alias("data")))).when(F.col("k") == 5, F.lit('{"error":"No route found"}')).otherwise(F.to_json(F.struct(plan_.alias("plan"))))
    routes, rejects = feeds.itineraries(base.withColumn("payload", body), "capture_id")
    return routes.select("capture_id", "minutes", "walk_minutes", "walk_m", "transfers", "n_legs", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejects, allowMissingColumns=True)


@query("src_arrivals", f"""SELECT stop_code, service_no, nth AS slot, CAST(FLOOR(epoch_us(observed_at + to_seconds(eta_seconds))/1e6) AS BIGINT) AS due, live, load, TRUE AS accessible, 'DD' AS vehicle,
 '{dict(params.BUS_OPERATORS)["SBST"]}' AS operator FROM b_arrival, (VALUES (1),(2),(3)) AS n(nth) WHERE slot >= nth AND eta_seconds IS NOT NULL AND observed_at IS NOT NULL""")
def _(g):
    stamp = F.date_format(F.col("observed_at").cast("timestamp") + F.make_dt_interval(secs=F.col("eta_seconds").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    bus = lambda test: F.struct(F.when(test, stamp).otherwise("").alias("EstimatedArrival"), F.when(F.col("live"), "1").otherwise("0").alias("Monitored"), F.coalesce("load", F.lit("")).alias("Load"), F.lit("WAB").alias("Feature"), F.lit("DD").alias("Type"))
    service = F.struct(F.col("service_no").alias("ServiceNo"), F.lit("SBST").alias("Operator"), bus(F.col("slot") >= 1).alias("NextBus"), bus(F.col("slot") >= 2).alias("NextBus2"), bus(F.col("slot") >= 3).alias("NextBus3"))
    payload = g.arrival.select(F.to_json(F.struct(F.col("stop_code").alias("BusStopCode"), F.array(service).alias("Services"))).alias("payload"))
    return feeds.arrivals(payload, g.spark).withColumn("due", F.unix_timestamp("due"))


def entity_payloads(g):
    """Answers for every brand key the extract mentions: some redirected, some without a logo."""
    from .catalog import pois
    from ..sources import elements as el

    keys = pois(g).select(el.brand_key().alias("brand_key")).filter("brand_key IS NOT NULL").distinct()
    n = F.substring("brand_key", 2, 10).cast("int")
    answered = F.when(n % 4 == 3, F.concat(F.lit("Q9"), "brand_key")).otherwise(F.col("brand_key"))
    claim = F.concat(F.lit('{"P154":[{"rank":"'), F.when(n % 5 == 1, "deprecated").otherwise("normal"), F.lit('","mainsnak":{"snaktype":"value","datavalue":{"value":"Logo '), "brand_key", F.lit('.svg"}}}]}'))
    body = F.concat(F.lit('{"entities":{"'), answered, F.lit('":{"claims":'), claim, F.lit(',"labels":{"en":{"value":"Brand '), "brand_key", F.lit('"}}}}}'))
    return keys.select("brand_key", body.alias("payload"))


@query("src_brand_entities")
def _(g):
    return feeds.brand_entities(entity_payloads(g))


BINDINGS["b_logo_old"] = "SELECT 'Q' || CAST(p_partkey AS STRING) AS brand_key, 'old/' || CAST(p_partkey AS STRING) AS url FROM part WHERE p_size > 10"
BINDINGS["b_logo_new"] = "SELECT 'Q' || CAST(p_partkey AS STRING) AS brand_key, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'new/' || CAST(p_partkey AS STRING) END AS url FROM part WHERE p_size < 30"


define(x_logo="SELECT COALESCE(n.brand_key,o.brand_key) AS brand_key, CASE WHEN n.brand_key IS NOT NULL THEN n.url ELSE o.url END AS url FROM b_logo_old o FULL JOIN b_logo_new n ON n.brand_key=o.brand_key WHERE CASE WHEN n.brand_key IS NOT NULL THEN n.url ELSE o.url END IS NOT NULL")


@query("sink_merge_logos", "SELECT * FROM x_logo")
def _(g):
    return sinks.merge_logos(g.logo_old, g.logo_new)


@query("sink_insert_ignore", "SELECT event_id, event_type, user_id FROM b_event WHERE event_id NOT IN (SELECT event_id FROM b_event WHERE event_type='search_started')")
def _(g):
    known = g.event.filter("event_type = 'search_started'")
    again = g.event.unionByName(g.event)
    return sinks.insert_ignore(known, again.select("event_id", "event_type", "user_id"))


@query("sink_retention", "SELECT event_id FROM b_event WHERE occurred_at >= (SELECT MAX(occurred_at) FROM b_event) - INTERVAL 10 DAY")
def _(g):
    return sinks.retain(g.event, 10).select("event_id")


@query("sink_replace_source")
def _(g):
    fresh = incoming(g).withColumn("hub_id", F.col("hub_id") + 1000000000)
    root = f"{checkpoint_root(g.spark)}/catalog-{uuid.uuid4().hex}"
    sinks.write_version(g.hub, root, "1", partition_by="source")
    sinks.replace_source_in(root, "2", fresh, "curated")
    return sinks.read_version(g.spark, root).groupBy("source").agg(F.count("*").alias("hubs"), F.min("hub_id").alias("first_hub"))


@query("sink_replace_snapshot")
def _(g):
    root = f"{checkpoint_root(g.spark)}/timetable-{uuid.uuid4().hex}"
    sinks.write_version(timetable.stops(g.raw_stop), f"{root}/stops", "1")
    sinks.write_version(timetable.routes(g.bus_route), f"{root}/routes", "1")
    stops, routes = sinks.read_version(g.spark, f"{root}/stops"), sinks.read_version(g.spark, f"{root}/routes")
    return routes.groupBy("stop_code").agg(F.count("*").alias("rows")).join(stops.select("stop_code", "description"), "stop_code", "left")
