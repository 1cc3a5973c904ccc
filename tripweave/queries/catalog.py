"""Catalog queries: elements, names, brands, context and the refresh."""

from pyspark.sql import functions as F

from .. import params
from ..functions import geo, text
from ..operators import candidates, catalog, spatial
from ..plans import refresh
from ..session import spread
from ..sources import elements as el
from ..tables import BINDINGS
from .registry import define, query
from .trips import H, plan

BINDINGS["b_brand"] = params.values_sql([(i, s, n) for i, s, n, _ in params.BRANDS], "brand_idx, slug, brand_name")
BINDINGS["b_label"] = params.values_sql([(r[1], r[4], r[5]) for r in params.CATEGORIES], "slug, heading, noun")
BINDINGS["b_alias"] = params.values_sql([(a, s, dict((x[1], x[2]) for x in params.BRANDS)[s]) for a, s in params.BRAND_ALIASES], "alias, brand_slug, brand_name")
_SHOP = {0: "supermarket", 3: "electronics", 9: "convenience", 15: "bakery", 16: "confectionery", 17: "stationery", 18: "hardware", 19: "florist", 20: "pet", 21: "clothes", 22: "houseware", 23: "copyshop", 24: "hairdresser", 25: "optician", 26: "repair"}
_AMENITY = {1: "pharmacy", 2: "parcel_locker", 4: "atm", 5: "fast_food", 6: "fast_food", 7: "cafe", 8: "cafe", 10: "restaurant", 11: "restaurant", 12: "restaurant", 13: "restaurant", 14: "food_court"}
_CUISINE = {6: "chicken", 7: "bubble_tea", 11: "burger;american", 12: "sushi;japanese", 13: "korean", 14: "chinese"}


def _case(of, table):
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


TAGS = {
    "t_name": "name", "t_shop": "shop", "t_amenity": "amenity", "t_cuisine": "cuisine", "t_brand": "brand", "t_operator": "operator",
    "t_wikidata": "brand:wikidata", "t_hours": "opening_hours", "t_street": "addr:street", "t_place": "addr:place",
    "t_number": "addr:housenumber", "t_postcode": "addr:postcode", "t_contact": "contact:address", "t_transport": "public_transport",
    "t_railway": "railway", "t_highway": "highway", "t_disused": "disused:shop", "t_status": "status", "t_end": "end_date",
}
NOTAGS = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in TAGS)


def _row(fields: dict) -> str:
    return ", ".join(f"{fields.get(c, 'CAST(NULL AS STRING)')} AS {c}" for c in TAGS)


_place = {
    "t_name": "CASE WHEN o.outlet_id % 13 = 0 THEN NULL WHEN o.category_idx = 6 AND o.outlet_id % 2 = 0 THEN 'Crispy Fried Chicken ' || CAST(o.hub_id % 50 AS STRING) WHEN o.brand_idx IS NOT NULL THEN b.brand_name || ' ' || h.name ELSE h.name END",
    "t_shop": _case("o.category_idx", _SHOP), "t_amenity": _case("o.category_idx", _AMENITY), "t_cuisine": _case("o.category_idx", _CUISINE),
    "t_brand": "CASE WHEN o.outlet_id % 4 <> 0 THEN b.brand_name END", "t_operator": "CASE WHEN o.outlet_id % 5 = 0 THEN b.brand_name END",
    "t_wikidata": "CASE WHEN o.outlet_id % 9 = 0 THEN 'Q0' WHEN o.brand_idx IS NOT NULL THEN 'Q' || CAST(1000 + o.brand_idx AS STRING) END",
    "t_hours": "o.opening_hours", "t_street": "CASE WHEN o.hub_id % 3 = 0 THEN 'Jalan ' || CAST(o.hub_id % 60 AS STRING) || ', #0' || CAST(o.hub_id % 9 AS STRING) || '-01' END",
    "t_place": "CASE WHEN o.hub_id % 3 = 1 THEN 'Block ' || CAST(o.hub_id % 70 AS STRING) || ' (Rear)' END",
    "t_number": "CASE WHEN o.hub_id % 2 = 0 THEN CAST(o.hub_id % 300 AS STRING) END", "t_postcode": "CASE WHEN o.hub_id % 5 = 0 THEN LPAD(CAST(o.hub_id * 37 % 820000 + 10000 AS STRING), 6, '0') END",
    "t_contact": "CASE WHEN o.hub_id % 7 = 0 THEN 'Unit ' || CAST(o.hub_id AS STRING) END",
    "t_disused": "CASE WHEN o.outlet_id % 71 = 0 THEN 'yes' END", "t_status": "CASE WHEN o.closure_status = 'closed' THEN 'Closed' END",
    "t_end": "CASE WHEN o.outlet_id % 67 = 0 THEN '2020' END",
}
_mall = {"t_name": "h.name || ' Mall'", "t_shop": "'mall'", "t_street": "CASE WHEN h.hub_id % 60 = 0 THEN 'Mall Road' END", "t_end": "CASE WHEN h.hub_id % 700 = 0 THEN '2019' END"}
_node = {
    "t_name": "CASE WHEN length(n.node_id) % 3 = 0 THEN NULL ELSE n.name END", "t_railway": "CASE WHEN n.node_type = 'station' AND length(n.name) % 2 = 0 THEN 'station' END",
    "t_transport": "CASE WHEN n.node_type = 'station' AND length(n.name) % 2 = 1 THEN 'station' END", "t_highway": "CASE WHEN n.node_type = 'bus_stop' AND n.node_id NOT LIKE '%7' THEN 'bus_stop' END",
    "t_amenity": "CASE WHEN n.node_type = 'bus_stop' AND n.node_id LIKE '%7' THEN 'bus_station' END",
}
_nobox = "CAST(NULL AS DOUBLE) AS minlat, CAST(NULL AS DOUBLE) AS maxlat, CAST(NULL AS DOUBLE) AS minlon, CAST(NULL AS DOUBLE) AS maxlon"
_nocentre = "CAST(NULL AS DOUBLE) AS c_lat, CAST(NULL AS DOUBLE) AS c_lon"
_jitter_lat, _jitter_lon = "h.lat + ((o.outlet_id * 31) % 7 - 3) * 1e-4", "h.lon + ((o.outlet_id * 17) % 7 - 3) * 1e-4"
define(
    b_element=f"""SELECT 'node' AS kind, o.outlet_id AS id, {_jitter_lat} AS lat, {_jitter_lon} AS lon, {_nocentre}, {_nobox}, {_row(_place)}
 FROM b_outlet o JOIN b_hub h ON h.hub_id=o.hub_id LEFT JOIN b_brand b ON b.brand_idx=o.brand_idx
 UNION ALL SELECT 'relation', o.outlet_id, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {_jitter_lat} + 1e-4, {_jitter_lon}, {_nobox.replace(' AS minlat','').replace(' AS maxlat','').replace(' AS minlon','').replace(' AS maxlon','')}, {_row(_place)}
 FROM b_outlet o JOIN b_hub h ON h.hub_id=o.hub_id LEFT JOIN b_brand b ON b.brand_idx=o.brand_idx WHERE o.outlet_id % 8 = 3
 UNION ALL SELECT 'way', h.hub_id, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CASE WHEN h.hub_id % 40 = 0 THEN h.lat END, CASE WHEN h.hub_id % 40 = 0 THEN h.lon END, h.lat - 6e-4, h.lat + 6e-4, h.lon - 8e-4, h.lon + 8e-4, {_row(_mall)} FROM b_hub h WHERE h.semantic_type='mall'
 UNION ALL SELECT 'node', 900000000000 + ROW_NUMBER() OVER (ORDER BY n.node_id), n.lat, n.lon + CASE WHEN n.node_id LIKE '%99' THEN 5e-1 ELSE 0e0 END, {_nocentre}, {_nobox}, {_row(_node)} FROM b_node n""",
    x_located="""SELECT *, kind || '/' || CAST(id AS VARCHAR) AS source_id, COALESCE(lat, c_lat, (minlat+maxlat)/2) AS y, COALESCE(lon, c_lon, (minlon+maxlon)/2) AS x FROM b_element""",
    x_city="SELECT * FROM x_located WHERE y BETWEEN 1.13 AND 1.48 AND x BETWEEN 103.58 AND 104.10",
)


def _norm(c):
    return f"trim(regexp_replace(lower(COALESCE({c},'')),'[^a-z0-9]+',' ','g'))"


def _compact(c):
    return f"regexp_replace(lower(COALESCE({c},'')),'[^a-z0-9]+','','g')"


_amenity, _shop, _cui = "lower(COALESCE(t_amenity,''))", "lower(COALESCE(t_shop,''))", "lower(COALESCE(t_cuisine,''))"
_named = {
    "chicken": f"COALESCE(brand_slug IN ({','.join(repr(b) for b in params.FRIED_CHICKEN_BRANDS)}),FALSE) OR contains(words,'fried chicken')",
    "tea": f"contains({_cui},'bubble_tea') OR " + " OR ".join(f"contains(words,'{t}')" for t in params.BUBBLE_TEA_TERMS),
}
_picked = []
for _name, _amenities, _shops, _kinds, _extra in el.CATEGORY_RULES:
    _hits = [f"{_value} IN ({','.join(repr(v) for v in _values)})" for _value, _values in ((_amenity, _amenities), (_shop, _shops)) if _values]
    if _kinds:
        _hits.append(f"list_has_any(string_split(replace({_cui},',',';'),';'), [{','.join(repr(v) for v in _kinds)}])")
    if _extra in _named:
        _hits.append(_named[_extra])
    _picked.append(f"CASE WHEN {' OR '.join(_hits)} THEN '{_name}' END")
define(
    x_branded=f"""SELECT e.*, COALESCE(a.brand_slug,b.brand_slug,c.brand_slug) AS brand_slug, COALESCE(a.brand_name,b.brand_name,c.brand_name) AS brand_name, {_norm('t_name')} || ' ' || {_norm('t_cuisine')} AS words
 FROM x_city e LEFT JOIN b_alias a ON a.alias={_norm('t_brand')} LEFT JOIN b_alias b ON b.alias={_norm('t_operator')} LEFT JOIN b_alias c ON c.alias={_norm('t_name')}""",
    x_cats=f"SELECT *, list_filter([{', '.join(_picked)}], lambda v: v IS NOT NULL) AS raw_cats FROM x_branded",
    x_poi="""SELECT *, list_filter(raw_cats, lambda v, i: list_position(raw_cats, v) = i) AS cats FROM x_cats WHERE len(raw_cats)>0""",
    x_display="""SELECT p.*, COALESCE(brand_name, t_name, l.noun) AS display_name, l.heading FROM x_poi p JOIN b_label l ON l.slug=p.cats[1]""",
    x_transit_node="""SELECT source_id, CASE WHEN t_highway='bus_stop' THEN 'bus_stop' WHEN t_amenity='bus_station' THEN 'bus_station' ELSE COALESCE(NULLIF(t_railway,''),NULLIF(t_transport,''),'station') END AS node_type, COALESCE(t_name,'Transport node ' || source_id) AS name, y AS lat, x AS lon
 FROM x_city WHERE t_highway='bus_stop' OR t_amenity='bus_station' OR t_transport='station' OR t_railway='station'""",
    x_mall="SELECT source_id AS mall_id, y, x, minlat, maxlat, minlon, maxlon FROM x_city WHERE t_shop='mall'",
    x_box_hit=f"""SELECT source_id, mall_id FROM (SELECT p.source_id, m.mall_id, ROW_NUMBER() OVER (PARTITION BY p.source_id ORDER BY {H('p.y','p.x','m.y','m.x')}, m.mall_id) AS rn FROM x_poi p JOIN x_mall m
 ON p.y BETWEEN m.minlat-0.00015 AND m.maxlat+0.00015 AND p.x BETWEEN m.minlon-0.00015 AND m.maxlon+0.00015) z WHERE rn=1""",
    x_radius_hit=f"""SELECT source_id, mall_id FROM (SELECT p.source_id, m.mall_id, ROW_NUMBER() OVER (PARTITION BY p.source_id ORDER BY {H('p.y','p.x','m.y','m.x')}, m.mall_id) AS rn FROM x_poi p JOIN x_mall m
 ON abs(p.y-m.y)<0.001 AND abs(p.x-m.x)<0.001 AND {H('p.y','p.x','m.y','m.x')}<=0.075) z WHERE rn=1""",
    x_mall_of="SELECT p.source_id, COALESCE(b.mall_id, r.mall_id) AS mall_id, b.mall_id IS NOT NULL AS contained FROM x_poi p LEFT JOIN x_box_hit b USING (source_id) LEFT JOIN x_radius_hit r USING (source_id)",
)


def flat(g):
    def build():
        from .registry import EXPRESSIONS

        names = ["outlet", "hub", "node"]
        sql = EXPRESSIONS["b_element"]
        for name in (*names, "brand"):
            sql = sql.replace(f"b_{name} ", f"{{{name}}} ")
        return g.spark.sql(sql, outlet=g.outlet, hub=g.hub, node=g.node, brand=g.brand)

    return g.keep("element", build)


def elements(g):
    """Elements as a map extract holds them: nested geometry and a tag map.

    Written once: read from a query, a tag would build the whole map again, and the rules ask for tags a hundred
    times. Spread, as the rules are long and the rows short.
    """

    def build():
        pairs = F.array(*[F.struct(F.lit(t).alias("k"), F.col(c).alias("v")) for c, t in TAGS.items()])
        return spread(flat(g), "kind", "id").select(
            F.col("kind").alias("type"), "id", "lat", "lon",
            F.when(F.col("c_lat").isNotNull(), F.struct(F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"))).alias("center"),
            F.when(F.col("minlat").isNotNull(), F.struct("minlat", "maxlat", "minlon", "maxlon")).alias("bounds"),
            F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"),
            F.concat("kind", F.lit("/"), F.col("id").cast("string")).alias("source_id"),
        )

    return g.keep("map elements", build)


def city(g):
    return el.located(elements(g))


def pois(g):
    return g.keep("city pois", lambda: refresh.pois(city(g), catalog.alias_table(g.spark), catalog.label_table(g.spark)))


@query("src_map_elements")
def _(g):
    body = elements(g).drop("source_id")
    payload = body.groupBy(F.pmod(F.hash("id"), F.lit(64)).alias("part")).agg(
        F.to_json(F.struct(F.struct(F.lit("2026-01-01").alias("captured_at")).alias("capture_metadata"), F.collect_list(F.struct(*body.columns)).alias("elements"))).alias("payload")
    )
    return el.parse_map_payloads(payload).select("source_id", "type", "id", F.col("center.lat").alias("c_lat"), F.col("bounds.minlat").alias("minlat"), F.size("tags").alias("n_tags"))


@query("prj_coordinate", "SELECT source_id, ROUND(y,6) AS lat, ROUND(x,6) AS lon FROM x_located")
def _(g):
    return elements(g).withColumn("p", el.coordinate()).select("source_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("flt_city_bounds", "SELECT source_id FROM x_city")
def _(g):
    return city(g).select("source_id")


@query("prj_closed", """SELECT source_id, COALESCE(t_disused IS NOT NULL OR lower(trim(COALESCE(t_hours,'') || '  ' || COALESCE(t_status,''))) IN ('closed','off','permanently closed') OR COALESCE(t_end,'')<>'', FALSE) AS closed FROM x_located""")
def _(g):
    return elements(g).select("source_id", el.is_closed().alias("closed"))


@query("prj_address", """SELECT source_id, COALESCE(NULLIF(concat_ws(', Singapore ', NULLIF(concat_ws(' ', t_number, COALESCE(t_street, t_place)),''), t_postcode),''), t_contact) AS address FROM x_located""")
def _(g):
    return elements(g).select("source_id", el.address().alias("address"))


@query("join_brand_alias", "SELECT source_id, brand_slug, brand_name FROM x_branded")
def _(g):
    return refresh.branded(city(g), catalog.alias_table(g.spark)).select("source_id", "brand_slug", "brand_name")


@query("prj_categories", "SELECT source_id, array_to_string(cats,',') AS categories FROM x_poi")
def _(g):
    return pois(g).select("source_id", F.array_join("categories", ",").alias("categories"))


@query("prj_node_type", "SELECT source_id, node_type FROM x_transit_node")
def _(g):
    return refresh.nodes(city(g)).select("source_id", "node_type")


@query("prj_display_name", "SELECT source_id, display_name, heading FROM x_display")
def _(g):
    return pois(g).select("source_id", "display_name", "heading")


@query("flt_brand_key", "SELECT source_id, trim(t_wikidata) AS brand_key FROM x_city WHERE regexp_matches(trim(t_wikidata),'^Q[1-9][0-9]*$')")
def _(g):
    return city(g).select("source_id", el.brand_key().alias("brand_key")).filter("brand_key IS NOT NULL")


@query("agg_brand_frequency", "SELECT trim(t_wikidata) AS brand_key, COUNT(*) AS outlets FROM x_poi WHERE regexp_matches(trim(t_wikidata),'^Q[1-9][0-9]*$') GROUP BY 1")
def _(g):
    rows = pois(g).select(el.brand_key().alias("brand_key")).filter("brand_key IS NOT NULL")
    return rows.groupBy("brand_key").agg(F.count("*").alias("outlets")).orderBy(F.desc("outlets"), "brand_key")


@query("join_mall_containment", "SELECT source_id, mall_id FROM x_box_hit")
def _(g):
    return catalog.mall_of(pois(g), refresh.malls(city(g)), "source_id").filter("found_by = 'containment'").select("source_id", "mall_id")


@query("join_mall_radius", "SELECT source_id, COALESCE(mall_id, 'poi:' || source_id) AS hub_source_id, contained FROM x_mall_of")
def _(g):
    found = catalog.mall_of(pois(g), refresh.malls(city(g)), "source_id")
    return pois(g).select("source_id").join(found, "source_id", "left").select(
        "source_id", F.coalesce("mall_id", F.concat(F.lit("poi:"), "source_id")).alias("hub_source_id"),
        F.coalesce(F.col("found_by") == "containment", F.lit(False)).alias("contained"),
    )


_clean = "regexp_replace(regexp_replace(string_split_regex(regexp_replace({c}, '\\s*\\([^)]*\\)', '', 'g'), '[,;]')[1], '\\s+', ' ', 'g'), '^[ /-]+|[ /-]+$', '', 'g')"
define(
    x_near_node=f"""SELECT source_id, node_name, node_type FROM (SELECT p.source_id, n.name AS node_name, n.node_type, {H('p.y','p.x','n.lat','n.lon')} AS km, ROW_NUMBER() OVER (PARTITION BY p.source_id ORDER BY {H('p.y','p.x','n.lat','n.lon')}, n.source_id) AS rn
 FROM x_poi p, x_transit_node n) z WHERE rn=1 AND ROUND(km*1000,1)<=1200""",
    x_qual_raw="""SELECT p.source_id, NULLIF(trim(COALESCE(t_street,t_place,'')),'') AS q1, CASE WHEN node_name NOT LIKE 'Transport node %' THEN CASE WHEN node_type IN ('station','halt','tram_stop','stop') THEN node_name ELSE
 COALESCE(NULLIF(trim(regexp_replace(node_name,'^(?:before|after|opposite|opp|bef|aft)\\.?\\s+','','i')),''), node_name) END END AS q2 FROM x_poi p LEFT JOIN x_near_node n USING (source_id)""",
    x_qual=f"SELECT source_id, {_clean.format(c='q1')} AS q1, {_clean.format(c='q2')} AS q2 FROM x_qual_raw",
)


@query("prj_qualifiers", """SELECT source_id, concat_ws('|', CASE WHEN length(q1) BETWEEN 2 AND 40 THEN q1 END, CASE WHEN length(q2) BETWEEN 2 AND 40 AND NOT COALESCE(length(q1) BETWEEN 2 AND 40 AND lower(q1)=lower(q2),FALSE) THEN q2 END) AS qualifiers FROM x_qual""")
def _(g):
    return refresh.with_qualifiers(pois(g), refresh.nodes(city(g))).select("source_id", F.array_join("qualifiers", "|").alias("qualifiers"))


@query("win_poi_dedupe")
def _(g):
    return refresh.deduped(pois(g)).select("source_id", "dedupe_key")


@query("win_outlet_dedupe", """SELECT arg_min(p.source_id, p.source_id) AS source_id, COALESCE(m.mall_id,'poi:' || p.source_id) AS hub_source_id FROM x_poi p JOIN x_mall_of m USING (source_id)
 GROUP BY COALESCE(m.mall_id,'poi:' || p.source_id), trim(regexp_replace(lower(COALESCE(brand_name, t_name, cats[1] || ' ' || p.source_id)),'[^a-z0-9]+',' ','g')), cats[1]""")
def _(g):
    return refresh.first_outlets(refresh.with_hub(pois(g), refresh.malls(city(g)))).select("source_id", "hub_source_id")


@query("win_unique_names")
def _(g):
    rows = refresh.with_qualifiers(pois(g), refresh.nodes(city(g)))
    return catalog.unique_names(rows.select(F.col("source_id").alias("id"), F.lit("hub").alias("scope"), F.col("display_name").alias("base"), "qualifiers"))


def refreshed(g):
    if "refresh" not in g._made:
        g._made["refresh"] = refresh.run(city(g), catalog.alias_table(g.spark), catalog.label_table(g.spark))
    return g._made["refresh"]


@query("pipe_catalog")
def _(g):
    return refreshed(g)["outlets"]


@query("agg_ingest_report")
def _(g):
    return refresh.report(elements(g), refreshed(g))


@query("prj_location_context", f"""SELECT h.hub_id, CASE WHEN h.address IS NOT NULL AND h.address<>'' THEN 'address' WHEN h.semantic_type='mall' THEN 'mall' WHEN h.semantic_type='station_area' AND f.node_m<=1200 THEN 'station_area'
 WHEN m.hub_id IS NOT NULL THEN 'nearby_mall' WHEN f.node_m<=1200 THEN 'station' ELSE 'area' END AS context_kind, (CASE WHEN h.address IS NOT NULL AND h.address<>'' THEN 1e0 WHEN h.semantic_type='mall' THEN 0.95e0 WHEN h.semantic_type='station_area' AND f.node_m<=1200 THEN 0.88e0
 WHEN m.hub_id IS NOT NULL THEN 0.82e0 WHEN f.node_m<=1200 THEN 0.72e0 ELSE 0.5e0 END) AS location_quality FROM b_hub h JOIN x_fact f ON f.hub_id=h.hub_id LEFT JOIN x_near_mall m ON m.hub_id=h.hub_id""")
def _(g):
    return catalog.location_context(g.hub, plan(g).facts(), g.node).select("hub_id", "context_kind", "location_quality")


@query("prj_data_quality", "SELECT * FROM x_quality")
def _(g):
    return plan(g).quality()


# stands around every mall, from its door to beyond the reach of the join
BINDINGS["b_stand"] = """SELECT p_partkey + 1000000000 AS hub_id, 'Stand ' || p_name AS name, 1.22e0 + ((p_partkey * 7919) % 2500) / 1e4 + (p_partkey % 9) * 0.0005e0 AS lat,
 103.62e0 + ((p_partkey * 104729) % 4600) / 1e4 + (p_partkey % 4) * 0.0001e0 AS lon, 'standalone' AS semantic_type, 'unknown' AS closure_status FROM part WHERE p_partkey % 20 = 0"""
_apart = "sqrt(pow((h.lat-k.lat)*110570e0,2)+pow((h.lon-k.lon)*111320e0*cos(radians((h.lat+k.lat)/2)),2))"


@query("join_nearby_mall", f"""SELECT hub_id, nearby_mall, ROUND(m,1) AS nearby_mall_m FROM (SELECT h.hub_id, k.name AS nearby_mall, {_apart} AS m, ROW_NUMBER() OVER (PARTITION BY h.hub_id ORDER BY {_apart}, k.name) AS rn
 FROM (SELECT hub_id, lat, lon FROM b_hub WHERE semantic_type<>'mall' UNION ALL SELECT hub_id, lat, lon FROM b_stand) h JOIN b_hub k ON k.semantic_type='mall' AND k.closure_status<>'closed') z WHERE rn=1 AND m<=350""")
def _(g):
    fields = ["hub_id", "name", "lat", "lon", "semantic_type", "closure_status"]
    hubs = g.hub.select(fields).unionByName(g.stand.select(fields))
    return hubs.filter("semantic_type <> 'mall'").join(catalog.nearby_mall(hubs), ["lat", "lon"]).select("hub_id", "nearby_mall", "nearby_mall_m")


@query("top_area", "SELECT hub_id, area FROM (SELECT h.hub_id, a.area, ROW_NUMBER() OVER (PARTITION BY h.hub_id ORDER BY pow(h.lat-a.lat,2)+pow(h.lon-a.lon,2), a.i) AS rn FROM b_hub h, x_centre a) z WHERE rn=1")
def _(g):
    return catalog.nearest_area(g.hub, g.spark).select("hub_id", "area")


define(x_centre=params.values_sql([(i, *row) for i, row in enumerate(params.AREA_CENTRES)], "i, area, lat, lon"))
define(
    x_incoming="""SELECT name, lat + 0.001e0 AS lat, lon FROM b_hub WHERE source='curated'
 UNION ALL SELECT name, lat + CASE WHEN hub_id % 3 = 0 THEN 0.001e0 ELSE 0.01e0 END, lon FROM x_kept_hub WHERE hub_id % 6 < 4""",
    x_kept_hub="SELECT * FROM b_hub WHERE source<>'curated'",
)


def incoming(g):
    """A fresh capture of the hubs one source holds, moved a little, and of hubs of other sources, some moved far."""
    held = F.col("source") == "curated"
    return g.hub.filter(held | (F.col("hub_id") % 6 < 4)).withColumn("lat", F.col("lat") + F.when(held | (F.col("hub_id") % 3 == 0), 0.001).otherwise(0.01))


@query("join_superseded", f"""SELECT DISTINCT h.hub_id FROM x_kept_hub h JOIN x_incoming i ON {_norm('h.name')}={_norm('i.name')} AND {H('h.lat','h.lon','i.lat','i.lon')}<=0.4""")
def _(g):
    return catalog.superseded(g.hub.filter("source <> 'curated'"), incoming(g)).select("hub_id")


@query("set_superseded_seed", "SELECT hub_id, name FROM b_hub WHERE source='curated' AND name NOT IN (SELECT name FROM b_hub WHERE source<>'curated')")
def _(g):
    known = g.hub.filter("source <> 'curated'").select("name").distinct()
    return g.hub.filter("source = 'curated'").join(known, "name", "left_anti").select("hub_id", "name")


@query("set_union_catalog", "SELECT hub_id, name FROM b_hub WHERE source='curated' UNION ALL SELECT hub_id + 1000000000, name FROM x_kept_hub WHERE name NOT IN (SELECT name FROM b_hub WHERE source='curated')")
def _(g):
    known = g.hub.filter("source = 'curated'").select("hub_id", "name")
    extra = g.hub.filter("source <> 'curated'").select((F.col("hub_id") + 1000000000).alias("hub_id"), "name")
    return known.unionByName(extra.join(known.select("name").distinct(), "name", "left_anti"))


@query("set_leaf_categories", "SELECT c.slug, COUNT(o.outlet_id) AS outlets FROM b_category c LEFT JOIN b_outlet o ON o.category_idx=c.category_idx WHERE c.slug NOT IN (SELECT parent_slug FROM b_category WHERE parent_slug IS NOT NULL) GROUP BY c.slug")
def _(g):
    parents = g.category.select(F.col("parent_slug").alias("slug")).filter("slug IS NOT NULL").distinct()
    leaves = g.category.join(parents, "slug", "left_anti")
    counts = g.outlet.groupBy("category_idx").agg(F.count("*").alias("outlets"))
    return leaves.join(counts, "category_idx", "left").select("slug", F.coalesce("outlets", F.lit(0)).cast("bigint").alias("outlets"))


@query("src_taxonomy", "SELECT c.slug, c.parent_slug, l.heading, COUNT(o.outlet_id) AS outlets, COUNT(DISTINCT o.brand_idx) AS brands FROM b_category c JOIN b_label l ON l.slug=c.slug LEFT JOIN b_outlet o ON o.category_idx=c.category_idx GROUP BY c.slug, c.parent_slug, l.heading")
def _(g):
    used = g.outlet.groupBy("category_idx", "brand_idx").agg(F.count("*").alias("n")).groupBy("category_idx").agg(F.sum("n").alias("outlets"), F.count("brand_idx").alias("brands"))
    labels = catalog.label_table(g.spark)
    return g.category.join(labels, "slug").join(used, "category_idx", "left").select(
        "slug", "parent_slug", "heading", F.coalesce("outlets", F.lit(0)).cast("bigint").alias("outlets"), F.coalesce("brands", F.lit(0)).cast("bigint").alias("brands")
    )


define(
    x_cat_count="SELECT c.slug, c.parent_slug, COUNT(o.outlet_id) AS n FROM b_category c LEFT JOIN x_open_outlet o ON o.category_idx=c.category_idx GROUP BY c.slug, c.parent_slug",
    x_cat_catalog="""SELECT c.slug, c.parent_slug, CAST(CASE WHEN c.n>0 THEN c.n ELSE COALESCE((SELECT SUM(k.n) FROM x_cat_count k WHERE k.parent_slug=c.slug),0) END AS BIGINT) AS outlet_count FROM x_cat_count c""",
)


@query("agg_category_catalog", "SELECT * FROM x_cat_catalog WHERE outlet_count>0")
def _(g):
    return catalog.category_catalog(g.category, g.outlet)


@query("agg_brand_catalog", """SELECT b.slug, b.brand_name, (SELECT string_agg(alias, ',' ORDER BY alias) FROM b_alias a WHERE a.brand_slug=b.slug) AS aliases, COUNT(o.outlet_id) AS outlet_count,
 (SELECT string_agg(slug, ',' ORDER BY slug) FROM (SELECT DISTINCT c.slug FROM x_open_outlet o2 JOIN b_category c ON c.category_idx=o2.category_idx WHERE o2.brand_idx=b.brand_idx) z) AS categories FROM b_brand b LEFT JOIN x_open_outlet o ON o.brand_idx=b.brand_idx GROUP BY b.slug, b.brand_name, b.brand_idx""")
def _(g):
    return catalog.brand_catalog(g.brand, catalog.alias_table(g.spark), g.outlet, g.category)


@query("agg_catalog_stats", """SELECT (SELECT COUNT(*) FROM b_outlet) AS outlets, (SELECT COUNT(*) FROM x_open_outlet) AS active_outlets, (SELECT COUNT(DISTINCT brand_idx) FROM b_outlet) AS brands, (SELECT COUNT(DISTINCT category_idx) FROM b_outlet) AS categories,
 (SELECT COUNT(*) FROM b_hub) AS hubs, (SELECT COUNT(*) FROM b_hub WHERE semantic_type='mall') AS malls, (SELECT COUNT(*) FROM b_node) AS transport_nodes, (SELECT COUNT(*) FROM b_outlet WHERE opening_hours IS NOT NULL AND opening_hours<>'') AS known_hours,
 (SELECT COUNT(*) FROM b_outlet WHERE closure_status='closed') AS closed_outlets, (SELECT COUNT(*) FROM x_stop) AS stops, (SELECT COUNT(*) FROM x_route) AS route_rows, (SELECT COUNT(*) FROM x_logo) AS logos""")
def _(g):
    from ..operators import timetable
    from ..sources import sinks

    return catalog.stats(g.outlet, g.hub, g.node, timetable.stops(g.raw_stop), timetable.routes(g.bus_route), sinks.merge_logos(g.logo_old, g.logo_new))


@query("prj_hub_label", """SELECT h.hub_id, CASE WHEN h.semantic_type='standalone' AND h.source='openstreetmap' THEN COALESCE(s.first_store, h.name) ELSE h.name END AS label, FALSE AS leaks FROM b_hub h LEFT JOIN (
 SELECT o.hub_id, MIN(COALESCE(b.brand_name, k.name || ' shop')) AS first_store FROM x_open_outlet o JOIN b_hub k ON k.hub_id=o.hub_id LEFT JOIN b_brand b ON b.brand_idx=o.brand_idx GROUP BY o.hub_id) s ON s.hub_id=h.hub_id""")
def _(g):
    stores = g.outlet.filter("closure_status <> 'closed'").join(g.brand, "brand_idx", "left").join(g.hub.select("hub_id", F.col("name").alias("hub_name")), "hub_id")
    named = stores.select("hub_id", F.coalesce("brand_name", F.concat("hub_name", F.lit(" shop · node/"), F.col("outlet_id").cast("string"))).alias("store"))
    return catalog.hub_labels(g.hub.withColumn("name", F.concat("name", F.lit(" · mall:way/"), F.col("hub_id").cast("string"))), named)


@query("join_hub_stores")
def _(g):
    from ..sources import sinks

    # the brand key that the map extract gives the outlet, where it is one
    key = F.when((F.col("outlet_id") % 9 != 0) & F.col("brand_idx").isNotNull(), F.concat(F.lit("Q"), (F.col("brand_idx") + 1000).cast("string")))
    logos = sinks.merge_logos(g.logo_old, g.logo_new)
    return catalog.hub_stores(g.hub, g.outlet.withColumn("brand_key", key), g.brand, g.category, plan(g).facts(), g.node, logos)


@query("set_category_coverage", """SELECT trip_id, hub_id, array_to_string(list_sort(list_filter(wanted, lambda w: list_contains(cats, w))),',') AS covered, array_to_string(list_sort(list_filter(wanted, lambda w: NOT list_contains(cats, w))),',') AS missing FROM (
 SELECT s.trip_id, s.hub_id, list_filter([q.c1, q.c2], lambda v: v IS NOT NULL) AS wanted, (SELECT list(category) FROM x_hubcat k WHERE k.hub_id=s.hub_id) AS cats FROM x_selected s JOIN x_search q ON q.sid=s.sid WHERE s.sid % 8 = 0) z""")
def _(g):
    sets = plan(g).hub_rows().groupBy("hub_id").agg(F.collect_set(F.col("category").cast("bigint")).alias("cats"))
    rows = plan(g).shortlist().filter("sid % 8 = 0").join(sets, "hub_id")
    wanted = F.array_compact(F.array("c1", "c2"))
    show = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return rows.select("trip_id", "hub_id", show(F.array_intersect(wanted, "cats")).alias("covered"), show(F.array_except(wanted, F.col("cats"))).alias("missing"))
