"""Search and resolution queries."""

from pyspark.sql import functions as F

from .. import params
from ..functions import geo, text
from ..operators import catalog, search
from ..tables import BINDINGS
from .catalog import _compact, _norm, flat
from .registry import define, query
from .trips import H, S, plan

BINDINGS["b_query"] = "SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT substr(p_name, 1, 4) FROM part UNION SELECT DISTINCT lower(p_type) FROM part"
BINDINGS["b_code"] = "SELECT DISTINCT LPAD(CAST((c_custkey * 37) % 820000 + 10000 AS STRING), 6, '0') AS code FROM customer"
BINDINGS["b_location"] = """SELECT DISTINCT CASE c_custkey % 7 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' mrt' WHEN 2 THEN 'L' || CAST(n_regionkey AS STRING) || CAST(1 + c_custkey % 5 AS STRING)
 WHEN 3 THEN replace(n_name, 'TION', 'TON') || ' station' WHEN 4 THEN replace(n_name, 'NAT', 'NTA') WHEN 5 THEN c_name ELSE p_name || ' ' || CAST(p_partkey % 97 AS STRING) END AS q
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = CAST(FLOOR(c_custkey * 4e0 / 3e0) AS BIGINT)"""
BINDINGS["b_lead"] = """SELECT o_orderkey AS lead_id, 'Try ' || p_name || ' ' || CAST(p_partkey % 97 AS STRING) || ' today at ' || CASE o_orderkey % 3 WHEN 0 THEN 'Copper Road' ELSE p_type || ' Road' END || ', friends' AS text
 FROM orders JOIN part ON p_partkey = CAST(FLOOR(o_orderkey * 2e0 / 15e0) AS BIGINT)"""


def entries(g):
    return search.catalog_entries(g.category, catalog.label_table(g.spark), g.brand, catalog.alias_table(g.spark), g.outlet, g.hub)


def documents(g):
    return g.make("search documents", lambda: search.search_documents(g.outlet, g.hub, g.brand, catalog.alias_table(g.spark), g.category))


define(
    x_shop="SELECT o.*, h.name, h.address, h.lat, h.lon, h.source FROM x_open_outlet o JOIN b_hub h ON h.hub_id=o.hub_id AND h.closure_status<>'closed'",
    x_entry="""SELECT 'category' AS kind, l.heading AS label, c.outlet_count, unnest([trim(regexp_replace(lower(l.heading),'[^a-z0-9]+',' ','g')), replace(c.slug,'_',' ')]) AS key FROM x_cat_catalog c JOIN b_label l ON l.slug=c.slug WHERE c.outlet_count>0
 UNION ALL SELECT 'brand', b.brand_name, n, key FROM b_brand b JOIN (SELECT brand_idx, COUNT(*) AS n FROM x_shop WHERE brand_idx IS NOT NULL GROUP BY brand_idx) z ON z.brand_idx=b.brand_idx JOIN (SELECT brand_slug, alias AS key FROM b_alias UNION SELECT slug, lower(brand_name) FROM b_brand) k ON k.brand_slug=b.slug
 UNION ALL SELECT 'place', name, COUNT(*), lower(name) FROM x_shop WHERE brand_idx IS NULL GROUP BY name""",
    x_hit="SELECT DISTINCT q, trim(regexp_replace(lower(q),'[^a-z0-9]+',' ','g')) AS needle, kind, label, outlet_count FROM b_query JOIN x_entry ON contains(key, trim(regexp_replace(lower(q),'[^a-z0-9]+',' ','g')))",
    x_result="""SELECT q, kind, label, outlet_count, ROW_NUMBER() OVER (PARTITION BY q ORDER BY CASE WHEN kind='category' THEN 0 ELSE 1 END, CASE WHEN CASE WHEN kind='category' THEN trim(regexp_replace(lower(label),'[^a-z0-9]+',' ','g')) ELSE lower(label) END=needle THEN 0 ELSE 1 END, outlet_count DESC, label, kind) AS place FROM x_hit""",
)


@query("top_catalog_search", "SELECT q, kind, label, outlet_count, CAST(place AS INTEGER) AS place FROM x_result WHERE place<=20")
def _(g):
    return search.catalog_search(g.query, entries(g)).select("q", "kind", "label", "outlet_count", "place")


@query("set_distinct_labels", "SELECT q, kind, arg_min(label, place) AS label FROM x_result WHERE place<=20 GROUP BY q, kind, lower(label)")
def _(g):
    return search.distinct_labels(search.catalog_search(g.query, entries(g)))


define(
    x_hub_hit=f"""SELECT q, hub_id, name, regexp_replace(lower(name),'[ @-]','','g')=replace({_norm('q')},' ','') AS exact FROM {{src}} JOIN b_hub h ON h.closure_status<>'closed' AND {_norm('q')}<>'' AND (contains(lower(name),{_norm('q')})
 OR lower(name) LIKE '%' || replace({_norm('q')},' ','%') || '%' OR contains(regexp_replace(lower(name),'[ @-]','','g'), replace({_norm('q')},' ','')))""".replace("{src}", "b_query"),
)


@query("top_hub_search", "SELECT q, hub_id, CAST(place AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, name, hub_id) AS place FROM x_hub_hit) z WHERE place<=6")
def _(g):
    return search.hub_search(g.query, g.hub).select("q", "hub_id", "place")


@query("join_brand_resolve", f"""SELECT n.t_name AS value, k.slug FROM (SELECT DISTINCT t_name FROM b_element WHERE t_name IS NOT NULL UNION SELECT DISTINCT t_brand FROM b_element WHERE t_brand IS NOT NULL) n JOIN (SELECT brand_slug AS slug, alias AS key FROM b_alias UNION SELECT slug, {_norm('brand_name')} FROM b_brand UNION SELECT slug, {_norm('slug')} FROM b_brand) k ON k.key={_norm('n.t_name')}""")
def _(g):
    values = flat(g).select(F.explode(F.array_compact(F.array("t_name", "t_brand"))).alias("value")).distinct()
    keys = search.brand_keys(g.brand, catalog.alias_table(g.spark))
    return values.withColumn("key", text.normalize("value")).join(keys, "key").select("value", "slug").distinct()


@query("join_place_resolve", f"SELECT DISTINCT n.t_name AS value, s.name AS place FROM (SELECT DISTINCT t_name FROM b_element WHERE t_name IS NOT NULL) n JOIN x_shop s ON s.brand_idx IS NULL AND {_norm('s.name')}={_norm('n.t_name')}")
def _(g):
    values = flat(g).select(F.col("t_name").alias("value")).filter("value IS NOT NULL").distinct().withColumn("key", text.normalize("value"))
    places = entries(g).filter("kind = 'place'").select(F.col("label").alias("place"), text.normalize("label").alias("key"))
    return values.join(places, "key").select("value", "place").distinct()


define(
    x_document=f"""SELECT s.outlet_id, s.category_idx, COALESCE(b.brand_name, s.name) AS label, b.brand_name, s.name, s.address, s.source, c.slug AS category, s.lat, s.lon, {_norm('b.brand_name')} || ' | ' || replace(c.slug,'_',' ') || ' | ' || {_norm('s.name')} || ' | ' || {_norm('s.address')} || ' | ' || COALESCE((SELECT string_agg(alias, ' | ' ORDER BY alias) FROM b_alias a WHERE a.brand_slug=b.slug),'') AS doc
 FROM x_shop s LEFT JOIN b_brand b ON b.brand_idx=s.brand_idx JOIN b_category c ON c.category_idx=s.category_idx""",
    x_phrase=f"SELECT DISTINCT {_norm('q')} AS phrase FROM b_query WHERE {_norm('q')}<>'' UNION SELECT alias FROM b_alias",
    x_phrase_hit="SELECT phrase, outlet_id, label, category_idx, lat, lon FROM x_phrase JOIN x_document ON contains(' ' || doc || ' ', ' ' || phrase || ' ')",
)


def phrases(g):
    return g.query.select(text.normalize("q").alias("phrase")).filter("phrase <> ''").union(catalog.alias_table(g.spark).select("alias")).distinct()


@query("sink_postings", "SELECT DISTINCT outlet_id, token FROM (SELECT outlet_id, unnest(string_split(replace(doc,'|',' '),' ')) AS token FROM x_document) z WHERE token<>''")
def _(g):
    return search.postings(documents(g))


@query("join_postal", """SELECT code, ROUND(COALESCE(lat, s_lat),6) AS lat, ROUND(COALESCE(lon, s_lon),6) AS lon, lat IS NULL AS approximate FROM b_code c LEFT JOIN (SELECT regexp_extract(address,'Singapore ([0-9]{6})$',1) AS k, arg_min(lat,hub_id) AS lat, arg_min(lon,hub_id) AS lon FROM b_hub WHERE regexp_matches(address,'Singapore [0-9]{6}$') GROUP BY 1) e ON e.k=c.code
 LEFT JOIN (SELECT substr(regexp_extract(address,'Singapore ([0-9]{6})$',1),1,2) AS s, AVG(lat) AS s_lat, AVG(lon) AS s_lon FROM b_hub WHERE regexp_matches(address,'Singapore [0-9]{6}$') GROUP BY 1) x ON x.s=substr(c.code,1,2) WHERE lat IS NOT NULL OR s_lat IS NOT NULL""")
def _(g):
    return search.postal(g.code, g.hub)


_stalias = "unnest([name, name || ' MRT', name || ' station', name || ' MRT station', line || CAST(ordinal AS VARCHAR), line || ' ' || CAST(ordinal AS VARCHAR)])"
define(
    x_station_alias=f"SELECT station_id, name, {_stalias} AS alias FROM b_station",
    x_alias_key=f"SELECT DISTINCT station_id, name, unnest([{_norm('alias')}, {_compact('alias')}]) AS key FROM x_station_alias",
    x_exact_station=f"SELECT DISTINCT q, station_id, name FROM b_location JOIN x_alias_key ON key={_norm('q')} OR key={_compact('q')}",
    x_exact_conf="SELECT q, station_id, name, CASE WHEN COUNT(*) OVER (PARTITION BY q)=1 THEN 'exact' ELSE 'ambiguous' END AS confidence FROM x_exact_station",
    x_similar=f"""SELECT q, {_compact('q')} AS tight, station_id, name, {_compact('alias')} AS alias_key, 1-levenshtein({_compact('q')},{_compact('alias')})*1e0/GREATEST(length({_compact('q')}),length({_compact('alias')})) AS similarity FROM b_location, x_station_alias WHERE {_compact('q')}<>''""",
    x_best_alias="SELECT q, tight, station_id, name, MAX(similarity) AS similarity, MAX(alias_key) FILTER (WHERE similarity=best) AS alias_key FROM (SELECT *, MAX(similarity) OVER (PARTITION BY q, station_id) AS best FROM x_similar) z GROUP BY q, tight, station_id, name",
    x_fuzzy_ok="SELECT * FROM x_best_alias WHERE similarity>=0.84 AND (regexp_replace(tight,'[^0-9]','','g')='' OR contains(alias_key, regexp_replace(tight,'[^0-9]','','g')))",
    x_fuzzy_rank="SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY similarity DESC, name, station_id) AS place, LEAD(similarity) OVER (PARTITION BY q ORDER BY similarity DESC, name, station_id) AS runner FROM x_fuzzy_ok",
    x_fuzzy="SELECT r.q, r.station_id, r.name, r.similarity, CASE WHEN f.runner IS NULL OR f.similarity-f.runner>=0.06-1e-9 THEN 'strong' ELSE 'ambiguous' END AS confidence FROM x_fuzzy_rank r JOIN x_fuzzy_rank f ON f.q=r.q AND f.place=1 WHERE r.place=1 OR NOT (f.runner IS NULL OR f.similarity-f.runner>=0.06-1e-9)",
)


@query("join_station_alias", "SELECT q, station_id, confidence FROM x_exact_conf")
def _(g):
    return search.exact_stations(g.location, search.station_aliases(g.station)).select("q", "station_id", "confidence")


@query("join_fuzzy_station", "SELECT q, station_id, ROUND(similarity,6) AS similarity, confidence FROM x_fuzzy")
def _(g):
    return search.fuzzy_stations(g.location, search.station_aliases(g.station)).select("q", "station_id", F.round("similarity", 6).alias("similarity"), "confidence")


@query("top_suggestions", "SELECT q, name, ROUND(s,6) AS similarity FROM (SELECT q, name, MAX(similarity) AS s, ROW_NUMBER() OVER (PARTITION BY q ORDER BY MAX(similarity) DESC, name DESC) AS rn FROM x_similar WHERE similarity>=0.6 AND length(tight)>=3 GROUP BY q, name) z WHERE rn<=3")
def _(g):
    return search.suggestions(g.location, search.station_aliases(g.station)).select("q", "name", F.round("similarity", 6).alias("similarity"))


define(
    x_loc_hub=f"""SELECT * FROM (SELECT q, hub_id, name, exact, ROW_NUMBER() OVER (PARTITION BY q ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, name, hub_id) AS place FROM (SELECT q, hub_id, name, regexp_replace(lower(name),'[ @-]','','g')=replace({_norm('q')},' ','') AS exact FROM b_location JOIN b_hub h ON h.closure_status<>'closed' AND {_norm('q')}<>'' AND (contains(lower(name),{_norm('q')})
 OR lower(name) LIKE '%' || replace({_norm('q')},' ','%') || '%' OR contains(regexp_replace(lower(name),'[ @-]','','g'), replace({_norm('q')},' ','')))) y) z WHERE place<=6""",
    x_twin=f"SELECT h.q, h.hub_id FROM x_loc_hub h WHERE exact AND q IN (SELECT q FROM x_exact_station WHERE {_compact('q')}={_compact('name')})",
)


@query("set_location_cascade", """SELECT q, 'station' AS source, CAST(station_id AS BIGINT) AS entity, CASE WHEN q IN (SELECT q FROM x_twin) THEN 'ambiguous' ELSE confidence END AS confidence FROM x_exact_conf
 UNION ALL SELECT q, 'hub', hub_id, 'ambiguous' FROM x_twin UNION ALL SELECT q, 'similar', CAST(station_id AS BIGINT), confidence FROM x_fuzzy WHERE q NOT IN (SELECT q FROM x_exact_station)
 UNION ALL SELECT q, 'hub', hub_id, CASE WHEN MAX(CASE WHEN place=1 AND exact THEN 1 ELSE 0 END) OVER (PARTITION BY q)=1 THEN 'exact' WHEN COUNT(*) OVER (PARTITION BY q)=1 THEN 'likely' ELSE 'ambiguous' END FROM x_loc_hub WHERE q NOT IN (SELECT q FROM x_exact_station) AND q NOT IN (SELECT q FROM x_fuzzy)""")
def _(g):
    return search.location_cascade(g.location, search.station_aliases(g.station), g.hub)


_rules = " ".join("WHEN " + " OR ".join(f"contains(t,'{w}')" for w in words) + f" THEN '{c}'" for words, c in search.PLACE_WORDS)


@query("prj_place_category", f"SELECT source_id, CASE {_rules} END AS category FROM (SELECT source_id, lower(COALESCE(t_name,'') || ' ' || COALESCE(t_amenity,'') || ' ' || COALESCE(t_shop,'')) AS t FROM x_located) z")
def _(g):
    rows = flat(g).withColumn("t", F.lower(F.concat_ws(" ", F.coalesce("t_name", F.lit("")), F.coalesce("t_amenity", F.lit("")), F.coalesce("t_shop", F.lit("")))))
    return rows.select(F.concat("kind", F.lit("/"), F.col("id").cast("string")).alias("source_id"), search.place_category("t").alias("category"))


define(
    x_lead_text=f"SELECT text, {_norm('text')} AS norm, lower(regexp_extract(text,'\\bat ([A-Z][A-Za-z]+(?: [A-Z][a-z]+)?)',1)) AS hint FROM (SELECT DISTINCT text FROM b_lead) d",
    x_hub_text=f"SELECT hub_id, ' ' || {_norm('name')} || ' ' AS norm, ' ' || {_norm('address')} || ' ' AS spot FROM b_hub WHERE closure_status<>'closed'",
    x_lead_hit="SELECT t.text, h.hub_id FROM x_lead_text t JOIN x_hub_text h ON contains(' ' || t.norm || ' ', h.norm) WHERE t.hint='' OR contains(h.spot, ' ' || t.hint || ' ')",
)


@query("join_place_grounding", "SELECT l.lead_id, x.hub_id FROM b_lead l JOIN x_lead_hit x ON x.text=l.text")
def _(g):
    return search.grounded(g.lead, g.hub).select("lead_id", "hub_id")


@query("prj_location_hints")
def _(g):
    leads = g.lead.select(F.concat(F.lit("lead/"), F.col("lead_id").cast("string")).alias("id"), "text")
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>", " "), "<[^>]+>", " "))
    whole = leads.unionByName(g.pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("id"), plain.alias("text")))
    return whole.select("id", F.posexplode(search.location_hints("text")).alias("n", "hint"))


@query("join_exact_place", f"""SELECT p.sid, p.stop1, p.stop2, EXISTS (SELECT 1 FROM x_open_outlet o JOIN b_hub h ON h.hub_id=o.hub_id WHERE o.brand_idx IS NULL AND o.category_idx=p.c1 AND h.hub_id=CASE WHEN p.n_stops=1 OR p.first_low THEN p.stop1 ELSE p.stop2 END AND {_norm('h.name')}={_norm('w.name')}) AS met
 FROM x_pruned p JOIN b_hub w ON w.hub_id=CAST(FLOOR(p.trip_id * 2e0 / 15e0) AS BIGINT)""")
def _(g):
    options = plan(g).pruned()
    wants = g.trip.select("trip_id", F.floor(F.col("trip_id") * 2.0 / 15.0).cast("long").alias("hub_id")).join(g.hub.select("hub_id", text.normalize("name").alias("place")), "hub_id").drop("hub_id")
    offers = g.outlet.filter("closure_status <> 'closed' AND brand_idx IS NULL").join(g.hub.select("hub_id", text.normalize("name").alias("place")), "hub_id").select(
        F.col("hub_id").alias("at"), F.col("category_idx").alias("c1"), "place", F.lit(True).alias("met")
    ).distinct()
    rows = options.join(wants, "trip_id").withColumn("at", F.when((F.col("n_stops") == 1) | F.col("first_low"), F.col("stop1")).otherwise(F.col("stop2")))
    return rows.join(offers, ["at", "c1", "place"], "left").select("sid", "stop1", "stop2", F.coalesce("met", F.lit(False)).alias("met"))


def found_places(g):
    """Discovered places: every phrase is a search, its hits one source's answers."""
    hits = search.phrase_hits(phrases(g), documents(g), search.postings(documents(g)))
    return hits.select(
        F.col("phrase").alias("search"), F.concat("phrase", F.lit("#"), F.lpad(F.col("outlet_id").cast("string"), 14, "0")).alias("id"), F.col("label").alias("name"), "address", "lat", "lon",
        F.array("source").alias("provenance"), F.when(F.col("brand_idx").isNotNull(), 2).otherwise(1).alias("tier"), F.when(F.col("brand_idx").isNotNull(), 1.0).otherwise(0.7).alias("relevance"),
    )


@query("win_place_dedupe")
def _(g):
    return catalog.merge_places(found_places(g)).withColumn("provenance", F.array_join("provenance", ","))


@query("win_place_grouping")
def _(g):
    places = found_places(g).withColumn("address", F.lit(None).cast("string"))
    return catalog.merge_places(places, params.PLACE_GROUP_KM).select(F.col("place_id").alias("hub_id"), "members")


define(x_need_place=f"""SELECT t.trip_id, p.phrase, p.outlet_id, p.label, CASE WHEN p.label IN (SELECT brand_name FROM b_brand) THEN 1e0 ELSE 0.7e0 END AS relevance, {S('p.lat','p.lon','t.o_lat','t.o_lon','t.d_lat','t.d_lon')} AS km, LEAST({H('p.lat','p.lon','t.o_lat','t.o_lon')},{H('p.lat','p.lon','t.d_lat','t.d_lon')}) AS ends
 FROM b_trip t JOIN b_request r ON r.request_id=t.trip_id JOIN x_phrase_hit p ON p.phrase={_norm('r.text')}""")


def need_places(g):
    asked = g.request.withColumn("phrase", text.normalize("text")).select(F.col("request_id").alias("trip_id"), "phrase")
    hits = search.phrase_hits(phrases(g).join(asked.select("phrase").distinct(), "phrase", "left_semi"), documents(g), search.postings(documents(g)))
    rows = asked.join(hits, "phrase").join(g.trip.select("trip_id", "o_lat", "o_lon", "d_lat", "d_lon"), "trip_id")
    rows = geo.with_segment_km(rows, "km", ("o_lat", "o_lon"), ("d_lat", "d_lon"))
    ends = F.least(geo.haversine_km("lat", "lon", "o_lat", "o_lon"), geo.haversine_km("lat", "lon", "d_lat", "d_lon"))
    return rows.withColumn("relevance", F.when(F.col("brand_name").isNotNull(), 1.0).otherwise(0.7)).withColumn(
        "relevant", (F.col("km") <= params.CORRIDOR_KM) | (ends <= params.ENDPOINT_KM)
    )


@query("join_context_relevant", "SELECT trip_id, outlet_id FROM x_need_place WHERE km<=2.5 OR ends<=2")
def _(g):
    return need_places(g).filter("relevant").select("trip_id", "outlet_id")


@query("top_need_places", "SELECT trip_id, outlet_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY CASE WHEN km<=2.5 OR ends<=2 THEN 0 ELSE 1 END, relevance DESC, km, label, outlet_id) AS rn FROM x_need_place) z WHERE rn<=10")
def _(g):
    from pyspark.sql import Window

    order = [F.when(F.col("relevant"), 0).otherwise(1), F.col("relevance").desc(), "km", "label", "outlet_id"]
    rows = need_places(g).withColumn("place", F.row_number().over(Window.partitionBy("trip_id").orderBy(*order)))
    return rows.filter("place <= 10").select("trip_id", "outlet_id", "place")
