"""Request-text queries, their measures, and planning from texts."""

from pyspark.sql import Window, functions as F

from .. import params
from ..functions import geo, text
from ..operators import candidates, requests as rq, search
from ..plans.trips import TripPlan
from ..tables import BINDINGS
from .catalog import _norm
from .registry import define, query
from .search import documents, phrases
from .trips import H, plan

BINDINGS["b_need"] = "SELECT DISTINCT p_name AS raw FROM part UNION SELECT DISTINCT upper(substr(p_name,1,1)) || substr(p_name,2) FROM part UNION SELECT DISTINCT replace(p_name,'ring','noodle') FROM part UNION SELECT DISTINCT replace(p_name,'bolt','cable') FROM part UNION SELECT DISTINCT replace(p_name,'gizmo','repair') FROM part UNION SELECT CASE n_nationkey % 5 WHEN 0 THEN 'usb c cable' WHEN 1 THEN 'mee pok' WHEN 2 THEN 'haircuts' WHEN 3 THEN 'panadol' ELSE 'birthday cakes' END FROM nation"


def _in(c, words):
    return "(" + " OR ".join(f"contains({c},'{w}')" for w in words) + ")"


_dict = []
for _b in sorted(params.BRANDS, key=lambda b: b[2]):
    _cat = next(c for c in params.CATEGORY_PRIORITY if c in _b[3])
    _own = {" ".join(rq.re.sub(r"[^a-z0-9]+", " ", w.casefold()).split()) for w in (_b[2], _b[1])} | {a for a, s in params.BRAND_ALIASES if s == _b[1]}
    _dict += [(p, _cat, _b[1], _b[2], _b[0]) for p in sorted(_own)]
_dict += [(p, c, None, None, 1000 + i) for i, (p, c) in enumerate(sorted(params.CATEGORY_PHRASES, key=lambda item: -len(item[0])))]
_win = "substr(norm, GREATEST({a}-18,1), {a}-GREATEST({a}-18,1)+length({f})+8)"
define(
    x_text=f"SELECT DISTINCT text, {_norm('text')} AS norm FROM b_request",
    x_dict=params.values_sql(_dict, "phrase, category, brand_slug, brand_name, dict_order"),
    x_found="SELECT t.text, t.norm, d.*, strpos(' ' || norm || ' ', ' ' || phrase || ' ') AS s, strpos(' ' || norm || ' ', ' ' || phrase || ' ')+length(phrase) AS e FROM x_text t JOIN x_dict d ON contains(' ' || norm || ' ', ' ' || phrase || ' ')",
    x_brand_hit="SELECT text, norm, category, brand_slug, brand_name, dict_order, MIN(s) AS s, arg_min(phrase, s*100-length(phrase)) AS phrase FROM x_found WHERE brand_slug IS NOT NULL GROUP BY text, norm, category, brand_slug, brand_name, dict_order",
    x_word_hit="SELECT * FROM x_found f WHERE brand_slug IS NULL AND NOT EXISTS (SELECT 1 FROM x_found w WHERE w.brand_slug IS NULL AND w.text=f.text AND w.s<=f.s AND f.e<=w.e AND w.e-w.s>f.e-f.s)",
    x_word="SELECT text, norm, category, MIN(s) AS s, arg_min(phrase, dict_order) AS phrase, MIN(dict_order) AS dict_order FROM x_word_hit GROUP BY text, norm, category",
    x_chicken="SELECT text, MIN(o) AS o FROM (SELECT text, -1 AS o FROM x_brand_hit WHERE category='fried_chicken' UNION ALL SELECT text, dict_order FROM x_word WHERE category='fried_chicken') z GROUP BY text",
    x_entity0="""SELECT b.text, b.norm, b.category, b.brand_slug, b.brand_name, b.phrase, CASE WHEN w.s IS NOT NULL AND b.dict_order=(SELECT MIN(k.dict_order) FROM x_brand_hit k WHERE k.text=b.text AND k.category=b.category) THEN LEAST(b.s, w.s) ELSE b.s END AS s, b.dict_order FROM x_brand_hit b LEFT JOIN x_word w ON w.text=b.text AND w.category=b.category
 UNION ALL SELECT w.text, w.norm, w.category, NULL, NULL, w.phrase, w.s, w.dict_order FROM x_word w LEFT JOIN x_chicken c ON c.text=w.text WHERE NOT EXISTS (SELECT 1 FROM x_brand_hit b WHERE b.text=w.text AND b.category=w.category) AND (w.category<>'fast_food' OR c.o IS NULL OR c.o>w.dict_order)""",
    x_entity="SELECT *, ROW_NUMBER() OVER (PARTITION BY text ORDER BY s, dict_order) AS errand_no, COUNT(*) OVER (PARTITION BY text) AS n_errands FROM x_entity0",
    x_flag=f"""SELECT *, regexp_matches(norm,'\\b' || phrase || '\\b(?: is)? if convenient') OR regexp_matches(norm,'skip (?:the )?\\b' || phrase || '\\b') OR regexp_matches(norm,'\\b' || phrase || '\\b.{{0,25}}\\boptional\\b') OR (n_errands=1 AND contains(norm,'only if it adds')) AS optional,
 regexp_matches(norm,'(?:prefer|ideally)\\s+' || phrase || '\\b') OR regexp_matches(norm,'\\b' || phrase || '\\b\\s+preferably') OR contains(norm,'any ' || replace(category,'_',' ')) OR {_in('norm', ('dont really care what brand','don t really care what brand','other fried chicken is okay'))} AS pref FROM x_entity""",
    x_cap=f"""SELECT *, regexp_extract(norm,'{rq.DETOUR}',0) AS f1, strpos(norm, regexp_extract(norm,'{rq.DETOUR}',0)) AS a1, regexp_extract(norm,'{rq.WALK_CAP}',0) AS f2, strpos(norm, regexp_extract(norm,'{rq.WALK_CAP}',0)) AS a2 FROM x_text""",
    x_window2=f"SELECT *, {_win.format(a='a1', f='f1')} AS w1, {_win.format(a='a2', f='f2')} AS w2 FROM x_cap",
    x_preference=f"""SELECT text, norm, CASE WHEN f1<>'' THEN CAST(regexp_extract(norm,'{rq.DETOUR}',1) AS DOUBLE) END AS max_detour_minutes, f1<>'' AND (regexp_matches(w1,'{rq.STRICT}') OR regexp_matches(w1,'\\bunder\\s+[0-9]+\\s*(?:min|minute)s?\\s+max\\b')) AND NOT {_in('w1',('try','prefer','ideally'))} AS max_detour_minutes_is_hard,
 CASE WHEN f2<>'' THEN CAST(regexp_extract(norm,'{rq.WALK_CAP}',1) AS DOUBLE) END AS max_walk_minutes, CASE WHEN {_in('norm', rq.LITTLE_WALKING)} THEN 'minimal' WHEN {_in('norm', rq.MUCH_WALKING)} THEN 'high' ELSE 'standard' END AS walking_tolerance,
 CASE WHEN {_in('norm', rq.NO_TRANSFER)} THEN 'no_extra' WHEN {_in('norm', rq.FEW_TRANSFERS)} THEN 'prefer_fewer' ELSE 'standard' END AS transfer_tolerance, CASE WHEN {_in('norm', rq.URGENT)} THEN 'urgent' WHEN contains(norm,'soon') THEN 'soon' ELSE 'normal' END AS urgency, {_in('norm', rq.ONE_STOP)} AS prefer_consolidated FROM x_window2""",
    x_clause_norm=f"SELECT text, unnest(list_transform(regexp_split_to_array(text,'[,;.!?]'), lambda c: trim(regexp_replace(lower(c),'[^a-z0-9]+',' ','g')))) AS c, generate_subscripts(regexp_split_to_array(text,'[,;.!?]'),1) AS i FROM x_text",
    x_unknown0=" UNION ALL ".join(f"SELECT text, {n} AS n, arg_min(trim(regexp_extract(c,'{p}',1)), i) AS value FROM x_clause_norm WHERE trim(regexp_extract(c,'{p}',1))<>'' GROUP BY text" for n, p in enumerate(rq.UNKNOWN_BRAND)),
    x_unknown=f"SELECT text, arg_min(value, n) AS unknown_brand FROM x_unknown0 u WHERE value NOT IN (SELECT phrase FROM x_dict WHERE brand_slug IS NULL) AND NOT EXISTS (SELECT 1 FROM x_entity e WHERE e.text=u.text AND (e.phrase=u.value OR {_norm('e.brand_name')}=u.value)) GROUP BY text",
    x_conflict=f"""SELECT t.text, t.norm, u.unknown_brand, COALESCE(n.n,0) AS n_errands, {_in('norm', rq.FIRM)} AND {_in('norm', rq.LOOSE)} AS brand_conflict, contains(norm,'minimal walking') AND {_in('norm', rq.MUCH_WALKING)} AS walking_conflict
 FROM x_text t LEFT JOIN x_unknown u ON u.text=t.text LEFT JOIN (SELECT text, COUNT(*) AS n FROM x_entity GROUP BY text) n ON n.text=t.text""",
    x_status=f"""SELECT *, CASE WHEN norm='' OR {_in('norm', ('caffeinated','stock the pantry'))} THEN 'unresolved' WHEN brand_conflict OR walking_conflict THEN 'needs_clarification' WHEN unknown_brand IS NOT NULL OR n_errands=0 THEN 'unresolved' WHEN n_errands>2 THEN 'needs_clarification' ELSE 'resolved' END AS status FROM x_conflict""",
)


def texts(g):
    return g.make("texts", lambda: rq.distinct_texts(g.request))


def words(g):
    return g.make("words", lambda: rq.dictionary(g.spark))


def found(g):
    return g.keep("entities", lambda: rq.entities(texts(g), words(g)))


def statuses(g):
    return g.keep("statuses", lambda: rq.status(rq.conflicts(texts(g), found(g), g.spark)))


@query("text_clauses")
def _(g):
    talk = g.conversations.filter("role = 'user'").select("text").distinct()
    whole = texts(g).select("text").union(talk).distinct().withColumn("norm", text.normalize("text"))
    return rq.clauses(whole).select("text", "clause_no", "clause")


@query("text_entities", "SELECT r.request_id, category, brand_slug, phrase, CAST(errand_no AS INTEGER) AS errand_no FROM b_request r JOIN x_entity e ON e.text=r.text")
def _(g):
    return g.request.join(found(g), "text").select("request_id", "category", "brand_slug", "phrase", "errand_no")


@query("text_errand_flags", "SELECT text, category, optional, CASE WHEN brand_name IS NOT NULL AND pref THEN brand_name END AS preferred_brand, CASE WHEN brand_name IS NOT NULL AND NOT pref THEN brand_name END AS exact_brand, brand_name IS NULL OR pref AS substitutes_allowed FROM x_flag")
def _(g):
    return rq.errand_flags(found(g)).select("text", "category", "optional", "preferred_brand", "exact_brand", "substitutes_allowed")


@query("text_preferences", "SELECT text, max_detour_minutes, max_detour_minutes_is_hard, max_walk_minutes, walking_tolerance, transfer_tolerance, urgency, prefer_consolidated FROM x_preference")
def _(g):
    return rq.preferences(texts(g)).select("text", "max_detour_minutes", "max_detour_minutes_is_hard", "max_walk_minutes", "walking_tolerance", "transfer_tolerance", "urgency", "prefer_consolidated")


@query("text_conflicts", "SELECT text, unknown_brand, n_errands, brand_conflict, walking_conflict FROM x_conflict")
def _(g):
    return rq.conflicts(texts(g), found(g), g.spark).select("text", "unknown_brand", "n_errands", "brand_conflict", "walking_conflict")


@query("text_status", "SELECT r.request_id, s.status FROM b_request r JOIN x_status s ON s.text=r.text")
def _(g):
    return g.request.join(statuses(g), "text").select("request_id", "status")


def _first(patterns, group):
    return "COALESCE(" + ", ".join(f"CASE WHEN regexp_extract(text,'{p.replace(chr(39), chr(39) * 2)}',2)<>'' THEN regexp_extract(text,'{p.replace(chr(39), chr(39) * 2)}',{group}) END" for p in patterns) + ")"


_ORIGIN_SPAN, _DESTINATION_SPAN = _first(rq.ORIGIN_PATTERNS, 1), _first(rq.DESTINATION_PATTERNS, 1)


@query("text_journey_refs", f"""SELECT text, NULLIF(trim({_first(rq.ORIGIN_PATTERNS, 2)},' .,!?'),'') AS origin, NULLIF(trim({_first(rq.DESTINATION_PATTERNS, 2)},' .,!?'),'') AS destination,
 trim(regexp_replace(COALESCE(replace(COALESCE(replace(text, {_DESTINATION_SPAN}, ' '), text), {_ORIGIN_SPAN}, ' '), COALESCE(replace(text, {_DESTINATION_SPAN}, ' '), text)),'\\s+',' ','g'),' ,.;') AS errand_text FROM x_text""")
def _(g):
    return rq.journey_references(texts(g)).select("text", "origin", "destination", "errand_text")


define(x_mention=f"SELECT text, NULLIF(trim({_first(rq.DESTINATION_PATTERNS, 2)},' .,!?'),'') AS q FROM x_text")


@query("join_journey_conflict", f"""SELECT r.request_id, m.q AS mentioned, s.station_id, s.station_id IS NULL OR {H('s.lat','s.lon','t.d_lat','t.d_lon')}>0.5 AS conflict FROM b_request r JOIN x_mention m ON m.text=r.text AND m.q IS NOT NULL JOIN b_trip t ON t.trip_id=r.request_id
 LEFT JOIN (SELECT k.key, MIN(k.station_id) AS station_id FROM x_alias_key k GROUP BY k.key HAVING COUNT(DISTINCT station_id)=1) k ON k.key={_norm('m.q')} LEFT JOIN b_station s ON s.station_id=k.station_id""")
def _(g):
    refs = rq.journey_references(texts(g)).filter("destination IS NOT NULL").select("text", F.col("destination").alias("mentioned"))
    keys = search.station_aliases(g.station).groupBy("key").agg(F.min("station_id").alias("station_id"), F.count_distinct("station_id").alias("n")).filter("n = 1").drop("n")
    rows = g.request.join(refs, "text").withColumn("key", text.normalize("mentioned")).join(keys, "key", "left").join(g.station.select("station_id", "lat", "lon"), "station_id", "left")
    rows = rows.join(g.trip.select(F.col("trip_id").alias("request_id"), "d_lat", "d_lon"), "request_id")
    far = geo.haversine_km("lat", "lon", "d_lat", "d_lon") > 0.5
    return rows.select("request_id", "mentioned", "station_id", (F.col("station_id").isNull() | F.coalesce(far, F.lit(True))).alias("conflict"))


@query("text_validate", """SELECT r.request_id, e.category, e.brand_slug, CASE WHEN e.category IN (SELECT parent_slug FROM b_category WHERE parent_slug IS NOT NULL) THEN 'category' WHEN e.brand_slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x_open_outlet o JOIN b_brand b ON b.brand_idx=o.brand_idx JOIN b_category c ON c.category_idx=o.category_idx WHERE b.slug=e.brand_slug AND c.slug=e.category) THEN 'brand in category' END AS problem
 FROM b_request r JOIN x_entity e ON e.text=r.text""")
def _(g):
    sold = g.outlet.filter("closure_status <> 'closed'").select("brand_idx", "category_idx").distinct().join(g.brand, "brand_idx").join(g.category, "category_idx").select(F.col("brand_idx"), g.brand["slug"].alias("brand_slug"), g.category["slug"].alias("category"))
    return g.request.join(rq.validated(found(g), g.category, sold), "text").select("request_id", "category", "brand_slug", "problem")


_listed = params.values_sql([(t, "service", c, w) for t, c, w in params.SERVICE_TERMS] + [(t, "product", c, w) for t, c, w in params.PRODUCT_TERMS], "norm, k, hint, extra")
define(
    x_term_list=_listed, x_food=params.values_sql([(t,) for t in params.FOOD_TERMS], "norm"),
    x_need=f"""SELECT raw, z.norm, CASE WHEN l.k IS NOT NULL THEN l.k WHEN (regexp_matches(trim(raw),'^[A-Z][A-Za-z''’&.-]*(?:\\s+[A-Z][A-Za-z''’&.-]*){{0,3}}$') OR NOT regexp_matches(trim(raw),'{rq.NOT_A_TITLE}')) AND len(regexp_split_to_array(trim(raw),'\\s+'))<=4 AND f.norm IS NULL THEN 'specific_business' WHEN f.norm IS NOT NULL OR regexp_matches(z.norm,'{params.DISH_WORDING}') THEN 'dish'
 WHEN regexp_matches(z.norm,'{params.SERVICE_WORDING}') THEN 'service' WHEN regexp_matches(z.norm,'{params.PRODUCT_WORDING}') THEN 'product' ELSE 'unknown' END AS need_type, l.hint, l.extra
 FROM (SELECT raw, {_norm('raw')} AS norm FROM b_need) z LEFT JOIN x_term_list l ON l.norm=z.norm LEFT JOIN x_food f ON f.norm=z.norm""",
    x_typed="SELECT raw, norm, need_type, COALESCE(hint, CASE need_type WHEN 'dish' THEN 'restaurants' WHEN 'service' THEN 'repairs' END) AS category_hint, hint, extra FROM x_need",
    x_concept=params.values_sql(sorted({(a.replace("-", "").replace(" ", ""), s, k, c) for s, k, c, al in params.CONCEPTS for a in al}), "alias_key, concept, kind, category"),
    x_concept_sim=f"SELECT norm, concept, 1-levenshtein(replace(norm,' ',''),alias_key)*1e0/GREATEST(length(replace(norm,' ','')),length(alias_key)) AS s FROM (SELECT DISTINCT norm FROM x_typed) n, x_concept",
)


def needs(g):
    return g.need.withColumn("norm", text.normalize("raw"))


@query("text_need_type", "SELECT raw, need_type, category_hint FROM x_typed")
def _(g):
    return rq.need_types(needs(g), g.spark).select("raw", "need_type", "category_hint")


@query("text_concepts", "SELECT norm, concept, ROUND(s,6) AS similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY norm ORDER BY s DESC, concept) AS rn FROM x_concept_sim WHERE s>=0.9) z WHERE rn=1")
def _(g):
    return rq.concepts(needs(g), g.spark).withColumn("similarity", F.round("similarity", 6))


@query("src_concepts")
def _(g):
    table = rq.concept_table(g.spark)
    hits = rq.concepts(texts(g).select("norm").union(needs(g).select("norm")).distinct(), g.spark).groupBy("concept").agg(F.count("*").alias("needs"))
    return table.groupBy("concept", "kind", "category").agg(F.array_join(F.array_sort(F.collect_set("alias_key")), ",").alias("aliases")).join(hits, "concept", "left")


define(
    x_need_words="""SELECT norm, need_type, category_hint, CASE need_type WHEN 'dish' THEN 'restaurant' WHEN 'service' THEN COALESCE(extra,'service') WHEN 'product' THEN COALESCE(hint,'shop') ELSE 'place' END AS place_type,
 list_filter(terms, lambda v, i: v<>'' AND list_position(terms, v)=i) AS terms FROM (SELECT DISTINCT norm, need_type, category_hint, hint, extra, CASE WHEN need_type='dish' THEN [norm,'food'] WHEN need_type='service' THEN [norm, replace(COALESCE(extra,'service'),'_',' ')] WHEN need_type='product' AND extra IS NOT NULL THEN [norm, extra, replace(hint,'_',' ')] ELSE [norm] END AS terms FROM x_typed) z""",
    x_need_shown="""SELECT z.*, list_filter(terms, lambda t: contains(shown, t)) AS evidence, contains(shown, terms[1]) AS evidence_exact FROM (SELECT n.*, d.outlet_id, d.label, d.category, lower(concat_ws(' | ', d.label, d.brand_name, d.name, d.address, d.source, d.category)) AS shown
 FROM x_need_words n JOIN x_document d ON (n.category_hint IS NULL OR n.category_hint=d.category) AND len(list_filter(n.terms, lambda t: contains(' ' || d.doc || ' ', ' ' || t || ' ')))>0) z""",
    x_need_tier="""SELECT *, len(list_filter(CASE WHEN need_type='dish' THEN terms[1:2] ELSE terms END, lambda t: length(replace(t,' ',''))>=3 AND replace(t,' ','')<>replace(COALESCE(category_hint,''),'_','') AND replace(t,' ','')<>replace(place_type,'_','')
 AND (need_type<>'dish' OR replace(t,' ','')<>replace(terms[2],' ','')) AND contains(' ' || read || ' ', ' ' || t || ' ')))>0 AS direct FROM (SELECT *, trim(regexp_replace(lower(label || ' ' || array_to_string(evidence,' ') || ' ' || category),'[^a-z0-9]+',' ','g')) AS read FROM x_need_shown) z""",
)


def typed_needs(g):
    return rq.need_types(needs(g), g.spark).select("norm", "need_type", "category_hint", "terms", "place_type").distinct()


def all_postings(g):
    return g.keep("postings", lambda: search.postings(documents(g)))


@query("join_text_postings", "SELECT DISTINCT norm, category_hint, outlet_id, array_to_string(evidence,'|') AS evidence, evidence_exact FROM x_need_shown")
def _(g):
    rows = search.discovery(typed_needs(g), documents(g), all_postings(g))
    return rows.select("norm", "category_hint", "outlet_id", F.array_join("evidence", "|").alias("evidence"), "evidence_exact")


@query("top_discovery", """SELECT norm, category_hint, outlet_id, CAST(ROW_NUMBER() OVER (PARTITION BY norm, category_hint ORDER BY CASE WHEN evidence_exact THEN 0 ELSE 1 END, -len(evidence), lower(label), outlet_id) AS INTEGER) AS place
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY norm, category_hint ORDER BY label, outlet_id) AS n FROM (SELECT DISTINCT norm, category_hint, outlet_id, label, evidence, evidence_exact FROM x_need_shown) f) z WHERE n<=20""")
def _(g):
    return search.discovery_order(search.discovery(typed_needs(g), documents(g), all_postings(g))).select("norm", "category_hint", "outlet_id", "place")


@query("text_need_places", "SELECT DISTINCT norm, need_type, outlet_id, CASE WHEN direct THEN 'strong' ELSE 'supported' END AS tier, CASE WHEN need_type='dish' THEN 'business_verified' ELSE 'category_likely' END AS suitability, CASE WHEN direct THEN 1e0 ELSE 0.7e0 END AS relevance FROM x_need_tier WHERE direct OR need_type IN ('product','service')")
def _(g):
    return search.need_places(typed_needs(g), documents(g), all_postings(g)).distinct()


@query("text_fallbacks", "SELECT trip_id, search_no, c1, c2, brand1, match_class FROM x_variant")
def _(g):
    p = plan(g)
    return candidates.fallbacks(p.trips, p.substitutes()).select("trip_id", "search_no", "c1", "c2", "brand1", "match_class")


@query("agg_parse_metrics", """SELECT COUNT(*) AS total, COUNT(CASE WHEN status='resolved' THEN 1 END) AS deterministic, ROUND(COUNT(CASE WHEN status='resolved' THEN 1 END)*1e0/COUNT(*),4) AS deterministic_rate, COUNT(CASE WHEN status<>'resolved' THEN 1 END) AS clarifications, ROUND(COUNT(CASE WHEN status<>'resolved' THEN 1 END)*1e0/COUNT(*),4) AS clarification_rate,
 COUNT(CASE WHEN status='unresolved' THEN 1 END) AS unresolved FROM b_request r JOIN x_status s ON s.text=r.text""")
def _(g):
    rows = g.request.join(statuses(g).select("text", "status"), "text")
    n = F.count("*")
    good, bad = F.count_if(F.col("status") == "resolved"), F.count_if(F.col("status") != "resolved")
    return rows.agg(n.alias("total"), good.alias("deterministic"), F.round(good / n, 4).alias("deterministic_rate"), bad.alias("clarifications"), F.round(bad / n, 4).alias("clarification_rate"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))


define(x_need_found=f"SELECT r.request_id, {_norm('r.text')} AS term, EXISTS (SELECT 1 FROM x_phrase_hit p WHERE p.phrase={_norm('r.text')}) AS found FROM b_request r")


def need_found(g):
    hit = search.phrase_hits(phrases(g), documents(g), search.postings(documents(g))).select(F.col("phrase").alias("term"), F.lit(True).alias("found")).distinct()
    return g.request.select("request_id", text.normalize("text").alias("term")).join(hit, "term", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("agg_need_metrics", "SELECT COUNT(*) AS total, COUNT(CASE WHEN found THEN 1 END) AS resolved, COUNT(CASE WHEN NOT found THEN 1 END) AS unresolved, ROUND(COUNT(CASE WHEN NOT found THEN 1 END)*1e0/COUNT(*),4) AS zero_result_rate FROM x_need_found")
def _(g):
    n, bad = F.count("*"), F.count_if(~F.col("found"))
    return need_found(g).agg(n.alias("total"), F.count_if("found").alias("resolved"), bad.alias("unresolved"), F.round(bad / n, 4).alias("zero_result_rate"))


@query("top_gap_terms", "SELECT substr(term,1,80) AS term, COUNT(*) AS n FROM x_need_found WHERE NOT found AND term<>'' GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def _(g):
    gaps = need_found(g).filter("NOT found AND term <> ''").groupBy(F.substring("term", 1, 80).alias("term")).agg(F.count("*").alias("n"))
    return gaps.orderBy(F.desc("n"), "term").limit(20)


_expect = "CASE request_id % 6 WHEN 1 THEN 'groceries' WHEN 2 THEN 'fried_chicken' WHEN 3 THEN 'coffee' WHEN 4 THEN 'bubble_tea,pharmacy' ELSE '' END"
define(x_parsed="SELECT text, string_agg(category, ',' ORDER BY category) AS cats FROM x_entity GROUP BY text",
       x_eval=f"SELECT request_id % 6 AS template, COALESCE(CASE WHEN s.status='resolved' THEN p.cats END,'') AS found, {_expect} AS expected, request_id FROM b_request r JOIN x_status s ON s.text=r.text LEFT JOIN x_parsed p ON p.text=r.text")


@query("agg_eval_phrasings", "SELECT template, COUNT(*) AS cases, COUNT(CASE WHEN found=expected THEN 1 END) AS passed, ROUND(COUNT(CASE WHEN found=expected THEN 1 END)*1e0/COUNT(*),4) AS pass_rate FROM x_eval GROUP BY template")
def _(g):
    cats = found(g).groupBy("text").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("cats"))
    rows = g.request.join(statuses(g).select("text", "status"), "text").join(cats, "text", "left")
    rows = rows.select((F.col("request_id") % 6).alias("template"), F.coalesce(F.when(F.col("status") == "resolved", F.col("cats")), F.lit("")).alias("found"), F.expr(_expect).alias("expected"))
    good = F.count_if(F.col("found") == F.col("expected"))
    return rows.groupBy("template").agg(F.count("*").alias("cases"), good.alias("passed"), F.round(good / F.count("*"), 4).alias("pass_rate"))


@query("agg_eval_needs")
def _(g):
    patterns = F.array(*[F.lit(t) for t in ("{term}", "need {term}", "please find {term}", "where can I get {term}")])
    cases = needs(g).select("raw", "norm", F.posexplode(patterns).alias("template", "pattern"))
    cases = cases.withColumn("text", F.expr("replace(pattern, '{term}', raw)")).withColumn("case_norm", text.normalize("text"))
    parsed = rq.clauses(cases.select("text", F.col("case_norm").alias("norm")).distinct()).filter("clause_no = 1")
    typed = rq.need_types(parsed.select(F.col("clause").alias("raw"), F.col("clause_norm").alias("norm")).distinct(), g.spark).select(F.col("raw").alias("clause"), F.col("need_type").alias("found_type"))
    wanted = rq.need_types(needs(g), g.spark).select("raw", "need_type")
    rows = cases.join(parsed, "text", "left").join(typed, "clause", "left").join(wanted, "raw")
    n = F.count("*")
    return rows.groupBy("template").agg(n.alias("cases"), F.round(F.count("clause") / n, 4).alias("acceptance_rate"), F.round(F.count_if(F.col("found_type") != F.col("need_type")) / n, 4).alias("wrong_type_rate"))


def planned_requests(g):
    """Resolved request texts as planner trips, on the ends of the trip they belong to."""
    index = g.category.select("slug", "category_idx")
    flagged = rq.errand_flags(found(g)).filter("errand_no <= 2").join(index, F.col("category") == index.slug).join(g.brand.select(F.col("slug").alias("brand_slug"), "brand_idx"), "brand_slug", "left")
    first, second = F.col("errand_no") == 1, F.col("errand_no") == 2
    exact = F.when(F.col("exact_brand").isNotNull(), F.col("brand_idx"))
    wish = F.when(F.col("preferred_brand").isNotNull(), F.col("brand_idx"))
    wide = flagged.groupBy("text").agg(
        F.max(F.when(first, F.col("category_idx"))).cast("bigint").alias("category_1"), F.max(F.when(second, F.col("category_idx"))).cast("bigint").alias("category_2"),
        F.max(F.when(first, exact)).cast("bigint").alias("exact_brand_1"), F.max(F.when(second, exact)).cast("bigint").alias("exact_brand_2"),
        F.min_by(F.when(wish.isNotNull(), F.col("category_idx")), "errand_no").cast("bigint").alias("preferred_category"), F.min_by(wish, "errand_no").cast("bigint").alias("preferred_brand"),
    )
    wishes = rq.preferences(texts(g)).drop("norm").withColumnsRenamed({"max_detour_minutes_is_hard": "max_detour_is_hard", "max_walk_minutes_is_hard": "max_walk_is_hard"})
    ends = g.trip.select(F.col("trip_id"), F.col("departure").cast("timestamp").alias("departure"), "o_lat", "o_lon", "d_lat", "d_lon")
    ready = statuses(g).filter("status = 'resolved'").select("text").join(wide, "text").join(wishes, "text")
    return g.request.withColumnRenamed("request_id", "trip_id").join(ready, "text").join(ends, "trip_id").drop("text")


@query("pipe_requests")
def _(g):
    if "request plan" not in g._made:
        trips = g.keep("planned_requests", lambda: planned_requests(g))
        g._made["request plan"] = TripPlan(g.spark, trips, g.hub, g.outlet, g.node, g.station, g.category)
    return g._made["request plan"].result().withColumn("score", F.round("score", 3))
