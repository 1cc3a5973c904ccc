"""Catalog columns and joins: names, categories, context, quality, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import geo, text
from ..session import store
from . import spatial

# Location context kinds and how sure each one is.
CONTEXT_QUALITY = (
    ("address", 1.0), ("mall", 0.95), ("station_area", 0.88), ("nearby_mall", 0.82), ("station", 0.72), ("area", 0.5),
)


def nearby_mall(hubs: DataFrame) -> DataFrame:
    """Nearest open mall within 350 m of each open hub that is not a mall itself."""
    malls = hubs.filter("semantic_type = 'mall' AND closure_status <> 'closed'").groupBy("lat", "lon").agg(F.min("name").alias("mall_name"))
    sites = malls.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "mall_name")
    others = hubs.filter("semantic_type <> 'mall'").select("lat", "lon").distinct()
    metres = geo.local_metres("lat", "lon", "s_lat", "s_lon") / 1000
    pairs = spatial.within(others, sites, params.NEARBY_MALL_M / 1000, metres)
    best = pairs.groupBy("lat", "lon").agg(F.min(F.struct("km", "mall_name")).alias("b"))
    return best.select("lat", "lon", F.col("b.mall_name").alias("nearby_mall"), F.round(F.col("b.km") * 1000, 1).alias("nearby_mall_m"))


def location_context(hubs: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Context kind and quality of each hub, best source first."""
    near = facts.select("hub_id", "nearest_node", "node_m")
    names = nodes.select(F.col("node_id").alias("nearest_node"), F.col("name").alias("node_name"))
    malls = nearby_mall(hubs)
    rows = hubs.join(near, "hub_id").join(names, "nearest_node", "left").join(malls, ["lat", "lon"], "left")
    rows = rows.withColumn("node_name", F.when(F.col("node_m") <= params.TRANSIT_M, F.col("node_name")))
    mall_near = F.col("nearby_mall").isNotNull() & (F.col("semantic_type") != "mall")
    kind = (
        F.when(F.col("address").isNotNull() & (F.col("address") != ""), "address")
        .when(F.col("semantic_type") == "mall", "mall")
        .when((F.col("semantic_type") == "station_area") & F.col("node_name").isNotNull(), "station_area")
        .when(mall_near, "nearby_mall")
        .when(F.col("node_name").isNotNull(), "station")
        .otherwise("area")
    )
    rows = rows.withColumn("context_kind", kind)
    quality = F.lit(None).cast("double")
    for name, value in CONTEXT_QUALITY:
        quality = F.when(F.col("context_kind") == name, value).otherwise(quality)
    return rows.withColumn("location_quality", quality)


def hub_quality(hubs: DataFrame, outlets: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Location quality plus a little when any open shop publishes hours, at most one."""
    hours = outlets.filter("closure_status <> 'closed' AND opening_hours IS NOT NULL AND opening_hours <> ''").select("hub_id").distinct()
    rows = location_context(hubs, facts, nodes).join(hours.withColumn("any_hours", F.lit(True)), "hub_id", "left")
    bonus = F.when(F.col("any_hours"), 0.05).otherwise(0.0)
    return rows.select("hub_id", F.round(F.least(F.lit(1.0), F.col("location_quality") + bonus), 6).alias("quality"))


# --- brands and names ----------------------------------------------------------


def brand_alias(rows: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """Canonical brand from the first of several columns that names one."""
    for i, column in enumerate(columns):
        dim = aliases.select(F.col("alias").alias(f"_a{i}"), F.struct("brand_slug", "brand_name").alias(f"_b{i}"))
        rows = rows.withColumn(f"_a{i}", text.normalize(column)).join(F.broadcast(dim), f"_a{i}", "left")
    best = F.coalesce(*[F.col(f"_b{i}") for i in range(len(columns))])
    rows = rows.withColumn("brand_slug", best["brand_slug"]).withColumn("brand_name", best["brand_name"])
    return rows.drop(*[f"_a{i}" for i in range(len(columns))], *[f"_b{i}" for i in range(len(columns))])


def alias_table(spark) -> DataFrame:
    names = {slug: name for _, slug, name, _ in params.BRANDS}
    return params.small_table(spark, [(a, s, names[s]) for a, s in params.BRAND_ALIASES], "alias, brand_slug, brand_name")


def label_table(spark) -> DataFrame:
    return params.small_table(spark, [(r[1], r[4], r[5]) for r in params.CATEGORIES], "slug, heading, noun")


def superseded(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing hubs of other sources that an incoming hub of the same name replaces."""
    new = incoming.select(text.normalize("name").alias("key"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    return existing.withColumn("key", text.normalize("name")).join(
        new, "key"
    ).filter(geo.haversine_km("lat", "lon", "n_lat", "n_lon") <= params.SUPERSEDED_KM).drop("key", "n_lat", "n_lon").distinct()


def mall_of(places: DataFrame, malls: DataFrame, key: str) -> DataFrame:
    """The mall a place stands in: nearest containing rectangle, else nearest within 75 m.

    Places of one coordinate share the answer, and of malls alike in spot and rectangle only the one of
    the smallest id can be it, so a crowd of either meets once.
    """
    margin = params.MALL_MARGIN_DEG
    least = F.min("mall_id").alias("mall_id")
    boxes = malls.filter("minlat IS NOT NULL").groupBy("lat", "lon", "minlat", "maxlat", "minlon", "maxlon").agg(least).select(
        "mall_id", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), (F.col("minlat") - margin).alias("south"),
        (F.col("maxlat") + margin).alias("north"), (F.col("minlon") - margin).alias("west"), (F.col("maxlon") + margin).alias("east"),
    )
    sites = malls.groupBy("lat", "lon").agg(least).select("mall_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    spots = store(places.select("lat", "lon").distinct(), "spots")
    inside = spatial.inside_boxes(spots, boxes).select("lat", "lon", "mall_id", geo.haversine_km("lat", "lon", "m_lat", "m_lon").alias("km"), F.lit(0).alias("how"))
    near = spatial.within(spots, sites, params.MALL_RADIUS_KM).select("lat", "lon", "mall_id", "km", F.lit(1).alias("how"))
    found = inside.unionByName(near).groupBy("lat", "lon").agg(F.min(F.struct("how", "km", "mall_id")).alias("m"))
    return places.select(key, "lat", "lon").join(found.hint("merge"), ["lat", "lon"]).groupBy(key).agg(F.min("m").alias("m")).select(
        key, F.col("m.mall_id").alias("mall_id"), F.when(F.col("m.how") == 0, "containment").otherwise("radius").alias("found_by")
    )


def category_catalog(categories: DataFrame, outlets: DataFrame) -> DataFrame:
    """Open outlets per category; an empty parent takes its children's sum; zero rows go."""
    counts = outlets.filter("closure_status <> 'closed'").groupBy("category_idx").agg(F.count("*").alias("n"))
    own = categories.join(counts, "category_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    children = own.groupBy(F.col("parent_slug").alias("slug")).agg(F.sum("n").alias("below")).filter("slug IS NOT NULL")
    rows = own.join(children, "slug", "left")
    total = F.when(F.col("n") > 0, F.col("n")).otherwise(F.coalesce("below", F.lit(0)))
    return rows.select("slug", "parent_slug", total.alias("outlet_count")).filter("outlet_count > 0")


def greedy_keep(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids kept when, in id order, one goes if an earlier kept one is paired with it.

    ``pairs`` (later, earlier) is written once; each round settles every id whose earlier
    partners are settled, so no group is ever gathered in one place. The number of rounds
    is the longest chain of partners. The ids may be texts, of which a table that is small on disk
    fills a driver, so no join here broadcasts.
    """
    pairs = store(pairs.select("later", "earlier").distinct(), "pairs")
    waiting = store(pairs.select(F.col("later").alias("id")).distinct(), "waiting")
    kept = nodes.select("id").join(waiting.hint("merge"), "id", "left_anti")
    fresh = kept
    found = [kept]
    open_pairs = pairs
    while not waiting.isEmpty():
        gone = open_pairs.join(fresh.select(F.col("id").alias("earlier")).hint("merge"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        still = store(waiting.join(gone.hint("merge"), "id", "left_anti"), "waiting")
        # Pairs among ids not settled yet; a settled earlier id was either dropped or did its dropping.
        open_pairs = store(
            open_pairs.join(still.select(F.col("id").alias("later")).hint("merge"), "later", "left_semi").join(
                still.select(F.col("id").alias("earlier")).hint("merge"), "earlier", "left_semi"
            ),
            "pairs",
        )
        fresh = store(still.join(open_pairs.select(F.col("later").alias("id")).distinct().hint("merge"), "id", "left_anti"), "fresh")
        found.append(fresh)
        waiting = still.join(fresh.hint("merge"), "id", "left_anti")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def close_pairs(rows: DataFrame, key: str, km: float) -> DataFrame:
    """Pairs of rows (id, key, lat, lon) of one key within ``km``, later id first.

    A row meets its own cell and four of the eight around it, so two cells meet once. The repeated
    side is larger than its table's size tells, so it is never broadcast.
    """
    size = geo.lon_margin(km)
    cells = rows.select("id", key, "lat", "lon", geo.cell("lat", size).alias("cy"), geo.cell("lon", size).alias("cx"))
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    around = cells.withColumnsRenamed({"id": "s_id", "lat": "s_lat", "lon": "s_lon"}).withColumn("step", F.explode(steps))
    around = around.withColumns({"cy": F.col("cy") + F.col("step.y"), "cx": F.col("cx") + F.col("step.x"), "own": (F.col("step.y") == 0) & (F.col("step.x") == 0)}).drop("step")
    met = cells.join(around.hint("merge"), [key, "cy", "cx"]).filter("(own AND s_id < id) OR (NOT own AND s_id <> id)")
    return met.filter(geo.haversine_km("lat", "lon", "s_lat", "s_lon") <= km).select(F.greatest("id", "s_id").alias("later"), F.least("id", "s_id").alias("earlier"))


def dedupe_places(rows: DataFrame, key: str, km: float = params.DEDUPE_KM) -> DataFrame:
    """Places (id, key, lat, lon) left after dropping near repeats of a key, in id order.

    Of places sharing key and coordinate only the first can stay, so crowds shrink to one
    row before any pair is formed.
    """
    firsts = store(rows.groupBy(key, "lat", "lon").agg(F.min("id").alias("id")), "firsts")
    return rows.join(greedy_keep(firsts, close_pairs(firsts, key, km)).hint("merge"), "id", "left_semi")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Row number inside each group without bringing a group to one task.

    Rows are range partitioned, numbered inside (partition, group), and shifted by what
    earlier partitions hold of the group.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = store(rows.repartitionByRange(parts, group, order).withColumn("_pid", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_pid", group).orderBy(order))
    return ranged.withColumn("_local", local).join(offsets.hint("merge"), [group, "_pid"]).withColumn("number", F.col("_local") + F.col("_before")).drop("_local", "_before", "_pid")


def unique_names(rows: DataFrame) -> DataFrame:
    """A name no other row of the scope has: plain, then each qualifier, then numbered, then by id.

    ``rows``: id, scope, base, qualifiers. Every round hands a free candidate to the first
    row asking for it. Names and ids are texts, small on disk and large in a driver, so no join broadcasts them.
    """
    rows = store(rows.withColumn("base", F.when(F.trim("base") != "", F.trim("base")).otherwise(F.concat(F.lit("Unnamed place "), "id"))), "names")
    taken = None
    named = []
    left = rows
    for turn in range(3):
        qualifier = F.try_element_at("qualifiers", F.lit(max(turn, 1)))
        candidate = F.col("base") if turn == 0 else F.concat("base", F.lit(" ("), qualifier, F.lit(")"))
        asked = left.withColumn("name", candidate)
        free = asked.filter("name IS NOT NULL")
        if taken is not None:
            free = free.join(taken.hint("merge"), ["scope", "name"], "left_anti")
        winners = store(free.groupBy("scope", "name").agg(F.min("id").alias("id")), "winners")
        named.append(winners)
        taken = winners.select("scope", "name") if taken is None else taken.unionByName(winners.select("scope", "name"))
        left = left.join(winners.select("id").hint("merge"), "id", "left_anti")
    first = F.try_element_at("qualifiers", F.lit(1))
    stem = F.when(first.isNotNull(), F.concat("base", F.lit(" ("), first, F.lit(")"))).otherwise(F.col("base"))
    counted = numbered(left.withColumn("stem", F.concat_ws("\u0001", F.col("scope"), stem)).withColumn("shown", stem), "stem", "id")
    label = F.concat("shown", F.lit(" "), (F.col("number") + 1).cast("string"))
    counted = counted.withColumn("name", F.when(F.col("number") <= 98, label))
    clash = taken.withColumn("clash", F.lit(True))
    last = counted.join(clash.hint("merge"), ["scope", "name"], "left").withColumn(
        "name", F.when(F.col("clash").isNull() & F.col("name").isNotNull(), F.col("name")).otherwise(F.concat("base", F.lit(" · "), "id"))
    )
    whole = last.select("scope", "name", "id")
    for part in named:
        whole = whole.unionByName(part.select("scope", "name", "id"))
    return whole


TIERS = ("weak", "supported", "strong", "verified")


def merge_places(places: DataFrame, km: float = params.PLACE_DEDUPE_KM) -> DataFrame:
    """Merge places of one search and equal compact name or address within ``km`` into the earliest kept one.

    places: search, id, name, address, lat, lon, provenance (array), tier (0-3), relevance.
    """
    def key(value: str) -> Column:
        return F.when(text.compact(value) != "", F.concat_ws("\u0001", "search", text.compact(value)))

    rows = store(places.withColumn("name_key", key("name")).withColumn("address_key", key("address")), "places")
    by_name = close_pairs(rows.filter("name_key IS NOT NULL"), "name_key", km)
    by_address = close_pairs(rows.filter("address_key IS NOT NULL"), "address_key", km)
    pairs = store(by_name.unionByName(by_address).distinct(), "place_pairs")
    kept = store(greedy_keep(rows, pairs), "kept")
    home = pairs.join(kept.withColumnRenamed("id", "earlier").hint("merge"), "earlier", "left_semi").join(
        kept.withColumnRenamed("id", "later").hint("merge"), "later", "left_anti"
    ).groupBy(F.col("later").alias("id")).agg(F.min("earlier").alias("place_id"))
    members = rows.join(home.hint("merge"), "id", "left").withColumn("place_id", F.coalesce("place_id", "id"))
    return members.groupBy("place_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenance")))).alias("provenance"),
        F.max("tier").alias("tier"), F.max("relevance").alias("relevance"), F.count("*").alias("members"),
    )


def nearest_area(hubs: DataFrame, spark) -> DataFrame:
    """Named area whose centre is nearest in degrees; twenty fixed centres as one array."""
    centres = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(o).alias("o")) for i, (n, a, o) in enumerate(params.AREA_CENTRES)])
    ranked = F.transform(
        centres,
        lambda c: F.struct((F.pow(F.col("lat") - c["a"], F.lit(2.0)) + F.pow(F.col("lon") - c["o"], F.lit(2.0))).alias("d"), c["i"].alias("i"), c["n"].alias("n")),
    )
    return hubs.withColumn("area", F.array_min(ranked)["n"])


def brand_catalog(brands: DataFrame, aliases: DataFrame, outlets: DataFrame, categories: DataFrame) -> DataFrame:
    """Each brand with its aliases, the categories of its open outlets and their number."""
    names = aliases.groupBy(F.col("brand_slug").alias("slug")).agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    per = outlets.filter("closure_status <> 'closed' AND brand_idx IS NOT NULL").groupBy("brand_idx", "category_idx").agg(F.count("*").alias("n"))
    per = per.join(categories.select("category_idx", F.col("slug").alias("category")), "category_idx").groupBy("brand_idx").agg(
        F.sum("n").alias("outlet_count"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
    return brands.join(names, "slug", "left").join(per, "brand_idx", "left").select(
        "slug", "brand_name", "aliases", F.coalesce("outlet_count", F.lit(0)).cast("bigint").alias("outlet_count"), "categories"
    )


def stats(outlets: DataFrame, hubs: DataFrame, nodes: DataFrame, stops: DataFrame, routes: DataFrame, logos: DataFrame) -> DataFrame:
    """Counts over the catalog in one row; one aggregate per table."""
    from .usage import one_row

    per = outlets.groupBy("brand_idx", "category_idx").agg(
        F.count("*").alias("n"), F.count_if(F.col("closure_status") != "closed").alias("active"),
        F.count_if(F.coalesce("opening_hours", F.lit("")) != "").alias("hours"), F.count_if(F.col("closure_status") == "closed").alias("closed"),
    )
    shops = per.agg(
        F.sum("n").alias("outlets"), F.sum("active").alias("active_outlets"), F.count_distinct("brand_idx").alias("brands"),
        F.count_distinct("category_idx").alias("categories"), F.sum("hours").alias("known_hours"), F.sum("closed").alias("closed_outlets"),
    )
    places = hubs.agg(F.count("*").alias("hubs"), F.count_if(F.col("semantic_type") == "mall").alias("malls"))
    return one_row(
        shops, places, nodes.agg(F.count("*").alias("transport_nodes")), stops.agg(F.count("*").alias("stops")), routes.agg(F.count("*").alias("route_rows")),
        logos.agg(F.count("*").alias("logos")),
    )


def hub_labels(hubs: DataFrame, stores: DataFrame) -> DataFrame:
    """What a traveller reads for a hub: the first store for a lone place, never a raw id."""
    first = stores.groupBy("hub_id").agg(F.min(text.safe_label("store", "Business details unavailable")).alias("first_store"))
    own = text.safe_label("name", "Location details unavailable")
    label = F.when((F.col("semantic_type") == "standalone") & (F.col("source") == "openstreetmap"), F.coalesce("first_store", own)).otherwise(own)
    return hubs.join(first, "hub_id", "left").select("hub_id", label.alias("label")).withColumn("leaks", F.col("label").rlike(text.RAW_ID))


def hub_stores(hubs: DataFrame, outlets: DataFrame, brands: DataFrame, categories: DataFrame, facts: DataFrame, nodes: DataFrame, logos: DataFrame) -> DataFrame:
    """Open hubs with their open stores nested in id order, their node and the nearest mall.

    ``outlets`` carry the ``brand_key`` by which ``logos`` (brand_key, url) are found. Brand, category, logo, node
    and mall are left joins: a store without any of them stays. A building's stores become one array, so it is
    the widest row of the catalog; the planner never carries it and joins it last.
    """
    marks = logos.filter("url IS NOT NULL").select("brand_key", F.col("url").alias("logo_url"))
    stores = (
        outlets.filter("closure_status <> 'closed'").join(brands, "brand_idx", "left").join(marks, "brand_key", "left")
        .join(categories.select("category_idx", F.col("slug").alias("category")), "category_idx", "left")
        .groupBy("hub_id").agg(F.array_sort(F.collect_list(F.struct("outlet_id", "category", "brand_name", "opening_hours", "closure_status", "logo_url"))).alias("stores"))
    )
    names = nodes.select(F.col("node_id").alias("nearest_node"), F.col("name").alias("node_name"))
    near = facts.select("hub_id", "nearest_node", "node_m").join(names, "nearest_node", "left")
    rows = hubs.filter("closure_status <> 'closed'").join(stores, "hub_id").join(near, "hub_id", "left").join(nearby_mall(hubs), ["lat", "lon"], "left")
    other = F.col("semantic_type") != "mall"
    return rows.select(
        "hub_id", "name", "lat", "lon", "semantic_type", "source", "closure_status", "address", F.when(F.col("node_m") <= params.TRANSIT_M, F.col("node_name")).alias("node_name"),
        "node_m", F.when(other, F.col("nearby_mall")).alias("nearby_mall"), F.when(other, F.col("nearby_mall_m")).alias("nearby_mall_m"), "stores",
    )
