"""Catalog refresh: map elements to transit nodes, hubs, outlets and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import params
from ..functions import text
from ..operators import catalog, spatial
from ..session import store
from ..sources import elements as el


def branded(city: DataFrame, aliases: DataFrame) -> DataFrame:
    rows = city.withColumns({"_brand": F.coalesce(el.tag("brand"), F.lit("")), "_operator": F.coalesce(el.tag("operator"), F.lit("")), "_name": F.coalesce(el.tag("name"), F.lit(""))})
    return catalog.brand_alias(rows, aliases, "_brand", "_operator", "_name").drop("_brand", "_operator", "_name")


def pois(city: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """Elements that are places to run an errand at, with categories and names.

    Exploded and not filtered, as a filter pushed below the rules would work them out twice.
    """
    found = F.filter(F.array(el.categories()), lambda c: F.size(c) > 0)
    rows = branded(city, aliases).withColumn("categories", F.explode(found))
    rows = rows.withColumn("slug", F.col("categories")[0]).join(F.broadcast(labels), "slug", "left")
    base = F.coalesce("brand_name", F.nullif(el.tag("name"), F.lit("")))
    key_name = F.coalesce(base, F.concat(F.initcap(F.replace("slug", F.lit("_"), F.lit(" "))), F.lit(" "), "source_id"))
    return rows.withColumns({
        "display_name": F.coalesce(base, "noun"), "dedupe_name": key_name,
        "dedupe_key": F.concat(F.coalesce("brand_slug", text.normalize(key_name)), F.lit("|"), F.array_join("categories", ",")),
    })


def nodes(city: DataFrame) -> DataFrame:
    return city.withColumn("node_type", el.node_type()).filter("node_type IS NOT NULL").select(
        "source_id", "node_type", F.coalesce(F.nullif(el.tag("name"), F.lit("")), F.concat(F.lit("Transport node "), "source_id")).alias("name"), "lat", "lon"
    )


def malls(city: DataFrame) -> DataFrame:
    return city.filter(el.tag("shop") == "mall").select(F.col("source_id").alias("mall_id"), "lat", "lon", "bounds.*", "tags")


def with_node(places: DataFrame, node_rows: DataFrame) -> DataFrame:
    near = spatial.nearest(places, node_rows.select(F.col("source_id").alias("node_id"), "lat", "lon"), "node_id")
    names = node_rows.select(F.col("source_id").alias("node_id"), F.col("name").alias("node_name"), "node_type")
    rows = places.join(near.hint("merge"), ["lat", "lon"], "left").withColumn("node_id", F.when(F.col("distance_m") <= params.TRANSIT_M, F.col("node_id")))
    return rows.join(names.hint("merge"), "node_id", "left").withColumnRenamed("distance_m", "node_m")


def with_qualifiers(places: DataFrame, node_rows: DataFrame) -> DataFrame:
    return with_node(places, node_rows).withColumn("qualifiers", el.qualifiers(F.col("node_name"), F.col("node_type")))


def deduped(places: DataFrame) -> DataFrame:
    return catalog.dedupe_places(places.withColumn("id", F.col("source_id")), "dedupe_key")


def with_hub(places: DataFrame, mall_rows: DataFrame) -> DataFrame:
    found = catalog.mall_of(places, mall_rows, "source_id")
    return places.join(found.hint("merge"), "source_id", "left").withColumn(
        "hub_source_id", F.coalesce("mall_id", F.concat(F.lit("poi:"), "source_id"))
    )


def first_outlets(rows: DataFrame) -> DataFrame:
    """First outlet per hub, name and leading category; a mall's crowd reduces map-side."""
    keys = ["hub_source_id", "slug", "name_key"]
    keyed = rows.withColumn("name_key", text.normalize("dedupe_name"))
    firsts = keyed.groupBy(*keys).agg(F.min("source_id").alias("source_id")).select("source_id")
    return keyed.join(firsts.hint("merge"), "source_id", "left_semi")


def run(city: DataFrame, aliases: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """All tables of one refresh. Stages read more than once are written first; none is broadcast, whatever its size on disk."""
    node_rows = store(nodes(city), "nodes")
    mall_rows = store(malls(city), "malls")
    raw = store(pois(city, aliases, labels), "pois")
    kept = store(with_hub(deduped(raw), mall_rows), "placed")
    outlets = store(with_qualifiers(first_outlets(kept), node_rows), "outlets")
    rail = node_rows.filter(F.col("node_type").isin("station", "halt", "tram_stop", "stop"))
    lone = with_qualifiers(kept.filter("mall_id IS NULL"), node_rows)
    rail_near = spatial.nearest(lone, rail.select(F.col("source_id").alias("rail_id"), "lat", "lon"), "rail_id").withColumnRenamed("distance_m", "rail_m")
    lone = lone.join(rail_near.hint("merge"), ["lat", "lon"], "left").select(
        "hub_source_id", F.col("display_name").alias("base"), "qualifiers", "lat", "lon", "node_id", "node_m", "tags",
        F.when(F.col("rail_m") <= params.STATION_AREA_M, "station_area").otherwise("standalone").alias("semantic_type"),
    )
    big = with_qualifiers(mall_rows.drop("minlat", "maxlat", "minlon", "maxlon"), node_rows).select(
        F.concat(F.lit("mall:"), "mall_id").alias("hub_source_id"), F.coalesce(el.tag("name"), F.lit("Shopping mall")).alias("base"),
        "qualifiers", "lat", "lon", "node_id", "node_m", "tags", F.lit("mall").alias("semantic_type"),
    )
    hubs = store(big.unionByName(lone), "hubs")
    hub_names = catalog.unique_names(hubs.select(F.col("hub_source_id").alias("id"), F.lit("city").alias("scope"), "base", "qualifiers"))
    named_hubs = hubs.join(hub_names.select(F.col("id").alias("hub_source_id"), "name").hint("merge"), "hub_source_id").select(
        "hub_source_id", "name", "lat", "lon", "semantic_type", "node_id", "node_m", el.address().alias("address"),
        F.when(el.is_closed(), "closed").otherwise("unknown").alias("closure_status"),
    )
    names = catalog.unique_names(outlets.select(F.col("source_id").alias("id"), F.col("hub_source_id").alias("scope"), F.col("display_name").alias("base"), "qualifiers"))
    named = outlets.join(names.select(F.col("id").alias("source_id"), "name").hint("merge"), "source_id").select(
        "source_id", "hub_source_id", "name", "brand_slug", F.array_join("categories", ",").alias("categories"), el.brand_key().alias("brand_key"),
        el.tag("opening_hours").alias("opening_hours"), F.when(el.is_closed(), "closed").otherwise("unknown").alias("closure_status"),
    )
    return {"nodes": node_rows, "hubs": named_hubs, "outlets": named, "pois": raw, "malls": mall_rows}


def report(elements: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of one refresh run in one row."""
    from ..operators.usage import one_row

    outlets = tables["outlets"].agg(
        F.count("*").alias("imported_pois"), F.count_if(F.col("closure_status") == "closed").alias("closed_pois"),
        F.count_if(F.col("opening_hours").isNotNull()).alias("known_opening_hours"), F.count("brand_slug").alias("canonical_brand_pois"),
    )
    whole = one_row(
        elements.agg(F.count("*").alias("raw_elements")), tables["pois"].agg(F.count("*").alias("raw_pois")), outlets,
        tables["hubs"].agg(F.count("*").alias("imported_hubs")), tables["malls"].agg(F.count("*").alias("imported_malls")),
        tables["nodes"].agg(F.count("*").alias("imported_transport_nodes")),
    )
    return whole.withColumn("deduplicated_pois", F.col("raw_pois") - F.col("imported_pois"))
