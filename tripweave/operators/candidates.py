"""From trips to a short list of stops and stop pairs worth pricing.

A trip becomes one or more searches (``sid``): the request itself and its fallback
variants. Hubs carry their categories as a bit mask, so coverage tests stay in
generated code and a hub is met once per search however many categories it serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import geo
from ..session import spread
from . import corridor, foci, spatial

CELL = 0.0125
#: First margin of a search whose corridor held nothing: its hubs are not close.
LEFTOVER_KM = 8.0
#: Categories a hub's mask can hold; an index beyond it is an error, not a loss.
MASK_BITS = 63
ROUTE_FIELDS = ("o_lat", "o_lon", "d_lat", "d_lon")


def has(mask: str, category: str) -> Column:
    return F.coalesce(F.expr(f"({mask} & shiftleft(1L, cast({category} as int))) <> 0"), F.lit(False))


def category_closure(categories: DataFrame) -> DataFrame:
    """Every category with itself and all of its descendants."""
    rows = categories.select(F.col("category_idx").alias("ancestor"), "slug", F.col("category_idx").alias("category"))
    found = rows
    parents = categories.select(F.col("category_idx").alias("child"), F.col("slug").alias("child_slug"), "parent_slug")
    while True:
        rows = rows.join(parents, rows.slug == parents.parent_slug).select(
            "ancestor", F.col("child_slug").alias("slug"), F.col("child").alias("category")
        ).distinct()
        rows = rows.join(found.select("ancestor", "category"), ["ancestor", "category"], "left_anti")  # a cycle ends here
        if rows.isEmpty():
            return found.select("ancestor", "category")
        found = found.unionByName(rows)


def hub_facts(hubs: DataFrame, outlets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open hubs with the mask of categories their open outlets serve and their nearest node."""
    open_outlets = outlets.filter("closure_status <> 'closed'").groupBy("hub_id").agg(
        F.expr(f"bit_or(CASE WHEN category_idx BETWEEN 0 AND {MASK_BITS - 1} THEN shiftleft(1L, cast(category_idx as int)) "
               f"ELSE raise_error('category index beyond the mask') END)").alias("mask")
    )
    near = spatial.nearest(hubs, nodes.select("node_id", "lat", "lon"), "node_id")
    return (
        hubs.filter("closure_status <> 'closed'")
        .join(open_outlets, "hub_id")
        .join(near.withColumnRenamed("distance_m", "node_m").withColumnRenamed("node_id", "nearest_node"), ["lat", "lon"], "left")
        .withColumn("kind", F.when(F.col("semantic_type").isin("mall", "station_area"), 0).otherwise(1))
    )


def hub_category_rows(facts: DataFrame) -> DataFrame:
    """One row per hub and own category."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda c: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)) != 0)
    return facts.select(
        "hub_id", "lat", "lon", geo.unit_vector("lat", "lon").alias("unit"), "kind", "node_m", "mask", F.explode(bits).alias("category")
    )


def hub_brands(outlets: DataFrame) -> DataFrame:
    """Which brands a hub has an open outlet of, per category."""
    return outlets.filter("closure_status <> 'closed' AND brand_idx IS NOT NULL").select(
        "hub_id", F.col("category_idx").alias("category"), F.col("brand_idx").alias("brand")
    ).distinct()


# --- searches -----------------------------------------------------------------


def fallbacks(trips: DataFrame, substitutes: DataFrame) -> DataFrame:
    """Substitute and partial variants of a trip's request, in the order they are tried.

    A substitute replaces one errand that has no exact brand; a two-errand request also
    gets one variant per errand alone. Rows: trip_id, search_no, c1, c2, brands, class.
    """
    swap1 = substitutes.select(F.col("category").alias("category_1"), F.col("substitute").alias("sub1"))
    swap2 = substitutes.select(F.col("category").alias("category_2"), F.col("substitute").alias("sub2"))
    rows = trips.join(swap1, "category_1", "left").join(swap2, "category_2", "left")
    none = F.lit(None).cast("bigint")
    two = F.col("category_2").isNotNull()

    def variant(no, when, c1, c2, b1, b2, kind):
        return F.when(
            when,
            F.struct(
                F.lit(no).alias("search_no"), c1.cast("bigint").alias("c1"), c2.cast("bigint").alias("c2"),
                b1.cast("bigint").alias("brand1"), b2.cast("bigint").alias("brand2"), F.lit(kind).alias("match_class"),
            ),
        )

    one, other = F.col("category_1"), F.col("category_2")
    brand1, brand2 = F.col("exact_brand_1"), F.col("exact_brand_2")
    choices = F.array_compact(
        F.array(
            variant(1, F.col("sub1").isNotNull() & brand1.isNull(), F.col("sub1"), other, none, brand2, "easier_alternative"),
            variant(2, F.col("sub2").isNotNull() & brand2.isNull(), one, F.col("sub2"), brand1, none, "easier_alternative"),
            variant(3, two, one, none, brand1, none, "partial_option"),
            variant(4, two, other, none, brand2, none, "partial_option"),
        )
    )
    return rows.select("trip_id", F.explode(choices).alias("v")).select("trip_id", "v.*")


def searches(trips: DataFrame, substitutes: DataFrame | None) -> DataFrame:
    """All searches of every trip. The main one gives up two places to fallbacks."""
    main = trips.select(
        "trip_id", F.lit(0).alias("search_no"), F.col("category_1").cast("bigint").alias("c1"),
        F.col("category_2").cast("bigint").alias("c2"), F.col("exact_brand_1").cast("bigint").alias("brand1"),
        F.col("exact_brand_2").cast("bigint").alias("brand2"), F.lit("best_match").alias("match_class"),
    )
    if substitutes is None:
        rows = main.withColumn("max_candidates", F.lit(params.MAX_CANDIDATES))
    else:
        extra = fallbacks(trips, substitutes)
        counted = main.join(extra.select("trip_id").distinct().withColumn("fallen", F.lit(True)), "trip_id", "left")
        main = counted.withColumn(
            "max_candidates", F.when(F.col("fallen"), params.MAX_CANDIDATES - 2).otherwise(params.MAX_CANDIDATES)
        ).drop("fallen")
        rows = main.unionByName(extra.withColumn("max_candidates", F.lit(1)))
    return rows.withColumn("sid", F.col("trip_id") * 8 + F.col("search_no"))


def with_route(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Searches with the ends and the baseline plan of their trip.

    A walk has no stations: both end legs are then the walk itself.
    """
    ends = routes.withColumns({
        "f_lat": F.coalesce("f_lat", "d_lat"), "f_lon": F.coalesce("f_lon", "d_lon"),
        "l_lat": F.coalesce("l_lat", "o_lat"), "l_lon": F.coalesce("l_lon", "o_lon"),
    }).withColumn("o_unit", geo.unit_vector("o_lat", "o_lon")).withColumn("d_unit", geo.unit_vector("d_lat", "d_lon"))
    return rows.join(ends, "trip_id")


# --- corridor -----------------------------------------------------------------


def rail_line_hubs(plans: DataFrame, hubs: DataFrame) -> DataFrame:
    """Hubs within the corridor of each station pair's line, with their distance.

    Pairs share track, so each distinct stretch meets the hubs once.
    """
    rows = plans.filter("n_rides IS NOT NULL").select(
        "s", "t", F.explode(F.arrays_zip(
            F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b")
        )).alias("z"),
    ).select("s", "t", F.col("z.a.lat").alias("a_lat"), F.col("z.a.lon").alias("a_lon"), F.col("z.b.lat").alias("b_lat"), F.col("z.b.lon").alias("b_lon"))
    stretch = ["a_lat", "a_lon", "b_lat", "b_lon"]
    km = params.CORRIDOR_KM
    cells = rows.select(*stretch).distinct().withColumn("cell", F.explode(_segment_cells(*stretch)))
    met = cells.join(hubs.withColumn("cell", _cell_of("lat", "lon")), "cell").drop("cell")
    near = geo.with_segment_km(met, "km", ("a_lat", "a_lon"), ("b_lat", "b_lon")).filter(F.col("km") <= km).drop("lat", "lon")
    return rows.join(near, stretch).groupBy("s", "t", "hub_id").agg(F.min("km").alias("rail_km"))


def _cell_of(lat: str, lon: str) -> Column:
    return geo.cell(lat, CELL) * 100000 + geo.cell(lon, CELL)


def _segment_cells(a_lat, a_lon, b_lat, b_lon) -> Column:
    """Cells that the corridor around a segment may touch, row by row.

    A point of the corridor is no further than the margins from a point of the segment. So of a
    row of cells only the part counts that faces what the segment has in the row, widened by the
    margin: a slanting segment takes a strip and not its whole rectangle.
    """
    a_lat, a_lon, b_lat, b_lon = map(geo.col, (a_lat, a_lon, b_lat, b_lon))
    dy, dx = geo.lat_margin(params.CORRIDOR_KM), geo.lon_margin(params.CORRIDOR_KM)
    south, north = F.least(a_lat, b_lat), F.greatest(a_lat, b_lat)
    flat = north - south < 1e-6
    slope = (b_lon - a_lon) / F.when(flat, F.lit(1.0)).otherwise(b_lat - a_lat)

    def row(y: Column) -> Column:
        low = F.greatest(south, F.least(north, y * CELL - dy))
        high = F.least(north, F.greatest(south, (y + 1) * CELL + dy))
        at_low, at_high = a_lon + (low - a_lat) * slope, a_lon + (high - a_lat) * slope
        west = F.when(flat, F.least(a_lon, b_lon)).otherwise(F.least(at_low, at_high))
        east = F.when(flat, F.greatest(a_lon, b_lon)).otherwise(F.greatest(at_low, at_high))
        return F.transform(geo.cells_between(west - dx, east + dx, CELL), lambda x: y * 100000 + x)

    return F.flatten(F.transform(geo.cells_between(south - dy, north + dy, CELL), row))


def measure(rows: DataFrame, rail_km: Column) -> DataFrame:
    """Distances of a (search, hub) row: to the route, to the ends, and by chord.

    ``inside`` says whether the hub is in the corridor. It is a column and not a filter,
    since a filter pushed below these columns would compute them twice.
    """
    rows = geo.with_segment_km(rows, "_on_km", ("o_lat", "o_lon"), ("f_lat", "f_lon"))
    rows = geo.with_segment_km(rows, "_off_km", ("l_lat", "l_lon"), ("d_lat", "d_lon"))
    rows = rows.withColumns({
        "from_o": geo.between_units("o_unit", "unit"), "to_d": geo.between_units("unit", "d_unit"),
        "line_km": F.least("_on_km", "_off_km", rail_km),
    }).drop("_on_km", "_off_km")
    return rows.withColumns({
        "chord_km": F.greatest(F.lit(0.0), F.col("from_o") + F.col("to_d") - F.col("base_km")),
        "inside": (F.col("line_km") <= params.CORRIDOR_KM) | (F.least("from_o", "to_d") <= params.ENDPOINT_KM),
    })


def near_route(rows: DataFrame, hubs: DataFrame, line_hubs: DataFrame, keys: list[str]) -> DataFrame:
    """(search, hub) rows around the route, marked ``inside`` the corridor or not.

    ``rows`` carry the search with its baseline; ``hubs`` carry the same ``keys``. The
    line part is an equi-join on the station pair, computed once per pair and hub; the
    two end legs meet hubs by cell. A hub near both comes twice.
    """
    on_line = rows.filter("NOT walk_only").join(line_hubs.join(hubs, "hub_id"), ["s", "t", *keys])
    on_line = measure(on_line, F.col("rail_km")).drop("rail_km")
    legs = F.array_distinct(F.concat(_segment_cells("o_lat", "o_lon", "f_lat", "f_lon"), _segment_cells("l_lat", "l_lon", "d_lat", "d_lon")))
    by_cell = rows.withColumn("cell", F.explode(legs)).join(hubs.withColumn("cell", _cell_of("lat", "lon")), ["cell", *keys]).drop("cell")
    return on_line.unionByName(measure(by_cell, F.lit(None).cast("double")))


def expand_categories(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """Searches repeated for each category that can satisfy them, descendants included.

    The closure is the taxonomy itself, thirty rows, so it is broadcast: joined by shuffle
    the searches without a second errand would all land on one task.
    """
    sets = F.broadcast(closure.groupBy("ancestor").agg(F.collect_list(F.col("category").cast("int")).alias("cats")))
    one = sets.select(F.col("ancestor").alias("c1"), F.col("cats").alias("cats1"))
    two = sets.select(F.col("ancestor").alias("c2"), F.col("cats").alias("cats2"))
    whole = rows.join(one, "c1").join(two, "c2", "left").withColumn(
        "cats", F.array_distinct(F.concat("cats1", F.coalesce("cats2", F.array().cast("array<int>"))))
    )
    wanted = F.aggregate("cats", F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c.cast("int"))))
    whole = whole.withColumn("wanted", wanted).withColumn("sole", F.size("cats") == 1)
    return whole.withColumn("category", F.explode("cats")).drop("cats", "cats1", "cats2")


def once_per_hub(rows: DataFrame) -> DataFrame:
    """Of a hub met through several wanted categories, keep the row of the lowest one."""
    return rows.filter("(mask & wanted & (shiftleft(1L, cast(category as int)) - 1)) = 0")


def flags(rows: DataFrame) -> DataFrame:
    """Coverage and transit flags of a (search, hub) row."""
    rows = rows.withColumn("has1", has("mask", "c1")).withColumn("has2", has("mask", "c2"))
    coverage = F.when(F.col("c2").isNull() | (F.col("c1") == F.col("c2")), F.col("has1").cast("int")).otherwise(
        F.col("has1").cast("int") + F.col("has2").cast("int")
    )
    transit = (
        (F.col("kind") == 0) | F.coalesce(F.col("node_m") <= params.TRANSIT_M, F.lit(False))
        | (F.least("from_o", "to_d") <= params.ENDPOINT_KM)
    )
    return rows.withColumn("coverage", coverage).withColumn("transit", transit).withColumn("two", F.col("c2").isNotNull())


RANK = ("coverage DESC", "kind", "chord_km", "coalesce(node_m, 99999.0)", "hub_id")


def rank_order(*before: str) -> list[Column]:
    parts = [*before, *RANK]
    return [F.expr(p[:-5]).desc() if p.endswith(" DESC") else F.expr(p).asc() for p in parts]


def tags() -> Column:
    """A hub competes in the list of each category it serves; 3 marks full coverage."""
    return F.array_compact(
        F.array(
            F.when(F.col("has1"), 1), F.when(F.col("two") & F.col("has2"), 2),
            F.when(~F.col("has1") & ~F.col("has2"), 0),
        )
    )


def inside_only(found: Column) -> Column:
    """No rows for hubs outside the corridor when exploded."""
    return F.when(F.col("inside"), found)


SLIM = (
    "sid", "hub_id", "lat", "lon", "two", "max_candidates", "kind", "node_m", "has1", "has2", "coverage", "transit", "line_km", "from_o", "to_d", "chord_km",
)
LIST_LIMIT = 3 * params.MAX_CANDIDATES


def top_lists(rows: DataFrame, limit: int, *first: str) -> DataFrame:
    """Best rows of each (search, tag); the constant limit lets Spark cut before the shuffle."""
    order = Window.partitionBy("sid", "tag").orderBy(*rank_order(*first))
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")


def tagged(rows: DataFrame) -> DataFrame:
    return flags(rows).withColumn("tag", F.explode(inside_only(tags()))).select(*SLIM, "tag")


def category_pairs(hub_rows: DataFrame) -> DataFrame:
    """Hubs that serve two categories, one row per ordered pair."""
    other = hub_rows.select("hub_id", F.col("category").alias("c2"))
    return hub_rows.withColumnRenamed("category", "c1").join(other, "hub_id").filter("c1 <> c2")


def _offers(hub_rows: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """Hubs by what they offer: a category, with a brand or any (-1), beside another category or any (-1)."""
    none = F.lit(-1).cast("bigint")
    plain = hub_rows.select("hub_id", "lat", "lon", "unit", "kind", "node_m", F.col("category").cast("bigint").alias("wants"), none.alias("brand"), "mask")
    if brands is not None:
        known = brands.select("hub_id", F.col("category").cast("bigint").alias("wants"), F.col("brand").cast("bigint").alias("brand"))
        plain = plain.unionByName(plain.drop("brand").join(known, ["hub_id", "wants"]))
    others = F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda c: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)) != 0)
    beside = F.array_union(F.array(none), F.filter(F.transform(others, lambda c: c.cast("bigint")), lambda c: c != F.col("wants")))
    return plain.withColumn("beside", F.explode(beside)).drop("mask")


def from_catalog(wanted: DataFrame, search_rows: DataFrame, hub_rows: DataFrame, lines: DataFrame, k: int, brands: DataFrame | None = None) -> DataFrame:
    """(search, hub) rows over the whole catalog that can be among the best ``k`` of a list.

    ``wanted``: sid, wants, brand, beside; hubs that serve both errands rank before others, so lists
    ask for them apart. Of each kind of hub the ``k`` of least detour are found between the two
    ends of the trip; a hub that is not among them has ``k`` better ones of its own coverage and kind.
    """
    keys = ["wants", "brand", "beside", "kind"]
    ends = search_rows.select("sid", *ROUTE_FIELDS, "base_km", "o_unit", "d_unit")
    needs = wanted.distinct().withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).join(ends, "sid")
    chord = F.greatest(F.lit(0.0), geo.between_units("o_unit", "unit") + geo.between_units("unit", "d_unit") - F.col("base_km"))
    ties = [F.coalesce("node_m", F.lit(99999.0)), F.col("hub_id")]
    found = foci.least_detour(needs, _offers(hub_rows, brands), ["sid", *keys], keys, k, chord, ties, ["hub_id"], LEFTOVER_KM)
    once = hub_rows.filter("(mask & (shiftleft(1L, cast(category as int)) - 1)) = 0").drop("category")
    met = found.select("sid", "hub_id").distinct().join(search_rows.join(lines, ["s", "t"], "left"), "sid").join(once, "hub_id")
    line = F.aggregate(
        F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b")),
        F.lit(1e9),
        lambda best, z: F.least(best, geo.segment_km("lat", "lon", z["a"]["lat"], z["a"]["lon"], z["b"]["lat"], z["b"]["lon"])),
    )
    exact = F.when(F.col("walk_only"), F.col("line_km")).otherwise(F.least("line_km", line))
    return flags(measure(met, F.lit(None).cast("double")).withColumn("line_km", exact))


def _asking(rows: DataFrame, wants: str, brand: str | None, other: str) -> DataFrame:
    """What a list of errand ``wants`` asks of the catalog: alone, and beside the other errand."""
    none = F.lit(-1).cast("bigint")
    beside = F.array_compact(F.array(none, F.when(F.col(other) != F.col(wants), F.col(other).cast("bigint"))))
    named = F.coalesce(F.col(brand).cast("bigint"), none) if brand else none
    return rows.filter(F.col(wants).isNotNull()).select("sid", F.col(wants).cast("bigint").alias("wants"), named.alias("brand"), F.explode(beside).alias("beside"))


def near_lists(search_rows: DataFrame, hub_rows: DataFrame, line_hubs: DataFrame, closure: DataFrame) -> DataFrame:
    """Best corridor hubs of each (search, category); twice the limit, as a hub may come twice."""
    met = once_per_hub(near_route(expand_categories(search_rows, closure), hub_rows, line_hubs, ["category"]))
    return top_lists(tagged(met), 2 * LIST_LIMIT, "transit DESC")


def corridor_lists(search_rows: DataFrame, hub_rows: DataFrame, plans: DataFrame, closure: DataFrame, cut: bool = False) -> DataFrame:
    """Best corridor hubs of each list, and those that serve both errands, met in cogroups of a category.

    With ``cut`` only the hubs that kept options can be made of; see ``corridor.lists``.
    """
    spots = hub_rows.filter("(mask & (shiftleft(1L, cast(category as int)) - 1)) = 0")
    tracks = corridor.stretches(plans)
    near = corridor.near_stretches(tracks, spots, _segment_cells, _cell_of)
    return corridor.lists(expand_categories(search_rows, closure), hub_rows, near, tracks, search_rows.count(), cut)


def served(*rows: DataFrame) -> DataFrame:
    """Per search, which errands its lists serve once hubs without transit access are gone."""
    slim = [r.select("sid", "has1", "has2", "transit") for r in rows]
    whole = slim[0]
    for r in slim[1:]:
        whole = whole.unionByName(r)
    met = whole.groupBy("sid").agg(F.bool_or("transit").alias("any_transit"), *[
        f(c) for c in ("has1", "has2") for f in (lambda c: F.bool_or(c).alias(c), lambda c: F.bool_or(F.col(c) & F.col("transit")).alias(f"near_{c}"))
    ])
    return met.select("sid", *[F.when(F.col("any_transit"), F.col(f"near_{c}")).otherwise(F.col(c)).alias(c) for c in ("has1", "has2")])


def shortlisted(near: DataFrame, far: DataFrame, rescued: DataFrame) -> DataFrame:
    """Lists with transit access and the rescued hubs, as the short list of each search.

    Dealt out by search once: every step after it works inside a search.
    """
    plain = near.select(*SLIM, "tag").unionByName(far).withColumn("extra", F.lit(False))
    rows = spread(plain.unionByName(rescued.withColumn("extra", F.lit(True))), "sid")
    any_transit = F.max(F.col("transit") & ~F.col("extra")).over(Window.partitionBy("sid"))
    kept = rows.withColumn("any_transit", any_transit).filter("extra OR transit OR NOT any_transit")
    return select_hubs(kept.drop("extra", "any_transit"))


def full_cover(search_rows: DataFrame, hub_rows: DataFrame, line_hubs: DataFrame) -> DataFrame:
    """Corridor hubs that serve both errands, all of them: an equi-join on the category pair."""
    pairs = category_pairs(hub_rows)
    both = near_route(search_rows.filter("c2 IS NOT NULL AND c1 <> c2"), pairs, line_hubs, ["c1", "c2"])
    return flags(both).withColumn("tag", F.explode(inside_only(F.array(F.lit(3))))).select(*SLIM, "tag")


def _own_limit() -> Column:
    return F.greatest(3 * F.col("max_candidates"), F.lit(params.HUBS_PER_CATEGORY))


def corridor_fallback(search_rows: DataFrame, near: DataFrame, hub_rows: DataFrame, closure: DataFrame, lines: DataFrame) -> DataFrame:
    """Searches without any corridor hub: the best-ranked hubs of the category stand in."""
    far = search_rows.join(near.select("sid").distinct(), "sid", "left_anti")
    below = expand_categories(far.select("sid", "c1", "c2"), closure).withColumn("none", F.lit(None).cast("bigint"))
    wanted = _asking(below, "category", None, "none").unionByName(_asking(far, "c1", None, "c2"))
    rows = from_catalog(wanted, far, hub_rows, lines, LIST_LIMIT).withColumn(
        "rn", F.row_number().over(Window.partitionBy("sid").orderBy(*rank_order()))
    )
    return _all_tags(rows.filter(F.col("rn") <= LIST_LIMIT).filter(F.col("rn") <= _own_limit()))


def transit_access(rows: DataFrame) -> DataFrame:
    """Hubs with transit access, unless that would leave the search empty."""
    any_transit = F.max("transit").over(Window.partitionBy("sid"))
    return dedupe(rows).withColumn("any_transit", any_transit).filter("transit OR NOT any_transit").drop("any_transit")


def coverage_rescue(search_rows: DataFrame, rows: DataFrame, hub_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The best two hubs for each wanted category the filters left without any.

    The second category looks at what the first one's rescue brought in as well.
    """
    best_two = F.row_number().over(Window.partitionBy("sid").orderBy(*rank_order()))
    first = search_rows.join(rows.filter("has1").select("sid").distinct(), "sid", "left_anti")
    first = from_catalog(_asking(first, "c1", None, "c2"), first, hub_rows, lines, 2).filter("has1").withColumn("rn", best_two).filter("rn <= 2")
    first = _all_tags(first)
    served = rows.filter("has2").select("sid").union(first.filter("has2").select("sid")).distinct()
    second = search_rows.filter("c2 IS NOT NULL").join(served, "sid", "left_anti")
    second = from_catalog(_asking(second, "c2", None, "c1"), second, hub_rows, lines, 2).filter("has2").withColumn("rn", best_two).filter("rn <= 2")
    return first.unionByName(_all_tags(second))


def select_hubs(rows: DataFrame) -> DataFrame:
    """Full-coverage hubs and the best of each category's list, one row per hub."""
    limit = F.when(F.col("two"), params.HUBS_PER_CATEGORY).otherwise(_own_limit())
    place = F.row_number().over(Window.partitionBy("sid", "tag").orderBy(*rank_order()))
    kept = dedupe(rows).withColumn("rn", place).filter((F.col("tag") == 3) | ((F.col("tag") > 0) & (F.col("rn") <= limit)))
    return kept.groupBy("sid", "hub_id").agg(*[F.first(c).alias(c) for c in SLIM if c not in ("sid", "hub_id")])


def _all_tags(rows: DataFrame) -> DataFrame:
    full = F.col("has1") & F.col("has2") & F.col("two")
    every = F.array_compact(F.concat(tags(), F.array(F.when(full, 3))))
    return rows.withColumn("tag", F.explode(every)).select(*SLIM, "tag")


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per (search, tag, hub): the shorter of the distances to the route."""
    rest = [c for c in SLIM if c not in ("sid", "hub_id", "line_km")]
    return rows.groupBy("sid", "tag", "hub_id").agg(
        F.min("line_km").alias("line_km"), *[F.first(c).alias(c) for c in rest]
    ).select(*SLIM, "tag")


def complete(rows: DataFrame, search_rows: DataFrame, brands: DataFrame) -> DataFrame:
    """Shortlisted hubs with the fields of their search and the brand test; few searches ask for a brand."""
    head = search_rows.select("sid", "trip_id", "search_no", "c1", "c2", "brand1", "brand2", "match_class", *ROUTE_FIELDS, "base_km")
    asked = "brand1 IS NOT NULL OR brand2 IS NOT NULL"
    named = mark_brands(rows.join(head.filter(asked), "sid"), brands)
    return rows.join(head.filter(f"NOT ({asked})"), "sid").withColumn("sat1", F.col("has1")).withColumn("sat2", F.col("has2")).unionByName(named)


# --- options ------------------------------------------------------------------


def mark_brands(rows: DataFrame, brands: DataFrame) -> DataFrame:
    """Whether a hub satisfies the exact brand asked for in each category."""
    for n in (1, 2):
        wanted = brands.select("hub_id", F.col("category").alias(f"c{n}"), F.col("brand").alias(f"brand{n}"), F.lit(True).alias(f"met{n}"))
        rows = rows.join(wanted, ["hub_id", f"c{n}", f"brand{n}"], "left").withColumn(
            f"sat{n}", F.col(f"has{n}") & (F.col(f"brand{n}").isNull() | F.coalesce(F.col(f"met{n}"), F.lit(False)))
        ).drop(f"met{n}")
    return rows


def stop_cost() -> Column:
    return 2 * F.col("line_km") + F.coalesce(F.col("node_m") / 1000, F.lit(0.0))


def options(rows: DataFrame, cut: bool = False) -> DataFrame:
    """Single stops, consolidated stops and unordered pairs of a shortlist.

    ``rows`` must carry sat1/sat2. A pair is built once, with the assignment met first.
    A full-coverage hub that satisfies the request alone beats every pair it is part of,
    so a planner that keeps the best may ask for the ``cut``: only the six best of those
    enter pairs, and nothing that could be chosen is lost.
    """
    two = F.col("c2").isNotNull()
    head = ["sid", "trip_id", "search_no", "c1", "c2", "brand1", "brand2", "match_class", "max_candidates", *ROUTE_FIELDS, "base_km"]
    none = F.lit(None)
    alone = rows.filter((~two & F.col("sat1")) | (two & F.col("sat1") & F.col("sat2")))
    single = alone.select(
        *head, F.col("hub_id").alias("stop1"), none.cast("bigint").alias("stop2"), F.lit(True).alias("first_low"),
        two.alias("consolidated"), "chord_km", stop_cost().alias("cost_km"), F.lit(1).alias("n_stops"),
        F.col("from_o").alias("o_reach"), F.col("to_d").alias("d_reach"),
        F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), none.cast("double").alias("lat2"), none.cast("double").alias("lon2"),
    )
    lone = F.col("has1") & F.col("has2") & F.col("sat1") & F.col("sat2")
    by_cost = Window.partitionBy("sid", "lone").orderBy(F.round(stop_cost(), 3), "chord_km", "hub_id")
    by_rank = Window.partitionBy("sid").orderBy(*rank_order())
    members = (
        rows.filter(two)
        .withColumn("lone", lone)
        .withColumn("cheap", F.row_number().over(by_cost))
        .withColumn("place", F.row_number().over(by_rank))
    )
    if cut:
        members = members.filter(~F.col("lone") | (F.col("cheap") <= params.MAX_CANDIDATES))
    side = ["hub_id", "lat", "lon", "from_o", "to_d", "has1", "has2", "place"]

    def named(prefix: str, frame: DataFrame, keep: list[str]) -> DataFrame:
        return frame.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in side], stop_cost().alias(f"{prefix}_cost"))

    left = named("a", members.filter("sat1"), head)
    right = named("b", members.filter("has2"), ["sid", "sat2"]).filter("sat2").drop("sat2")
    met = left.join(right, "sid").filter(
        (F.col("a_hub_id") != F.col("b_hub_id"))
        & ~(F.col("a_has2") & F.col("b_has1") & (F.col("a_place") > F.col("b_place")))
    )
    ab = geo.haversine_km("a_lat", "a_lon", "b_lat", "b_lon")
    shortest = F.least(F.col("a_from_o") + ab + F.col("b_to_d"), F.col("b_from_o") + ab + F.col("a_to_d"))
    low = F.col("a_hub_id") < F.col("b_hub_id")

    def pick(name: str, first: bool) -> Column:
        return F.when(low == F.lit(first), F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))

    paired = met.select(
        *head, pick("hub_id", True).alias("stop1"), pick("hub_id", False).alias("stop2"), low.alias("first_low"),
        F.lit(False).alias("consolidated"), F.greatest(F.lit(0.0), shortest - F.col("base_km")).alias("chord_km"),
        (F.col("a_cost") + F.col("b_cost")).alias("cost_km"), F.lit(2).alias("n_stops"),
        F.greatest("a_from_o", "b_from_o").alias("o_reach"), F.greatest("a_to_d", "b_to_d").alias("d_reach"),
        pick("lat", True).alias("lat1"), pick("lon", True).alias("lon1"), pick("lat", False).alias("lat2"), pick("lon", False).alias("lon2"),
    )
    return single.unionByName(paired)


def within_cap(rows: DataFrame) -> DataFrame:
    """Options within the chord cap; the cap is ignored where no option passes."""
    capped = F.col("chord_km") <= params.CHORD_CAP_KM
    return rows.withColumn("cost3", F.round("cost_km", 3)).withColumn(
        "any_capped", F.max(capped).over(Window.partitionBy("sid"))
    ).filter(capped | ~F.col("any_capped")).drop("any_capped")


def network_order(rows: DataFrame) -> DataFrame:
    """Place of each option by network cost, chord, stop count and ids."""
    order = ["cost3", "chord_km", "n_stops", "stop1", F.coalesce("stop2", F.lit(-1))]
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("sid").orderBy(*order)))


def prune(rows: DataFrame) -> DataFrame:
    """The options worth a routing call, with their position in the list.

    Options beyond the chord cap go unless that empties the search. The best option
    beside each end always stays, taking the place of the last one not so reserved.
    """
    whole = Window.partitionBy("sid")

    def beside(reach: str) -> Column:
        near = F.col(reach) <= params.RESERVE_KM
        rank = F.row_number().over(whole.orderBy(F.when(near, 0).otherwise(1), "n_stops", reach, "stop1", F.coalesce("stop2", F.lit(-1))))
        return near & (rank == 1)

    rows = (
        network_order(within_cap(rows))
        .withColumn("by_o", beside("o_reach"))
        .withColumn("by_d", beside("d_reach"))
        .filter((F.col("at") <= F.col("max_candidates")) | F.col("by_o") | F.col("by_d"))
    )
    reserved = F.col("by_o") | F.col("by_d")
    chosen = F.col("at") <= F.col("max_candidates")
    rows = rows.withColumn("outside", reserved & ~chosen & (F.col("max_candidates") >= 2))
    rows = rows.filter(chosen | F.col("outside")).withColumn("n_outside", F.sum(F.col("outside").cast("int")).over(whole))
    free = chosen & ~reserved
    rows = rows.withColumn(
        "from_end", F.sum(free.cast("int")).over(whole.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0))
    )
    dropped = free & (F.col("from_end") <= F.col("n_outside"))
    # An outside reserve takes the slot it freed: origin first, from the end of the list.
    rows = rows.withColumn("slots", F.array_sort(F.collect_list(F.when(dropped, F.col("at"))).over(whole)))
    turn = F.row_number().over(Window.partitionBy("sid", "outside").orderBy(F.when(F.col("by_o"), 0).otherwise(1)))
    rows = rows.withColumn("turn", turn).filter(~dropped)
    slot = F.try_element_at("slots", F.greatest(F.size("slots") - F.col("turn") + 1, F.lit(1)))
    return rows.withColumn("position", F.when(F.col("outside"), slot).otherwise(F.col("at"))).drop(
        "at", "by_o", "by_d", "outside", "n_outside", "from_end", "slots", "turn"
    )


def exact_fallback(search_rows: DataFrame, found: DataFrame, hub_rows: DataFrame, brands: DataFrame, lines: DataFrame) -> DataFrame:
    """Shortlists for constrained searches left without options: the whole catalog counts.

    Only searches whose brand exists in the wanted category can gain anything.
    """
    asked = search_rows.filter("brand1 IS NOT NULL OR brand2 IS NOT NULL").join(found.select("sid").distinct(), "sid", "left_anti")
    known = brands.select("category", "brand").distinct()
    for n in (1, 2):
        offered = known.select(F.col("category").alias(f"c{n}"), F.col("brand").alias(f"brand{n}"), F.lit(True).alias("offered"))
        asked = asked.join(offered, [f"c{n}", f"brand{n}"], "left").filter(F.col("offered") | F.col(f"brand{n}").isNull()).drop("offered")
    wanted = _asking(asked, "c1", "brand1", "c2").unionByName(_asking(asked, "c2", "brand2", "c1"))
    rows = mark_brands(from_catalog(wanted, asked, hub_rows, lines, params.HUBS_PER_CATEGORY, brands), brands)
    every = F.array_compact(F.array(F.when(F.col("sat1"), 1), F.when(F.col("sat2") & F.col("two"), 2)))
    best = top_lists(rows.withColumn("tag", F.explode(every)).select(*SLIM, "tag"), params.HUBS_PER_CATEGORY)
    return best.drop("tag").groupBy("sid", "hub_id").agg(*[F.first(c).alias(c) for c in SLIM if c not in ("sid", "hub_id")])


def option_counts(rows: DataFrame) -> DataFrame:
    """How many options each search has, without building the pairs.

    A pair counts once, with the better-ranked hub first when both serve both errands:
    per first hub, all second hubs but itself and the full-coverage ones ranked before it.
    """
    two = F.col("c2").isNotNull()
    alone = (~two & F.col("sat1")) | (two & F.col("sat1") & F.col("sat2"))
    second = two & F.col("has2") & F.col("sat2")
    earlier = Window.partitionBy("sid").orderBy(*rank_order()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("second", second).withColumn(
        "before", F.coalesce(F.sum((F.col("second") & F.col("has1")).cast("int")).over(earlier), F.lit(0))
    ).withColumn("n_second", F.sum(F.col("second").cast("int")).over(Window.partitionBy("sid")))
    own = F.col("n_second") - F.col("second").cast("int") - F.when(F.col("has2"), F.col("before")).otherwise(0)
    pairs = F.when(two & F.col("sat1"), own).otherwise(0)
    return rows.groupBy("sid").agg(F.sum(F.when(alone, 1).otherwise(0) + pairs).alias("n_options"))


def relationship(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """How the stops of an option relate: one stop, one building, one area, near or apart."""
    one = hubs.select(F.col("hub_id").alias("stop1"), F.col("semantic_type").alias("type1"), F.col("group_id").alias("group1"), F.col("area_id").alias("area1"))
    two = hubs.select(F.col("hub_id").alias("stop2"), F.col("group_id").alias("group2"), F.col("area_id").alias("area2"))
    rows = rows.join(one, "stop1").join(two, "stop2", "left")
    apart = geo.haversine_km("lat1", "lon1", "lat2", "lon2")
    kind = (
        F.when(F.col("consolidated"), F.when(F.col("type1") == "mall", "same_mall").otherwise("same_place"))
        .when(F.col("n_stops") == 1, "single_stop")
        .when(F.col("group1") == F.col("group2"), "same_place")
        .when(F.col("area1") == F.col("area2"), "same_transport_hub")
        .when(apart <= params.NEARBY_STOPS_KM, "nearby_separate_stores")
        .otherwise("separate_stops")
    )
    return rows.withColumn("stop_relationship", kind).drop("type1", "group1", "area1", "group2", "area2")


def admit(rows: DataFrame) -> DataFrame:
    """Options that still fit the routing budget, in list order; dear ones are skipped.

    A running sum would be wrong, since an option that does not fit leaves its share to
    the next. A trip has at most ten options, so one small array per trip is folded.
    """
    entry = F.struct("search_no", "position", F.when(F.col("n_stops") == 1, 2).otherwise(6).alias("calls"), "sid", "stop1", F.coalesce("stop2", F.lit(-1)).alias("s2"))
    start = F.struct(F.lit(params.HARD_BUDGET - 1).alias("left"), F.expr("cast(array() as array<struct<sid:bigint,stop1:bigint,s2:bigint>>)").alias("taken"))

    def step(state: Column, item: Column) -> Column:
        fits = item["calls"] <= state["left"]
        mark = F.struct(item["sid"].alias("sid"), item["stop1"].alias("stop1"), item["s2"].cast("bigint").alias("s2"))
        return F.struct(
            F.when(fits, state["left"] - item["calls"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["taken"], F.array(mark))).otherwise(state["taken"]).alias("taken"),
        )

    kept = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(entry)).alias("items")).select(
        F.explode(F.aggregate("items", start, step)["taken"]).alias("k")
    ).select("k.*")
    return rows.withColumn("s2", F.coalesce("stop2", F.lit(-1))).join(kept, ["sid", "stop1", "s2"], "left_semi").drop("s2")


def near_misses(needs: DataFrame, hub_rows: DataFrame, substitutes: DataFrame, closure: DataFrame) -> DataFrame:
    """Per asked category the hub of its substitute with the least chord detour."""
    swap = substitutes.select(F.col("category").alias("asked"), "substitute")
    wanted = closure.select(F.col("ancestor").alias("substitute"), F.col("category").cast("bigint").alias("category"))
    rows = needs.select("trip_id", "asked", *ROUTE_FIELDS, "base_km").distinct().join(swap, "asked").join(wanted, "substitute")
    rows = rows.select("trip_id", "category", *ROUTE_FIELDS, "base_km").distinct()
    chord = F.round(F.greatest(
        F.lit(0.0), geo.haversine_km("o_lat", "o_lon", "lat", "lon") + geo.haversine_km("lat", "lon", "d_lat", "d_lon") - F.col("base_km")
    ), 9)
    sites = hub_rows.select("hub_id", "lat", "lon", F.col("category").cast("bigint").alias("category"))
    near = foci.least_detour(rows, sites, ["trip_id", "category"], ["category"], 1, chord, [F.col("hub_id")], ["hub_id"])
    asked = needs.select("trip_id", "asked").distinct().join(swap, "asked").join(wanted, "substitute")
    best = F.min(F.struct(F.col("chord_km").alias("km"), "hub_id")).alias("best")
    return asked.join(near, ["trip_id", "category"]).groupBy("trip_id", "asked", "substitute").agg(best).select(
        "trip_id", "asked", "substitute", F.col("best.hub_id").alias("hub_id"), F.col("best.km").alias("chord_km")
    )
