"""Spatial joins as equi-joins on grid cells.

A theta join on distance alone becomes a nested loop, so each operator here turns
distance into cell keys first and keeps the exact test as a filter. Points enter
as distinct coordinates: places that share a coordinate share the answer, so a
crowded spot costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from ..functions import geo
from . import foci

# Nearest-neighbour grid sizes in degrees; each is four times the one before.
LEVELS = (0.0005, 0.002, 0.008, 0.032, 0.128, 0.512, 2.048)
# Way there and back of the first ring around a point that no grid connects to a site.
FAR_KM = 512.0


def _level_keys(lat: Column, lon: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("level"), geo.cell(lat, size).alias("cy"), geo.cell(lon, size).alias("cx"))
            for i, size in enumerate(LEVELS)
        ]
    )


def _ring(frame: DataFrame) -> DataFrame:
    """Each cell row repeated for the 3x3 block around it."""
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    return (
        frame.withColumn("step", F.explode(steps))
        .withColumn("cy", F.col("cy") + F.col("step.y"))
        .withColumn("cx", F.col("cx") + F.col("step.x"))
        .drop("step")
    )


def nearest(points: DataFrame, sites: DataFrame, site_id: str = "site_id") -> DataFrame:
    """Exact nearest site of every distinct (lat, lon) in ``points``.

    The finest grid whose 3x3 block holds any site bounds the distance by less than
    one cell of the next coarser grid, so one equi-join on that coarser grid sees the
    true nearest. Points that only the last grid or none connects to a site are searched in
    widening rings. Ties go to the smaller site id; without sites there are no rows. Sites repeated for
    levels and blocks are many times what their table's size tells, so they are never broadcast.
    """
    places = points.select("lat", "lon").distinct()
    distinct_sites = sites.groupBy("lat", "lon").agg(F.min(site_id).alias(site_id))
    site_cells = distinct_sites.select(
        site_id, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
        F.explode(_level_keys(F.col("lat"), F.col("lon"))).alias("k"),
    ).select(site_id, "s_lat", "s_lon", "k.*")
    reached = _ring(site_cells.select("level", "cy", "cx").distinct()).distinct()
    finest = (
        places.withColumn("k", F.explode(_level_keys(F.col("lat"), F.col("lon"))))
        .select("lat", "lon", "k.*")
        .join(reached.hint("merge"), ["level", "cy", "cx"], "left_semi")
        .groupBy("lat", "lon")
        .agg((F.min("level") + 1).alias("level"))
        .filter(F.col("level") < len(LEVELS))
    )
    size = F.element_at(F.array(*[F.lit(s) for s in LEVELS]), F.col("level") + 1)
    keyed = finest.withColumn("cy", F.floor(F.col("lat") / size)).withColumn("cx", F.floor(F.col("lon") / size))
    metres = geo.haversine_km("lat", "lon", "s_lat", "s_lon") * 1000
    best = F.min(F.struct(metres.alias("metres"), F.col(site_id).alias("id"))).alias("best")
    close = keyed.join(_ring(site_cells).hint("merge"), ["level", "cy", "cx"]).groupBy("lat", "lon").agg(best).select("lat", "lon", "best.*")
    far = places.join(finest.select("lat", "lon").hint("merge"), ["lat", "lon"], "left_anti")
    rest = _rings(far, distinct_sites.withColumnRenamed(site_id, "id"), 1).select("lat", "lon", (F.col("km") * 1000).alias("metres"), "id")
    return close.unionByName(rest).select("lat", "lon", F.col("id").alias(site_id), F.round("metres", 1).alias("distance_m"))


def _rings(far: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """``lat, lon, id, km`` of the ``k`` nearest sites: an ellipse whose foci are one point is a circle."""
    one = F.lit(1).alias("any")
    needs = far.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
        "lat", "lon", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"),
        F.lit(0.0).alias("base_km"), one,
    ).withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    there_and_back = 2 * geo.haversine_km("o_lat", "o_lon", "lat", "lon")
    found = foci.least_detour(needs, sites.select("id", "lat", "lon", one), ["p_lat", "p_lon"], ["any"], k, there_and_back, [F.col("id")], ["id"], FAR_KM)
    return found.select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "id", (F.col("chord_km") / 2).alias("km"))


def within(points: DataFrame, sites: DataFrame, km: float, distance: Column | None = None) -> DataFrame:
    """Pairs of (point row, site row) no further apart than ``km``.

    ``points`` has lat and lon, ``sites`` has s_lat and s_lon; the pair keeps every
    column of both and adds ``km``.
    """
    size = geo.lon_margin(km)
    apart = distance if distance is not None else geo.haversine_km("lat", "lon", "s_lat", "s_lon")
    left = points.withColumn("cy", geo.cell("lat", size)).withColumn("cx", geo.cell("lon", size))
    right = _ring(sites.withColumn("cy", geo.cell("s_lat", size)).withColumn("cx", geo.cell("s_lon", size)))
    return left.join(right.hint("merge"), ["cy", "cx"]).withColumn("km", apart).filter(F.col("km") <= km).drop("cy", "cx")


def inside_boxes(points: DataFrame, boxes: DataFrame, size: float = 0.002) -> DataFrame:
    """Points inside rectangles (south, north, west, east), as (point, box) pairs."""
    covered = boxes.withColumn("cy", F.explode(geo.cells_between("south", "north", size))).withColumn(
        "cx", F.explode(geo.cells_between("west", "east", size))
    )
    return (
        points.withColumn("cy", geo.cell("lat", size))
        .withColumn("cx", geo.cell("lon", size))
        .join(covered.hint("merge"), ["cy", "cx"])
        .filter(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
        .drop("cy", "cx")
    )


CATCHMENT_CELL = 0.02
CATCHMENT_SLACK_KM = 3.2  # twice the half diagonal of a catchment cell


def catchments(sites: DataFrame, k: int, metric: str = "km") -> DataFrame:
    """For each cell of the city, the sites that can be among its ``k`` nearest names.

    ``sites`` is a network dimension (site_id, name, s_lat, s_lon). The grid is the
    contract rectangle, so the result is bounded by the city and not by the data.
    """
    south, north, west, east = params.CONTRACT
    grid = sites.withColumn(
        "cy", F.explode(F.sequence(F.lit(int(south / CATCHMENT_CELL)), F.lit(int(north / CATCHMENT_CELL))))
    ).withColumn("cx", F.explode(F.sequence(F.lit(int(west / CATCHMENT_CELL)), F.lit(int(east / CATCHMENT_CELL)))))
    centre_lat = (F.col("cy") + 0.5) * CATCHMENT_CELL
    centre_lon = (F.col("cx") + 0.5) * CATCHMENT_CELL
    far = grid.withColumn("d", geo.haversine_km(centre_lat, centre_lon, "s_lat", "s_lon"))
    by_name = far.groupBy("cy", "cx", "name").agg(F.min("d").alias("d"))
    reach = by_name.groupBy("cy", "cx").agg(
        (F.element_at(F.array_sort(F.collect_list("d")), F.least(F.count("*").cast("int"), F.lit(k))) + CATCHMENT_SLACK_KM).alias("reach")
    )
    return far.join(reach, ["cy", "cx"]).filter("d <= reach").select(
        F.col("cy").cast("bigint").alias("cy"), F.col("cx").cast("bigint").alias("cx"), "site_id", "name", "s_lat", "s_lon"
    )


def k_nearest(points: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` nearest sites with distinct names of every distinct (lat, lon).

    Points outside the city, which have no catchment, are searched in widening rings. Among the
    nearest ``k * m`` sites, no name having more than m, are ``k`` names and the nearest of each.
    """
    places = points.select("lat", "lon").distinct()
    south, north, west, east = params.CONTRACT
    cells = [(int(a / CATCHMENT_CELL), int(b / CATCHMENT_CELL)) for a, b in ((south, north), (west, east))]
    near = places.withColumn("cy", geo.cell("lat", CATCHMENT_CELL)).withColumn("cx", geo.cell("lon", CATCHMENT_CELL))
    inside = F.col("cy").between(*cells[0]) & F.col("cx").between(*cells[1])
    close = near.filter(inside).join(catchments(sites, k), ["cy", "cx"])
    close = close.select("lat", "lon", geo.haversine_km("lat", "lon", "s_lat", "s_lon").alias("km"), "site_id", "name")
    far = near.filter(~inside).select("lat", "lon")
    most = sites.groupBy("name").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    spots = sites.select(F.col("site_id").alias("id"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))
    rest = _rings(far, spots, k * most).join(sites.select(F.col("site_id").alias("id"), "name"), "id")
    rows = close.unionByName(rest.select("lat", "lon", "km", F.col("id").alias("site_id"), "name"))
    entry = F.struct("km", "site_id", "name")
    ranked = rows.groupBy("lat", "lon").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    first_of_name = F.filter(
        "near", lambda s, i: ~F.exists(F.slice("near", F.lit(1), i), lambda earlier: earlier["name"] == s["name"])
    )
    return ranked.select("lat", "lon", F.slice(first_of_name, 1, k).alias("near"))
