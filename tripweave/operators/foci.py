"""Best sites between two ends: the exact k of least detour, by widening ellipses.

The detour of a site is the way origin - site - destination less the straight way. All
sites up to a detour of m lie in the ellipse whose foci are the two ends, so a need meets
the cells of that ellipse alone: an equi-join on (keys, level, cell). The grid follows the
ellipse, so the cells of a need stay a few dozen at any size. Needs with their k sites, or
with all there are, are settled and leave; the rest go into the next round with four times
the margin. What is not seen in a round has a longer detour than all that is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..session import store

#: Detour of the first round in km, and the factor of the next ones.
FIRST_KM, WIDER = 2.0, 4.0
#: Half the circumference of the Earth, twice: no detour is longer.
LONGEST_KM = 42_000.0
#: Side of the finest cells in degrees; each level doubles it.
FINEST, LEVELS = 0.0125, 16
#: Cells along the longer axis of an ellipse.
ACROSS = 4
#: Share of a planar lower bound that holds on the sphere over an ellipse's box.
SLACK = 0.95


def _size(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(2.0), level)


def _cell(lat: Column, lon: Column, size: Column) -> Column:
    return F.floor(lat / size).cast("bigint") * 1_000_000 + F.floor(lon / size).cast("bigint")


def ellipses(needs: DataFrame, margin: float) -> DataFrame:
    """``needs`` with ``level`` and one row per ``cell`` that their ellipse may touch.

    A cell stays if the shortest ways to its rectangle, lower bounds both, fit into the sum.
    Longitudes do not wrap at 180 degrees.
    """
    rows = needs.withColumn("_sum", (F.col("base_km") + margin) * 1.001 + 0.001)
    rows = rows.withColumn("_lat", (F.col("o_lat") + F.col("d_lat")) / 2).withColumn("_lon", (F.col("o_lon") + F.col("d_lon")) / 2)
    rows = rows.withColumn("_dy", F.col("_sum") / 2 / geo.KM_PER_LAT / SLACK)
    polar = F.least(F.abs("_lat") + F.col("_dy"), F.lit(89.0))
    rows = rows.withColumn("_per_lon", F.cos(F.radians(polar)) * geo.KM_PER_LON)
    rows = rows.withColumn("_dx", F.least(F.col("_sum") / 2 / F.col("_per_lon") / SLACK, F.lit(360.0)))
    widest = 2 * F.greatest("_dy", "_dx") / (ACROSS * FINEST)
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(widest, F.lit(1.0)))))).cast("int")
    rows = rows.withColumn("level", level).withColumn("_size", _size(F.col("level")))
    span = lambda at, half: F.sequence(F.floor((F.col(at) - F.col(half)) / F.col("_size")).cast("bigint"), F.floor((F.col(at) + F.col(half)) / F.col("_size")).cast("bigint"))
    rows = rows.withColumn("_y", F.explode(span("_lat", "_dy"))).withColumn("_x", F.explode(span("_lon", "_dx")))

    def reach(lat: str, lon: str) -> Column:
        gap = lambda value, k: F.greatest(F.lit(0.0), F.col(k) * F.col("_size") - F.col(value), F.col(value) - (F.col(k) + 1) * F.col("_size"))
        return F.hypot(gap(lat, "_y") * geo.KM_PER_LAT, gap(lon, "_x") * F.col("_per_lon")) * SLACK

    met = rows.filter(reach("o_lat", "o_lon") + reach("d_lat", "d_lon") <= F.col("_sum"))
    return met.withColumn("cell", F.col("_y") * 1_000_000 + F.col("_x")).drop("_sum", "_lat", "_lon", "_dy", "_per_lon", "_dx", "_size", "_y", "_x")


def least_detour(
    needs: DataFrame, sites: DataFrame, by: Sequence[str], keys: Sequence[str], k: int, chord: Column, order: Sequence[Column], keep: Sequence[str], first_km: float = FIRST_KM
) -> DataFrame:
    """For each need the ``k`` sites of equal keys that come first by ``chord``, then ``order``.

    needs: ``by`` (its name; the ``keys`` are columns too), o_lat, o_lon, d_lat, d_lon, base_km and what
    ``chord`` reads; sites: ``keys``, hub_id, lat, lon and the same. ``chord`` is the detour in km, zero at
    least; ``first_km`` is the margin of the first round. Returns ``by``, ``keep`` of the sites and ``chord_km``. Ends or sites without a place have no answer;
    fewer than ``k`` sites are all returned. Sites repeated for levels and needs already answered are larger in
    memory than their tables' sizes tell, so they are never broadcast.
    """
    placed = sites.filter("lat IS NOT NULL AND lon IS NOT NULL")
    offered = placed.groupBy(*keys).agg(F.count("*").alias("offered"))
    located = needs.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("o_lat", "o_lon", "d_lat", "d_lon", "base_km")))
    left = store(located.join(offered, list(keys)), "needs")
    margin, found = first_km, None
    ranked = Window.partitionBy(*by).orderBy("chord_km", *order)
    while not left.isEmpty():
        celled = ellipses(left, margin)
        levels = [F.lit(r["level"]) for r in celled.select("level").distinct().collect()]  # LEVELS numbers at most
        sited = placed.withColumn("level", F.explode(F.array(*levels)))
        sited = sited.withColumn("cell", _cell(F.col("lat"), F.col("lon"), _size(F.col("level"))))
        met = celled.join(sited.hint("merge"), [*keys, "level", "cell"]).withColumn("chord_km", chord)
        last = margin > LONGEST_KM
        near = met if last else met.filter(F.col("chord_km") <= margin)
        best = near.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= k)
        best = store(best.select(*by, *keep, "chord_km", "offered"), "nearest")
        enough = best.groupBy(*by).agg(F.count("*").alias("n"), F.first("offered").alias("offered"))
        done = enough if last else enough.filter(F.col("n") >= F.least(F.lit(k), F.col("offered")))
        settled = best.join(done.select(*by).hint("merge"), list(by), "left_semi").select(*by, *keep, "chord_km")
        found = settled if found is None else found.unionByName(settled)
        if last:
            break
        left = store(left.join(done.select(*by).hint("merge"), list(by), "left_anti"), "needs")
        margin *= WIDER
    if found is None:
        return left.join(placed.select(*keys, *[c for c in keep if c not in keys], F.lit(0.0).alias("chord_km")), list(keys)).select(*by, *keep, "chord_km")
    return found
