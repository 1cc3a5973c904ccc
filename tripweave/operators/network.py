"""The rail network: edges, all-pairs times, rides and the price of any two places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import geo
from . import spatial


def rail_edges(stations: DataFrame) -> DataFrame:
    """Neighbours along each line plus walks between stations of one interchange, both ways.

    ``interchange`` names the group a station belongs to; null is none.
    """
    along = Window.partitionBy("line").orderBy("ordinal")
    after = stations.select(
        F.col("station_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
        F.lead("station_id").over(along).alias("b"), F.lead("lat").over(along).alias("b_lat"),
        F.lead("lon").over(along).alias("b_lon"),
    ).filter("b IS NOT NULL")
    minutes = (
        geo.haversine_km("a_lat", "a_lon", "b_lat", "b_lon") * params.TRACK_FACTOR / params.RAIL_KMH * 60
        + params.STOP_DWELL_MIN
    )
    rides = after.select("a", "b", minutes.alias("minutes"), F.lit(False).alias("is_transfer"))
    hubs = stations.filter("interchange IS NOT NULL").select("interchange", "station_id")
    walks = (
        hubs.withColumnRenamed("station_id", "a")
        .join(hubs.withColumnRenamed("station_id", "b"), "interchange")
        .filter("a < b")
        .select("a", "b", F.lit(params.TRANSFER_MIN).alias("minutes"), F.lit(True).alias("is_transfer"))
    )
    one_way = rides.unionByName(walks)
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "minutes", "is_transfer"))


def station_matrix(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Least minutes and the station path between all pairs.

    Path doubling: each round joins the matrix with itself, so paths of twice as many
    hops are found; it stops when a round changes nothing. The network is bounded by
    the city, and each round's lineage is cut by a reliable checkpoint.
    """
    start = stations.select(
        F.col("station_id").alias("s"), F.col("station_id").alias("t"), F.lit(0.0).alias("minutes"),
        F.array("station_id").alias("path"),
    )
    direct = edges.select(F.col("a").alias("s"), F.col("b").alias("t"), "minutes", F.array("a", "b").alias("path"))

    def least(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct(F.round("minutes", 9).alias("key"), F.size("path").alias("hops"), F.col("path").alias("path"), F.col("minutes").alias("m"))).alias("x")
        return rows.groupBy("s", "t").agg(best).select("s", "t", F.col("x.m").alias("minutes"), F.col("x.path").alias("path"))

    current = least(start.unionByName(direct)).checkpoint(eager=True)
    seen = None
    while True:
        mark = tuple(current.agg(F.count("*"), F.round(F.sum("minutes"), 6)).first())
        if mark == seen:
            return current
        seen = mark
        second = current.select(F.col("s").alias("m"), "t", F.col("minutes").alias("more"), F.col("path").alias("rest"))
        longer = current.withColumnRenamed("t", "m").join(second, "m").select(
            "s", "t", (F.col("minutes") + F.col("more")).alias("minutes"),
            F.concat("path", F.slice("rest", F.lit(2), F.size("rest"))).alias("path"),
        )
        current = least(longer).checkpoint(eager=True)


def rides(matrix: DataFrame, edges: DataFrame, stations: DataFrame) -> DataFrame:
    """The trains boarded on each station path.

    A walk between interchange codes ends a ride, and so does a change of service; a
    station whose service is null belongs to any line and never decides it.
    """
    hops = matrix.select("s", "t", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "a"), "path").withColumn(
        "b", F.element_at("path", F.col("i") + 2)
    )
    names = stations.select("station_id", "line")
    rows = (
        hops.join(edges, ["a", "b"])
        .join(names.select(F.col("station_id").alias("a"), F.col("line").alias("a_line")), "a")
        .join(names.select(F.col("station_id").alias("b"), F.col("line").alias("b_line")), "b")
    )
    path = Window.partitionBy("s", "t").orderBy("i")
    part = Window.partitionBy("s", "t", "part").orderBy("i")
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.sum(F.col("is_transfer").cast("int")).over(path)).filter("NOT is_transfer")
    rows = rows.withColumn("known", F.coalesce("b_line", F.when(F.row_number().over(part) == 1, F.col("a_line"))))
    rows = rows.withColumn("held", F.last("known", ignorenulls=True).over(before))
    change = (F.col("b_line") != F.col("held")) | (F.row_number().over(part) == 1)
    rows = rows.withColumn("ride", F.sum(F.coalesce(change, F.lit(False)).cast("int")).over(path))
    return rows.groupBy("s", "t", "ride").agg(
        F.max("known").alias("service"), F.sum("minutes").alias("minutes"), F.count("*").alias("stops"),
        F.min_by("a", "i").alias("first_station"), F.max_by("b", "i").alias("last_station"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda p: p["b"]).alias("onward"),
    )


def pair_plans(matrix: DataFrame, ride_rows: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per station pair: what is ridden between them, and where it runs."""
    spots = stations.select("station_id", "lat", "lon")
    line = ride_rows.select("s", "t", "ride", F.posexplode("onward").alias("j", "station_id")).join(spots, "station_id")
    points = line.groupBy("s", "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ride", "j", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("onward")
    )
    ends = ride_rows.groupBy("s", "t").agg(
        F.min_by("first_station", "ride").alias("first_station"), F.max_by("last_station", "ride").alias("last_station"),
        F.sum("minutes").alias("ride_minutes"), F.count("*").alias("n_rides"),
    )
    first = spots.select(F.col("station_id").alias("first_station"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    last = spots.select(F.col("station_id").alias("last_station"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    plans = ends.join(first, "first_station").join(last, "last_station").join(points, ["s", "t"])
    return matrix.select("s", "t", F.col("minutes").alias("matrix_minutes")).join(
        plans.withColumn("line", F.concat(F.array(F.struct(F.col("f_lat").alias("lat"), F.col("f_lon").alias("lon"))), "onward")).drop("onward"),
        ["s", "t"], "left",
    )


def access(km: Column) -> tuple[Column, Column]:
    """(minutes, is a feeder bus) of reaching a station over ``km``."""
    km = F.greatest(km, F.lit(params.PLATFORM_KM))
    bus = km > params.MAX_WALK_KM
    walk = km * 1000 * params.WALK_DETOUR / params.WALK_M_PER_MIN
    return F.when(bus, 4.0 + km * 1.3 / params.BUS_KMH * 60).otherwise(walk), bus


def place_stations(places: DataFrame, stations: DataFrame) -> DataFrame:
    """Boarding choices of every distinct coordinate: station and access minutes."""
    sites = stations.select(
        F.col("station_id").alias("site_id"), "name", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")
    )
    near = spatial.k_nearest(places, sites, params.NEAREST_STATIONS)
    return near.select(
        geo.place_key("lat", "lon").alias("place"), "lat", "lon",
        F.transform("near", lambda s: F.struct(s["site_id"].alias("station_id"), access(s["km"])[0].alias("minutes"))).alias("choices"),
    )


def price(pairs: DataFrame, choices: DataFrame, plans: DataFrame) -> DataFrame:
    """Price distinct (from_place, to_place) pairs.

    Every boarding and alighting choice meets the station matrix by an equi-join; the
    sixteen combinations of a pair sit in one task and collapse before any shuffle.
    """
    board = choices.select(
        F.col("place").alias("from_place"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.col("choices").alias("boards")
    )
    alight = choices.select(
        F.col("place").alias("to_place"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.col("choices").alias("alights")
    )
    times = plans.select("s", "t", "matrix_minutes")
    ends = pairs.join(board, "from_place").join(alight, "to_place")
    here = ["from_place", "to_place", "from_lat", "from_lon", "to_lat", "to_lon"]
    combos = (
        ends.select(*here, F.explode("boards").alias("x"), "alights")
        .select(*here, F.col("x.station_id").alias("s"), F.col("x.minutes").alias("on"), F.explode("alights").alias("y"))
        .select(*here, "s", "on", F.col("y.station_id").alias("t"), F.col("y.minutes").alias("off"))
        .join(times, ["s", "t"])
    )
    total = F.round(F.col("on") + params.FIRST_WAIT_MIN + F.col("matrix_minutes") + F.col("off"), 9)
    chosen = combos.groupBy("from_place", "to_place").agg(
        *[F.first(c).alias(c) for c in here[2:]], F.min(F.struct(total.alias("total"), "s", "t")).alias("pick")
    )
    rows = chosen.select(*here, F.col("pick.s").alias("s"), F.col("pick.t").alias("t")).join(plans, ["s", "t"])
    return priced(rows)


def priced(rows: DataFrame) -> DataFrame:
    """Minutes, walking and transfers of each pair from its station plan."""
    direct = geo.haversine_km("from_lat", "from_lon", "to_lat", "to_lon")
    walk_only = (direct <= params.WALK_ONLY_KM) | F.col("n_rides").isNull()
    rows = rows.withColumn("direct_km", direct).withColumn("walk_only", walk_only)
    on_km = F.greatest(F.lit(params.PLATFORM_KM), geo.haversine_km("from_lat", "from_lon", "f_lat", "f_lon"))
    off_km = F.greatest(F.lit(params.PLATFORM_KM), geo.haversine_km("l_lat", "l_lon", "to_lat", "to_lon"))
    rows = rows.withColumn("on_km", on_km).withColumn("off_km", off_km)
    on_min, on_bus = access(F.col("on_km"))
    off_min, off_bus = access(F.col("off_km"))
    metres = F.greatest(F.col("direct_km") * 1000 * params.WALK_DETOUR, F.lit(1.0))
    street = 1000 * params.WALK_DETOUR
    ride = (
        on_min + params.FIRST_WAIT_MIN + F.col("ride_minutes") + params.TRANSFER_MIN * (F.col("n_rides") - 1)
        + F.when(off_bus, params.FIRST_WAIT_MIN).otherwise(0.0) + off_min
    )
    walked = F.when(on_bus, 0.0).otherwise(F.round(on_min, 2)) + F.when(off_bus, 0.0).otherwise(F.round(off_min, 2))
    walked_m = F.when(on_bus, 0.0).otherwise(F.round(F.col("on_km") * street, 1)) + F.when(off_bus, 0.0).otherwise(
        F.round(F.col("off_km") * street, 1)
    )
    changes = F.col("n_rides") - 1 + on_bus.cast("int") + off_bus.cast("int")
    alone = F.col("walk_only")
    return rows.select(
        "from_place", "to_place", "from_lat", "from_lon", "to_lat", "to_lon", "walk_only",
        F.when(~alone, F.col("s")).alias("s"), F.when(~alone, F.col("t")).alias("t"),
        F.round(F.when(alone, metres / params.WALK_M_PER_MIN).otherwise(ride), 2).alias("minutes"),
        F.round(F.when(alone, metres / params.WALK_M_PER_MIN).otherwise(walked), 2).alias("walk_minutes"),
        F.round(F.when(alone, metres).otherwise(walked_m), 1).alias("walk_m"),
        F.when(alone, F.lit(0)).otherwise(changes).cast("bigint").alias("transfers"),
        F.when(~alone, F.col("first_station")).alias("first_station"),
        F.when(~alone, F.col("last_station")).alias("last_station"),
    )
