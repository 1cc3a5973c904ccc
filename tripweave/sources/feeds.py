"""Feeds: station lists, itineraries, arrivals and brand entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import params
from ..functions import text

# --- stations -------------------------------------------------------------------

STATION_LIST = "stations array<struct<canonical_name:string,station_codes:array<string>,latitude:double,longitude:double>>"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return stations(spark.read.schema(STATION_LIST).json(path, multiLine=True))


def stations(payloads: DataFrame) -> DataFrame:
    """One row per station code; stations with several codes form an interchange."""
    rows = payloads.select(F.explode("stations").alias("s")).select("s.*")
    return rows.select(
        F.posexplode("station_codes").alias("code_no", "code"), F.col("canonical_name").alias("name"), "latitude", "longitude",
        F.when(F.size("station_codes") > 1, F.col("station_codes")[0]).alias("interchange"),
    ).select(
        "code", F.regexp_extract("code", "^([A-Z]+)", 1).alias("line"), F.expr("try_cast(regexp_extract(code, '([0-9]+)$', 1) AS int)").alias("ordinal"),
        "name", "latitude", "longitude", "interchange",
    )


def merge_stations(points: DataFrame, codes: DataFrame) -> DataFrame:
    """Station points joined with their codes on the compact name.

    Points of one name are averaged; a station is a light-rail one only when all of its
    codes are.
    """
    at = points.withColumn("key", text.compact("name")).groupBy("key").agg(
        F.min("name").alias("name"), F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lon"), 7).alias("lon"), F.count("*").alias("n_points")
    )
    listed = codes.withColumn("key", text.compact("name")).groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = at.join(listed, "key", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    light = F.forall("codes", lambda c: c.rlike("^(BP|SE|SW|PE|PW|STC|PTC)"))
    kind = F.when((F.size("codes") > 0) & ~light, "MRT").otherwise("LRT")
    return rows.select("name", F.array_join("codes", ",").alias("codes"), "lat", "lon", "n_points", kind.alias("kind"), (4 + 2 * F.size("codes")).alias("n_aliases"))


def grid_to_degrees(rows: DataFrame, northing: str = "northing", easting: str = "easting") -> DataFrame:
    """National-grid metres to degrees on the WGS84 ellipsoid (inverse transverse Mercator)."""
    import math

    a, f = 6378137.0, 1 / 298.257223563
    e2 = 2 * f - f * f
    lat0, lon0, north0, east0 = math.radians(1.366666), math.radians(103.833333), 38744.572, 28001.642
    c0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    c2 = 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128)
    c4 = 15 / 256 * (e2**2 + 3 * e2**3 / 4)
    c6 = 35 * e2**3 / 3072
    arc0 = a * (c0 * lat0 - c2 * math.sin(2 * lat0) + c4 * math.sin(4 * lat0) - c6 * math.sin(6 * lat0))
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    terms = (3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512)
    ep2 = e2 / (1 - e2)
    rows = rows.withColumn("_mu", (F.lit(arc0) + F.col(northing) - north0) / (a * c0))
    foot = F.col("_mu")
    for i, term in enumerate(terms, 1):
        foot = foot + F.lit(term) * F.sin(F.col("_mu") * (2 * i))
    rows = rows.withColumn("_fp", foot)
    rows = rows.withColumns({"_s": F.sin("_fp"), "_c": F.cos("_fp"), "_t": F.pow(F.tan("_fp"), F.lit(2.0))})
    rows = rows.withColumns({"_w": 1 - e2 * F.col("_s") * F.col("_s"), "_k": ep2 * F.col("_c") * F.col("_c")})
    rows = rows.withColumns({"_n": a / F.sqrt("_w"), "_r": a * (1 - e2) / F.pow("_w", F.lit(1.5))})
    rows = rows.withColumn("_d", (F.col(easting) - east0) / F.col("_n"))
    d, t, k = F.col("_d"), F.col("_t"), F.col("_k")
    lat = F.col("_fp") - F.col("_n") * F.tan("_fp") / F.col("_r") * (
        d * d / 2 - (5 + 3 * t + 10 * k - 4 * k * k - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24
        + (61 + 90 * t + 298 * k + 45 * t * t - 252 * ep2 - 3 * k * k) * F.pow(d, F.lit(6.0)) / 720
    )
    lon = F.lit(lon0) + (
        d - (1 + 2 * t + k) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * k + 28 * t - 3 * k * k + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120
    ) / F.col("_c")
    return rows.withColumns({"lat": F.degrees(lat), "lon": F.degrees(lon)}).drop("_mu", "_fp", "_s", "_c", "_t", "_w", "_k", "_n", "_r", "_d")


# --- itineraries ----------------------------------------------------------------

_PLACE = "struct<name:string,stopCode:string>"
_LEG = (
    f"struct<mode:string,duration:string,distance:string,from:{_PLACE},to:{_PLACE},startTime:string,departureTime:string,endTime:string,arrivalTime:string,"
    "legGeometry:struct<points:string>,routeShortName:string,route:string,routeLongName:string,agencyName:string,intermediateStops:array<struct<name:string>>>"
)
_TRIP = f"struct<duration:string,walkTime:string,walkDistance:string,transfers:string,numTransfers:string,startTime:string,departureTime:string,endTime:string,arrivalTime:string,legs:array<{_LEG}>>"
ITINERARY = f"error string, plan struct<itineraries:array<{_TRIP}>>, data struct<plan:struct<itineraries:array<{_TRIP}>>>"


def number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def instant(*values: Column) -> Column:
    """First given time, epoch milliseconds or seconds or ISO text."""
    raw = F.coalesce(*values)
    n = raw.try_cast("double")
    seconds = F.when(n > 100_000_000_000, n / 1000).otherwise(n)
    return F.when(n >= 0, F.timestamp_seconds(seconds)).otherwise(raw.try_cast("timestamp"))


def itineraries(payloads: DataFrame, key: str, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(routes, rejects) of captured answers: first itinerary, with its fallback cascades."""
    rows = payloads.withColumn("p", F.from_json(column, ITINERARY))
    options = F.coalesce("p.plan.itineraries", "p.data.plan.itineraries")
    rows = rows.withColumn("it", F.when(F.size(options) > 0, options[0])).withColumn("options", options)
    reason = (
        F.when(F.coalesce("p.error", F.lit("")) != "", F.when(F.lower("p.error").rlike("no route|no path"), "no route").otherwise("provider error"))
        .when(F.col("options").isNull(), "no plan").when(F.size("options") == 0, "no route")
    )
    legs = F.coalesce("it.legs", F.expr(f"cast(array() as array<{_LEG}>)"))
    walk = F.filter(legs, lambda g: F.upper(g["mode"]) == "WALK")

    def total(part: Column, field: str, digits: int | None = None) -> Column:
        each = (lambda acc, g: acc + F.round(number(g[field]), digits)) if digits is not None else (lambda acc, g: acc + number(g[field]))
        return F.aggregate(part, F.lit(0.0), each)

    start, end = instant(F.col("it.startTime"), F.col("it.departureTime")), instant(F.col("it.endTime"), F.col("it.arrivalTime"))
    clock = (end.cast("double") - start.cast("double"))
    positive = lambda v: F.when(v > 0, v)
    seconds = F.coalesce(positive(number(F.col("it.duration"))), positive(clock), positive(total(legs, "duration")))
    walking = F.coalesce(positive(number(F.col("it.walkTime"))), total(walk, "duration"))
    metres = F.coalesce(positive(number(F.col("it.walkDistance"))), total(walk, "distance", 1))
    stated = F.coalesce("it.transfers", "it.numTransfers")
    rides = F.size(F.filter(legs, lambda g: ~F.upper(F.coalesce(g["mode"], F.lit("UNKNOWN"))).isin("WALK", "BICYCLE")))
    changes = F.when(stated.isNotNull(), F.greatest(F.lit(0), number(stated).cast("int"))).otherwise(F.greatest(F.lit(0), rides - 1))
    read = rows.withColumn("seconds", seconds).withColumn("reject_reason", F.coalesce(reason, F.when(F.col("seconds").isNull(), "no duration")))
    routes = read.filter("reject_reason IS NULL").select(
        key, F.round(F.col("seconds") / 60, 2).alias("minutes"), F.round(walking / 60, 2).alias("walk_minutes"), F.round(metres, 1).alias("walk_m"),
        changes.alias("transfers"), start.alias("departure"), end.alias("arrival"), F.size(legs).alias("n_legs"),
        F.transform(legs, lambda g: F.struct(F.upper(F.coalesce(g["mode"], F.lit("UNKNOWN"))).alias("mode"), F.round(number(g["duration"]) / 60, 2).alias("minutes"), F.round(number(g["distance"]), 1).alias("metres"), F.coalesce(F.nullif(F.trim(g["routeShortName"]), F.lit("")), F.nullif(F.trim(g["route"]), F.lit(""))).alias("route"))).alias("legs"),
    )
    return routes, read.filter("reject_reason IS NOT NULL").select(key, "reject_reason")


# --- arrivals -------------------------------------------------------------------

_BUS = "struct<EstimatedArrival:string,Monitored:string,Load:string,Feature:string,Type:string>"
ARRIVALS = f"BusStopCode string, Services array<struct<ServiceNo:string,Operator:string,NextBus:{_BUS},NextBus2:{_BUS},NextBus3:{_BUS}>>"


def arrivals(payloads: DataFrame, spark: SparkSession, column: str = "payload") -> DataFrame:
    """One row per stop, service and filled slot."""
    rows = payloads.select(F.from_json(column, ARRIVALS).alias("p")).select(F.col("p.BusStopCode").alias("stop_code"), F.explode("p.Services").alias("s"))
    slots = rows.select("stop_code", "s.ServiceNo", "s.Operator", F.posexplode(F.array("s.NextBus", "s.NextBus2", "s.NextBus3")).alias("at", "b"))
    names = params.small_table(spark, params.BUS_OPERATORS, "operator_code, operator_name")
    due = F.nullif(F.trim("b.EstimatedArrival"), F.lit("")).try_cast("timestamp")
    load = F.upper(F.trim("b.Load"))
    out = slots.select(
        "stop_code", F.trim("ServiceNo").alias("service_no"), F.upper("Operator").alias("operator_code"), "Operator", (F.col("at") + 1).alias("slot"), due.alias("due"),
        (F.trim("b.Monitored") == "1").alias("live"), F.when(load.isin("SEA", "SDA", "LSD"), load).alias("load"),
        (F.upper(F.trim(F.coalesce("b.Feature", F.lit("")))) == "WAB").alias("accessible"), F.nullif(F.upper(F.trim("b.Type")), F.lit("")).alias("vehicle"),
    ).filter("due IS NOT NULL")
    return out.join(names, "operator_code", "left").withColumn("operator", F.coalesce("operator_name", "Operator")).drop("operator_code", "operator_name")


# --- brand entities ---------------------------------------------------------------

_CLAIM = "struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>"
ENTITIES = f"entities map<string,struct<claims:map<string,array<{_CLAIM}>>,labels:map<string,struct<value:string>>>>"
LOGO_CLAIMS = ("P154", "P8972")
FILE_BASE = "https://upload.wikimedia.org/wikipedia/commons"


def brand_entities(payloads: DataFrame, key: str = "brand_key", column: str = "payload") -> DataFrame:
    """Answered entities: ``logo`` null means the entity was read and has none; unreadable answers are left out."""
    rows = payloads.withColumn("e", F.from_json(column, ENTITIES)["entities"])
    own = F.try_element_at("e", F.col(key))
    single = F.when(F.size("e") == 1, F.map_values("e")[0])
    rows = rows.withColumn("entity", F.coalesce(own, single)).filter("entity IS NOT NULL AND entity.claims IS NOT NULL")

    def value(claim: str) -> Column:
        kept = F.filter(
            F.try_element_at("entity.claims", F.lit(claim)),
            lambda c: (F.coalesce(c["rank"], F.lit("")) != "deprecated") & (c["mainsnak"]["snaktype"] == "value") & (F.trim(F.coalesce(c["mainsnak"]["datavalue"]["value"], F.lit(""))) != ""),
        )
        first = F.trim(F.try_element_at(kept, F.lit(1))["mainsnak"]["datavalue"]["value"])
        return F.when(F.lower(first).rlike(r"\.(svg|png|jpg|jpeg|gif|webp)$"), first)

    name = F.coalesce(*[value(c) for c in LOGO_CLAIMS])
    rows = rows.withColumn("file_name", name).withColumn("_u", F.replace("file_name", F.lit(" "), F.lit("_")))
    shard = F.md5("_u")
    url = F.concat_ws("/", F.lit(FILE_BASE), F.substring(shard, 1, 1), F.substring(shard, 1, 2), F.url_encode("_u"))
    label = F.trim(F.try_element_at("entity.labels", F.lit("en"))["value"])
    return rows.select(key, F.nullif(label, F.lit("")).alias("brand_label"), "file_name", F.when(F.col("file_name").isNotNull(), url).alias("url"))
