"""Geometry as column expressions: everything stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_LAT, KM_PER_LON = 110.57, 111.32


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = col(lat1), col(lon1), col(lat2), col(lon2)
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(half), F.sqrt(1 - half))


def unit_vector(lat, lon) -> Column:
    """A coordinate as a point on the unit sphere: trigonometry once per place."""
    lat, lon = F.radians(col(lat)), F.radians(col(lon))
    return F.struct(
        (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")
    )


def between_units(a, b) -> Column:
    """Great-circle km between two unit vectors; no trigonometry but one arc sine."""
    a, b = col(a), col(b)
    dx, dy, dz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy + dz * dz) / 2))


def local_metres(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular metres; right for a few hundred metres."""
    lat1, lon1, lat2, lon2 = col(lat1), col(lon1), col(lat2), col(lon2)
    dy = (lat1 - lat2) * 110570.0
    dx = (lon1 - lon2) * F.lit(111320.0) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dy * dy + dx * dx)


def segment_km(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Distance from a point to a segment in a plane scaled at their mean latitude."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(col, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    scale = F.cos(F.radians((a_lat + b_lat + lat) / 3)) * KM_PER_LON
    px, py = (lon - a_lon) * scale, (lat - a_lat) * KM_PER_LAT
    dx, dy = (b_lon - a_lon) * scale, (b_lat - a_lat) * KM_PER_LAT
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length))).otherwise(0.0)
    ex, ey = px - along * dx, py - along * dy
    return F.sqrt(ex * ex + ey * ey)


def with_segment_km(frame, name: str, a: tuple[str, str], b: tuple[str, str], point: tuple[str, str] = ("lat", "lon")):
    """Add the distance to a segment step by step.

    Written as one expression the shared terms would be expanded dozens of times; as
    columns of their own each is computed once and the generated method stays small.
    """
    lat, lon = F.col(point[0]), F.col(point[1])
    return (
        frame.withColumn("_w", F.cos(F.radians((F.col(a[0]) + F.col(b[0]) + lat) / 3)) * KM_PER_LON)
        .withColumns({
            "_px": (lon - F.col(a[1])) * F.col("_w"), "_py": (lat - F.col(a[0])) * KM_PER_LAT,
            "_dx": (F.col(b[1]) - F.col(a[1])) * F.col("_w"), "_dy": (F.col(b[0]) - F.col(a[0])) * KM_PER_LAT,
        })
        .withColumn("_n", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
        .withColumn("_t", F.expr("CASE WHEN _n > 0 THEN greatest(0e0, least(1e0, (_px * _dx + _py * _dy) / _n)) ELSE 0e0 END"))
        .withColumn(name, F.expr("hypot(_px - _t * _dx, _py - _t * _dy)"))
        .drop("_w", "_px", "_py", "_dx", "_dy", "_n", "_t")
    )


def place_key(lat, lon) -> Column:
    """A coordinate rounded to six decimals, packed into one BIGINT join key."""
    return F.round(col(lat) * 1e6).cast("bigint") * F.lit(1_000_000_000) + F.round(col(lon) * 1e6).cast("bigint")


def cell(value, size: float) -> Column:
    return F.floor(col(value) / size).cast("bigint")


def cells_between(low, high, size: float) -> Column:
    """Array of cell numbers touched by an interval."""
    return F.sequence(cell(low, size), cell(high, size))


def lat_margin(km: float) -> float:
    return km / KM_PER_LAT * 1.01


def lon_margin(km: float, widest_lat: float = 2.0) -> float:
    """Degrees of longitude that cover ``km`` at every latitude of the city."""
    import math

    return km / (KM_PER_LON * math.cos(math.radians(widest_lat))) * 1.02
