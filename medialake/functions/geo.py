"""Distances, cells and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, with the shorter way round in longitude."""
    dlon = F.abs(lon1 - lon2)
    dlon = F.least(dlon, F.lit(360.0) - dlon)
    return F.hypot((lat1 - lat2) * KM_PER_DEGREE, dlon * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)))


def located(lat: str, lon: str) -> Column:
    """Both coordinates are there and aren't exactly (0, 0)."""
    return F.coalesce(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~((F.col(lat) == 0) & (F.col(lon) == 0)), F.lit(False))


def snapped(degrees: Column, metres: float = 250.0) -> Column:
    step = metres / 1000 / KM_PER_DEGREE
    return F.round(degrees / step).cast("long")


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, below zero in the south and west."""
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W", "O"), -1.0).otherwise(1.0)


def coordinates(text: str) -> Column:
    """struct(lat, lon) from 'lat, lon' in decimals or degrees-minutes-seconds, or a map link; null if out of range."""
    c = F.col(text)
    number = r"([-+]?[0-9]{1,3}(?:\.[0-9]+)?)"
    pair = rf"(?:^|@|[?&](?:q|ll|query)=){number}\s*[,; ]\s*{number}"
    dms = r"([0-9]{1,3})°\s*([0-9]{1,2})['′]\s*([0-9.]+)[\"″]\s*"
    both = dms + r"([NS])[,\s]*" + dms + r"([EWO])"
    part = lambda i: F.nullif(F.regexp_extract(c, both, i), F.lit("")).try_cast("double")
    sign = lambda i: F.regexp_extract(c, both, i)
    lat = F.coalesce(degrees(part(1), part(2), part(3), sign(4)), F.nullif(F.regexp_extract(c, pair, 1), F.lit("")).try_cast("double"))
    lon = F.coalesce(degrees(part(5), part(6), part(7), sign(8)), F.nullif(F.regexp_extract(c, pair, 2), F.lit("")).try_cast("double"))
    return F.when(F.abs(lat) <= 90, F.when(F.abs(lon) <= 180, F.struct(lat.alias("lat"), lon.alias("lon"))))
