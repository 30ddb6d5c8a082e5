"""Instants in epoch seconds as wall time, and dates read from names and folders. Time zones are explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_time(seconds: Column, zone: str = "UTC") -> Column:
    """A timestamp without zone: the clock in ``zone``, whatever the session's zone."""
    utc = F.timestamp_add("SECOND", F.floor(seconds).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def epoch(time: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def period(seconds: Column, unit: str, zone: str = "UTC") -> Column:
    """'2024' or '2024-03' or '2024-03-09'."""
    return F.date_format(wall_time(seconds, zone), {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])


def weekday(seconds: Column, zone: str = "UTC") -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(wall_time(seconds, zone)) - 1


def date_from_name(name: str, last_year: int) -> Column:
    """The first valid yyyymmdd, yyyy-mm-dd or yyyy_mm_dd in a name, from 1990 to last_year; else null."""
    found = F.regexp_extract_all(F.col(name), F.lit(r"((?:19|20)[0-9]{2}[-_.]?[0-9]{2}[-_.]?[0-9]{2})"), 1)
    dates = F.transform(F.transform(found, lambda s: F.regexp_replace(s, "[-_.]", "")), lambda s: F.try_to_date(s, "yyyyMMdd"))
    return F.get(F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(1990, last_year)), F.lit(0))


def date_from_folders(path: str, depth: int = 3) -> Column:
    """The date of the nearest of ``depth`` parent folders that is named yyyy-mm-dd, else null."""
    parents = F.reverse(F.slice(F.reverse(F.split(F.col(path), "/")), 2, depth))
    dates = F.transform(F.reverse(parents), lambda s: F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd")))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


# How cameras and videos write their dates.
CAMERA_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd")


def camera_time(text: Column, subsecond: Column | None = None) -> Column:
    """Epoch seconds of a camera's date (its clock taken as UTC), with a fraction if its digits are given; else null."""
    raw = F.substring(F.trim(F.regexp_replace(text, "\u0000+$", "")), 1, 19)
    at = F.coalesce(*(F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(f))) for f, shape in zip(CAMERA_FORMATS, (r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}:\d\d:\d\d$"))))
    seconds = epoch(at.cast("timestamp_ntz")).cast("double")
    if subsecond is None:
        return seconds
    part = F.when(F.trim(subsecond).rlike("^[0-9]+$"), F.concat(F.lit("0."), F.trim(subsecond)).cast("double"))
    return seconds + F.coalesce(part, F.lit(0.0))


def container_time(text: Column) -> Column:
    """Epoch seconds of an ISO date of a video, with or without a fraction and a zone (none: UTC); else null."""
    t = F.trim(text)
    shape = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$")
    sign = F.when(F.regexp_extract(t, r"([+-])\d\d:?\d\d$", 1) == "-", -1).otherwise(1)
    zone = F.regexp_extract(t, r":\d\d(?:\.\d+)?([+-]\d\d:?\d\d)$", 1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hour, minute = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    offset = sign * (F.coalesce(hour, F.lit(0)) * 3600 + F.coalesce(minute, F.lit(0)) * 60)
    fraction = F.coalesce(F.concat(F.lit("0"), F.regexp_extract(t, r"(\.\d+)", 1)).try_cast("double"), F.lit(0.0))
    at = F.try_to_timestamp(F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(shape, epoch(at.cast("timestamp_ntz")).cast("double") + fraction - offset)


def day_title(day: Column, today: Column) -> Column:
    """Today, Yesterday, the weekday within a week, else the long date."""
    ago = F.datediff(today, day)
    return F.when(ago == 0, "Today").when(ago == 1, "Yesterday").when(ago.between(2, 6), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "d MMMM yyyy"))
