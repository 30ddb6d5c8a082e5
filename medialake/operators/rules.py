"""Rules as predicates: field, operator and value become a Column, combined by all or any."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import wall_time

# File name endings of videos, and how screenshots are named.
VIDEO_EXTENSIONS = ("mp4", "m4v", "mov", "qt", "mkv", "webm", "avi", "3gp", "3g2", "mts", "m2ts", "mpg", "mpeg", "wmv", "ogv", "flv")
SCREENSHOT_PREFIXES = ("screenshot", "screen shot", "captura de pantalla", "screencapture")

#: Field -> kind: text, number, flag, given (not null), date, media.
FIELDS = {
    "name": "text", "filename": "text", "folder": "text", "path": "text", "title": "text", "caption": "text", "keywords": "text", "camera_make": "text", "camera_model": "text", "lens": "text", "ext": "text", "place_name": "text",
    "rating": "number", "bytes": "number", "width": "number", "height": "number", "iso": "number", "f_number": "number", "focal_length": "number", "duration": "number",
    "favorite": "flag", "hidden": "flag", "edited": "flag", "edit_version": "flag", "has_location": "given", "gps_lat": "given", "taken_at": "date", "added_at": "date", "media_type": "media", "media": "media",
}
#: Fields whose column has another name.
COLUMNS = {"name": "filename", "folder": "path", "edited": "edit_version", "has_location": "gps_lat"}
#: How stored rules spell operators -> as below.
SPELLED = {"is not": "is_not", "does not contain": "without", "greater than": ">", "less than": "<", "is true": "yes", "is false": "no", "in the last days": "last_days"}
DAY = 86_400


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: object = None


def is_video(ext: str = "ext") -> Column:
    return F.coalesce(F.lower(F.col(ext)).isin(*VIDEO_EXTENSIONS), F.lit(False))


def is_screenshot(name: str = "filename") -> Column:
    lower = F.lower(F.coalesce(F.col(name), F.lit("")))
    return reduce(lambda a, b: a | b, (F.startswith(lower, F.lit(p)) for p in SCREENSHOT_PREFIXES))


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _moment(value: object) -> float | None:
    """Epoch seconds of a number or of an ISO date or time (UTC, if it names no zone)."""
    if isinstance(value, (int, float)):
        return float(value)
    try:
        at = datetime.fromisoformat(str(value))
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


def stored(text: str | None) -> list[Rule]:
    """The rules of a saved smart album: a JSON list of objects with field, op and value; none if it can't be read."""
    try:
        rows = json.loads(text or "[]")
    except ValueError:
        return []
    return [Rule(str(r.get("field", "")), str(r.get("op", "")), r.get("value")) for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def condition(rule: Rule, as_of: float, columns: dict[str, str] | None = None) -> Column | None:
    """The predicate of a rule, None if its field, operator or value isn't known. as_of: now, in epoch seconds.

    Operators are named as here or as stored rules spell them. Text ignores case and takes a null for '';
    % and _ in a text are wildcards; a null number is -1 for 'is_not' alone, and fails the others; dates
    are epoch seconds or ISO texts; of media, all that isn't 'is video' asks for pictures.
    """
    kind, name = FIELDS.get(rule.field), (columns or {}).get(rule.field, COLUMNS.get(rule.field, rule.field))
    c, op = F.col(name), SPELLED.get(rule.op, rule.op)
    if kind == "text":
        text, value = F.lower(F.coalesce(c, F.lit(""))), str(rule.value or "").lower()
        return {"is": text == value, "is_not": text != value, "contains": text.like(f"%{value}%"), "without": ~text.like(f"%{value}%")}.get(op)
    if kind == "number":
        value = _number(rule.value)
        if value is None:
            return None
        return {"is": c == value, "is_not": F.coalesce(c, F.lit(-1)) != value, ">": c > value, "<": c < value}.get(op)
    if kind == "flag":
        return {"yes": F.coalesce(c, F.lit(0)) > 0, "no": F.coalesce(c, F.lit(0)) == 0}.get(op)
    if kind == "given":
        return {"yes": c.isNotNull(), "no": c.isNull()}.get(op)
    if kind == "date":
        value = _number(rule.value) if op == "last_days" else _moment(rule.value)
        if value is None:
            return None
        return {"last_days": c >= as_of - value * DAY, "after": c > value, "before": c < value}.get(op)
    if kind == "media":
        return is_video() if op == "is video" or (op == "is" and rule.value == "video") else ~is_video()
    return None


def combined(rules: list[Rule], match: str, as_of: float) -> Column:
    """All rules, or any; rules that aren't known don't count, and none at all lets everything pass."""
    found = [c for r in rules if (c := condition(r, as_of)) is not None]
    if not found:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if match == "any" else (lambda a, b: a & b), found)


def live_count(photos: DataFrame, rules: list[Rule], match: str, as_of: float) -> DataFrame:
    """One row, items: how many photos rules find while they are edited; not trashed and not hidden, moving halves count."""
    live = F.col("trashed_at").isNull() & (F.coalesce(F.col("hidden"), F.lit(0)) == 0)
    return photos.where(live & combined(rules, match, as_of)).agg(F.count("*").alias("items"))


# Search terms that need no parsing: each is a predicate to combine by &.


def taken_between(first: float | None, last: float | None, c: str = "taken_at") -> Column:
    """From first on, before last; None is open."""
    out = F.col(c).isNotNull()
    out = out & (F.col(c) >= first) if first is not None else out
    return out & (F.col(c) < last) if last is not None else out


def taken_in_month(month: int, zone: str = "UTC", c: str = "taken_at") -> Column:
    return F.month(wall_time(F.col(c), zone)) == month


def shape(kind: str) -> Column:
    """vertical, horizontal, square (sides within 5 %) or 4k (a video whose longer side has 3840 dots)."""
    w, h = F.col("width"), F.col("height")
    near = F.abs(w - h) <= 0.05 * F.greatest(w, h)
    longer = F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))
    return {"square": near, "vertical": (h > w) & ~near, "horizontal": (w > h) & ~near, "4k": is_video() & (longer >= 3840)}[kind]
