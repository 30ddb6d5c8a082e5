"""Events: sessions of pictures, their description, trips, and edits that freeze them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import wall_time
from .rules import is_video

GAP_S = 6 * 3600
MOVE_GAP_S = 90 * 60
LEAST_ITEMS = 5
END_SLACK_S = 0.001


def sessions(rows: DataFrame, key: str, gap: float = GAP_S, move_gap: float = MOVE_GAP_S) -> DataFrame:
    """Adds ``session``, counted from 1 within a key, of (key, id, taken_at, city) rows.

    A session ends at a gap of more than ``gap``, or of more than ``move_gap`` if the city is another
    than the last known one; rows without a city carry the last one on. Rows without a time take no
    part. One key's rows are sorted in one task: the key should split the data (a user, a library).
    """
    order = Window.partitionBy(key).orderBy("taken_at", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pause = F.col("taken_at") - F.lag("taken_at").over(order)
    last_city = F.last("city", ignorenulls=True).over(before)
    moved = F.col("city").isNotNull() & last_city.isNotNull() & (F.col("city") != last_city)
    new = F.when(pause.isNull() | (pause > gap) | ((pause > move_gap) & moved), 1).otherwise(0)
    marked = rows.where(F.col("taken_at").isNotNull()).withColumn("__new", new)
    return marked.withColumn("session", F.sum("__new").over(order)).drop("__new")


def outside(rows: DataFrame, spans: DataFrame, key: str, day: float = 86_400.0) -> DataFrame:
    """Rows that no hand-made span (key, start_at, end_at) of their key covers, ends included."""
    hit = in_spans(rows, spans.withColumn("__span", F.monotonically_increasing_id()), key, "__span", day).select("id").distinct()
    return rows.join(hit, "id", "left_anti")


def in_spans(rows: DataFrame, spans: DataFrame, key: str, span_id: str, day: float = 86_400.0) -> DataFrame:
    """(id, span_id) of rows within a span of the same key: start <= taken_at < end + 1 ms.

    Spans are given to the days that they touch and joined by key and day.
    """
    first, last = F.floor(F.col("start_at") / day).cast("long"), F.floor((F.col("end_at") + END_SLACK_S) / day).cast("long")
    by_day = spans.select(key, span_id, "start_at", "end_at", F.explode(F.sequence(first, last)).alias("__day"))
    dated = rows.select(key, "id", "taken_at", F.floor(F.col("taken_at") / day).cast("long").alias("__day"))
    inside = (F.col("taken_at") >= F.col("start_at")) & (F.col("taken_at") < F.col("end_at") + END_SLACK_S)
    return dated.join(by_day, [key, "__day"]).where(inside).select("id", span_id)


def described(rows: DataFrame, key: str, least: int = LEAST_ITEMS) -> DataFrame:
    """key, session, start_at, end_at, items, videos, cover_id and city of sessions of at least ``least`` rows.

    rows: with session, ext, favorite, rating, bytes, city. The cover is the best still: favourite,
    rating, bytes, least id; the city is the one most rows have, then the first by name.
    """
    still = ~is_video()
    cover = F.max(F.when(still, F.struct(F.coalesce("favorite", F.lit(0)), F.coalesce("rating", F.lit(0)), F.coalesce("bytes", F.lit(0)), (-F.col("id")).alias("neg"))))
    sums = rows.groupBy(key, "session").agg(F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), F.count("*").alias("items"), F.count_if(is_video()).alias("videos"), cover.alias("cover")).where(F.col("items") >= least)
    return sums.join(modal(rows, [key, "session"], "city"), [key, "session"], "left").select(key, "session", "start_at", "end_at", "items", "videos", (-F.col("cover.neg")).alias("cover_id"), "city")


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties to the least one."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("__m")).select(*by, F.col("__m.v").alias(value))


def trips(events: DataFrame, home: DataFrame, key: str, days: float = 2.0) -> DataFrame:
    """Runs of more than one event away from home in the same place, at most ``days`` apart.

    events: key, session, start_at, end_at, city; home: key, home. An event at home, or without a
    place, ends a run. Returns key, trip, city, start_at, end_at, events.
    """
    order = Window.partitionBy(key).orderBy("start_at", "session")
    joined = events.join(home, key, "left").withColumn("away", F.col("city").isNotNull() & ~F.col("city").eqNullSafe(F.col("home")))
    near = F.lag("away").over(order) & (F.lag("city").over(order) == F.col("city")) & (F.col("start_at") - F.lag("end_at").over(order) <= days * 86_400)
    runs = joined.withColumn("__new", F.when(F.col("away") & F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("trip", F.sum("__new").over(order))
    return runs.where("away").groupBy(key, "trip").agg(F.first("city").alias("city"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.count("*").alias("events")).where("events > 1")


def event_name(start: Column, end: Column, place: Column, zone: str = "UTC") -> Column:
    """What an event is called: a holiday, or the place and the day (several days: the month), or the days.

    Christmas: it starts in 22 to 26 December, or ends there after three days at most. New Year: it starts
    on 31 December or 1 January, and is called by the year it starts in. An empty place is none.
    """
    a, b = wall_time(start, zone), wall_time(end, zone)
    days = F.datediff(F.to_date(b), F.to_date(a))
    at_christmas = lambda t: (F.month(t) == 12) & F.dayofmonth(t).between(22, 26)
    christmas = at_christmas(a) | (at_christmas(b) & (days <= 3))
    new_year = ((F.month(a) == 12) & (F.dayofmonth(a) == 31)) | ((F.month(a) == 1) & (F.dayofmonth(a) == 1))
    there = F.coalesce(place, F.lit("")) != ""
    say = F.date_format
    return (
        F.when(christmas | new_year, F.concat(F.when(christmas, "Christmas ").otherwise("New Year "), F.year(a).cast("string")))
        .when(there, F.concat(place, F.lit(" · "), F.when(days == 0, say(a, "d MMMM yyyy")).otherwise(say(a, "MMMM yyyy"))))
        .when(days == 0, say(a, "EEEE, d MMMM yyyy"))
        .when(say(a, "yyyy-MM") == say(b, "yyyy-MM"), F.concat(say(a, "d"), F.lit("–"), say(b, "d"), say(a, " MMMM yyyy")))
        .otherwise(F.concat(say(a, "d MMMM"), F.lit(" – "), say(b, "d MMMM yyyy")))
    )


def joined_events(events: DataFrame, ids: list[int]) -> DataFrame:
    """The given events as one, frozen; the others as they are."""
    some = F.col("id").isin(*ids)
    one = events.where(some).agg(F.min("id").alias("id"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("items").alias("items"), F.min_by("place", F.struct("start_at", "id")).alias("place"), F.lit(1).alias("custom"))
    return events.where(~some).unionByName(one.where(F.col("id").isNotNull()))


def split_event(events: DataFrame, event: int, at: float, new_id: int) -> DataFrame:
    """An event cut in two before ``at``, both frozen; the caller counts the items anew."""
    hit = (F.col("id") == event) & (F.col("start_at") < at) & (F.col("end_at") >= at)
    left = events.withColumns({"end_at": F.when(hit, F.lit(at - END_SLACK_S)).otherwise(F.col("end_at")), "custom": F.when(hit, 1).otherwise(F.col("custom"))})
    right = events.where(hit).withColumns({"id": F.lit(new_id).cast("long"), "start_at": F.lit(at), "custom": F.lit(1)})
    return left.unionByName(right)
