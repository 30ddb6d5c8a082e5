"""Document fingerprints of closed syncmers, in DataFrame functions only.

The letters of the k-mers are words (characters, in scripts written without spaces). A run of K words
is chosen if the least hash among its inner runs of S words lies at its first or last place. Whether
a run is chosen depends on its own words alone, so an edit changes only the anchors that touch it.
Two texts are matched by anchors and by their positions: an anchor that both hold counts, and so does a
pair of neighbouring anchors that stand at the same distance in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

K = 6
S = 2
INNER = K - S + 1
ROWS_PER_SLICE = 20_000
#: Slices of the doc_id order; beyond it they hold more rows, and sort with spilling.
MOST_SLICES = 4096
WORD_END = r"\s+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}])"


def with_syncmers(df: DataFrame, text: str, anchors: str, places: str) -> DataFrame:
    """Adds the anchors of a text column (64-bit hashes, array<long>) and their word positions.

    A text of fewer than K words has one anchor, the hash of all of them; one of more words of which no
    run is chosen (of up to K + K - S - 2 words) has its run of least hash; one without words has none.
    """
    words = F.filter(F.split(F.col(text), WORD_END), lambda w: w != "")
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__h")
    df = df.withColumn("__s", F.transform(F.slice("__h", 1, F.greatest(n - S + 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("__h", i + 1))))
    df = df.withColumn("__m", F.transform("__s", lambda x, i: F.least(x, F.get("__s", i + 1))))
    df = df.withColumn("__m", F.transform("__m", lambda x, i: F.least(x, F.get("__m", i + 2))))

    def chosen(i: Column) -> Column:
        first, last = F.get("__s", i), F.get("__s", i + INNER - 1)
        least = F.least(F.get("__m", i), last)
        return (first == least) | (last == least)

    runs = F.filter(F.sequence(F.lit(0), n - K), chosen)
    df = df.withColumn("__r", F.when(n >= K, runs).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    least = F.array_min(F.transform(F.sequence(F.lit(0), n - K), lambda i: F.struct(F.xxhash64(F.slice("__h", i + 1, K)).alias("hash"), i.alias("place"))))["place"]
    df = df.withColumn(places, F.when((F.size("__r") == 0) & (n >= K), F.array(least)).otherwise(F.col("__r")))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice("__h", i + 1, K)))
    return df.withColumn(anchors, hashes).drop("__h", "__s", "__m", "__r")


def spelled(anchors: str) -> Column:
    """The anchors as one string, 16 lower-case hex digits each."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def links(anchors: Column, places: Column) -> Column:
    """A hash for each two neighbouring anchors and the distance from the one to the other."""
    return F.transform(F.slice(anchors, 1, F.greatest(F.size(anchors) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(anchors, i + 1), F.get(places, i + 1) - F.get(places, i)))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Shared distinct anchors and links over those of the text that has more; texts without any are alike.

    a, b: names of (anchors, links) columns. The order in which anchors stand, and how far apart, thus
    counts as much as which they are.
    """
    shared = sum((F.size(F.array_intersect(x, y)) for x, y in zip(a, b)), F.lit(0))
    most = sum((F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))) for x, y in zip(a, b)), F.lit(0))
    return F.when(most == 0, F.lit(1.0)).otherwise(shared / most)


def in_circle(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text and a window in which lead() finds the next row by descending doc_id, round in a circle.

    The order is cut at quantiles of doc_id; each slice also gets the row that follows its last one
    (``ghost`` 1), so that only slices are sorted. Null ids come last, equal ones by a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    count = docs.count()
    spark = docs.sparkSession
    n = min(MOST_SLICES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // ROWS_PER_SLICE + 1))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))  # fewer than MOST_SLICES numbers
    below = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("slice", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below + 1))
    heads = rows.groupBy("slice").agg(F.max(F.struct("doc_id", "tie")).alias("head")).orderBy("slice").collect()  # a row per slice
    after = [(heads[k]["head"]["doc_id"], heads[k]["head"]["tie"], heads[(k + 1) % len(heads)]["slice"]) for k in range(len(heads))]
    after = spark.createDataFrame(after, "head_id long, head_tie long, home int")
    ghosts = rows.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    ghosts = ghosts.groupBy("home").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), F.col("home").alias("slice"), F.lit(1).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts).repartitionById(n + 1, "slice")
    return both, Window.partitionBy("slice").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the start of the next text.

    Returns doc_id, n_chars, edited, anchors, places, edited_anchors, near_edited, near_next. Null
    texts count as empty; equal texts have equal anchors; repeated rows stay; null ids come last in
    the order of texts; the only row follows itself; an empty table gives an empty one.
    """
    rows, order = in_circle(docs)
    rows = with_syncmers(rows, "text", "anchors", "places").withColumn("links", links(F.col("anchors"), F.col("places")))
    rows = rows.withColumns({c: F.lead(own).over(order) for c, own in (("next", "text"), ("next_anchors", "anchors"), ("next_links", "links"))}).where("ghost = 0")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third)).alias("edited")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited, "anchors", "places", "links", "next_anchors", "next_links")
    rows = with_syncmers(rows, "edited", "edited_anchors", "edited_places").withColumn("edited_links", links(F.col("edited_anchors"), F.col("edited_places")))
    near = lambda other: likeness(("anchors", "links"), (other + "_anchors", other + "_links"))
    return rows.select("doc_id", "n_chars", "edited", "anchors", "places", "edited_anchors", near("edited").alias("near_edited"), near("next").alias("near_next"))
