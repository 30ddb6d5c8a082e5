"""Helpers that several text operators share: tables, labelled rows, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import saved, scratch, shared_dir

__all__ = ["documents", "free", "held_out", "labelled", "running", "saved", "scratch", "shared_dir", "sliced", "table", "whole_text"]

ROWS_PER_SLICE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(name: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free(name: str, df: DataFrame) -> str:
    """A column name, made of ``name``, that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = "__" + name
    while name in taken:
        name += "_"
    return name


def held_out(doc_id: str, parts: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, parts: int, remainder: int, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` rows of each label that aren't held out, the least by a hash of the id.

    Of an id's rows in docs the one with the least hash of its text counts, so that ids bound the rows
    and no text is sorted or moved but to the task of its id. An id that has both labels is in both kinds.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, remainder))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    kinds = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    found = texts.join(F.broadcast(kinds[0].union(kinds[1])), "doc_id")  # at most 2 * rows ids
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def sliced(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``slice``: contiguous ranges of df in the given order, numbered from 0, saved."""
    n = max(1, df.count() // ROWS_PER_SLICE + 1)
    n = max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    return saved(df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()))


def running(df: DataFrame, order: list, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Global exclusive prefix sums of a table that has ``slice`` (see sliced).

    sums: new column -> the summed one. Each slice is summed by itself; the totals of the slices,
    one row a slice (and a value of ``by``), are summed over the slices and added.
    """
    by = by or []
    own = Window.partitionBy("slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("slice", *by).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    totals = totals.select("slice", *by, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    local = df.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(n) for n, c in sums.items()))
    joined = local.join(totals, ["slice", *by])
    return joined.select(*df.columns, *((F.col(n) + F.col(f"__{n}")).cast("long").alias(n) for n in sums))
