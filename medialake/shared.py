"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder from spark.checkpoint.dir; a temporary one only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="medialake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Tables written inside the open scratch() blocks, the innermost last.
_OPEN: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """rows with ``total``: the sum of ``amount`` over the rows up to each in that order, itself included.

    Ranges of the order are summed first, so each adds up its own rows; no task holds all.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()))
    sums = dealt.groupBy("__slice").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    own = F.sum(amount).over(Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(F.broadcast(sums.select("__slice", before.alias("__before"))), "__slice").withColumn("total", own + F.col("__before")).drop("__slice", "__before")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables saved inside the block at its end, but for those saved by the function it gives."""
    made: list[str] = []
    kept: list[str] = []
    _OPEN.append(made)

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
        kept.append(made[-1])
        return out

    try:
        yield keep
    finally:
        _OPEN.pop()
        jvm = spark.sparkContext._jvm
        for path in set(made) - set(kept):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
