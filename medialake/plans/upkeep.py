"""Plans: what to back up, check, convert or skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved

REMOTE_SLACK_S = 2.0
MANIFEST_SLACK_S = 1.0
CHECK_AGE_S = 30 * 86_400
SETTLE_S = 600
RETRY_S = 7 * 86_400
LEAST_SAVING = 20 * 1024 * 1024
LEAST_SHARE = 0.25
PARTIAL_AGE_S = 86_400
# Fixed value: how half-made encodings are named, with the video's stem.
HALF_MADE = r"^\.(.+)\.smaller\.mp4\.part$"
# What an encoded picture must reach, at least ssim and worst block, at most chroma error.
GATES = {"visually_lossless": (0.985, 0.955, 0.0022), "balanced": (0.975, 0.900, 0.0032)}
# Video bits a second by longest side, and those of the sound.
RATE_CAPS = ((854, 1_500_000), (1280, 4_000_000), (1920, 8_000_000), (10_000, 20_000_000))
AUDIO_RATE = 160_000


def backup_plan(local: DataFrame, remote: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel, size, mtime) of local files to send.

    A file is there already if the remote one has its size and a time within 2 s, or its size and the
    manifest the size and a time within 1 s. All three: (rel, size, mtime).
    """
    named = lambda df, p: df.select("rel", F.col("size").alias(p + "size"), F.col("mtime").alias(p + "mtime"))
    rows = local.join(named(remote, "r_"), "rel", "left").join(named(manifest, "m_"), "rel", "left")
    same = F.col("r_size") == F.col("size")
    there = same & ((F.abs(F.col("r_mtime") - F.col("mtime")) <= REMOTE_SLACK_S) | ((F.col("m_size") == F.col("size")) & (F.abs(F.col("m_mtime") - F.col("mtime")) <= MANIFEST_SLACK_S)))
    return rows.where(~F.coalesce(there, F.lit(False))).select("rel", "size", "mtime")


def due_checks(files: DataFrame, as_of: float, budget: int) -> DataFrame:
    """(key, size, turn): files to check within a budget of bytes, never checked ones first, then the oldest.

    Files due are those never checked, or not for 30 days, that nobody wrote to for ten minutes (the later
    of mtime and ctime). The file that crosses the budget is still read. Bytes are added up by age bucket
    first, so only the bucket that the budget ends in is sorted.
    """
    settled = F.greatest("mtime", "ctime") <= as_of - SETTLE_S
    due = files.where((F.col("checked_at").isNull() | (F.col("checked_at") < as_of - CHECK_AGE_S)) & settled)
    due = due.select("key", "size", F.coalesce("checked_at", F.lit(-1.0)).alias("at")).withColumn("bucket", F.floor(F.col("at") / 86_400).cast("long"))
    sums = due.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    sums = sums.select("bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")).where(F.col("b0") < budget)
    own = Window.partitionBy("bucket").orderBy("at", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = due.join(sums, "bucket").select("key", "size", (F.col("b0") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("sent"), (F.col("n0") + F.count("*").over(own)).alias("turn"))
    return rows.where(F.col("sent") < budget).select("key", "size", "turn")


def check_states(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, state): new, ok, changed (on purpose: another size or time), damaged (same size and times, the
    same other digest at both readings), or skipped (two readings that differ). seen: (key, size, mtime, ctime, digest, again), where again is a second reading."""
    k = known.select("key", *(F.col(c).alias("k_" + c) for c in ("size", "mtime", "ctime", "digest")))
    same = (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime")) & (F.col("ctime") == F.col("k_ctime"))
    fine = (F.col("digest") == F.col("k_digest")) | (F.col("again") == F.col("k_digest"))
    state = F.when(F.col("k_digest").isNull(), "new").when(~same, "changed").when(fine, "ok").when(F.col("again") == F.col("digest"), "damaged").otherwise("skipped")
    return seen.join(k, "key", "left").select("key", state.alias("state"))


def expected_size(width: Column, height: Column, seconds: Column) -> Column:
    """Bytes of a video at the rate cap of its longest side, with sound."""
    side, cap = F.greatest(width, height), F.lit(RATE_CAPS[-1][1])
    for most, rate in reversed(RATE_CAPS[:-1]):
        cap = F.when(side <= most, rate).otherwise(cap)
    return (cap + AUDIO_RATE) * seconds / 8


def savings_plan(videos: DataFrame) -> DataFrame:
    """(id, saving, work, gain): videos worth converting, the most saved per work first.

    Worth it: at least 20 MiB and a quarter of the size. work: dots times seconds.
    """
    size = expected_size(F.col("width"), F.col("height"), F.col("duration"))
    work = F.greatest(F.lit(1), F.col("width") * F.col("height")) * F.greatest(F.col("duration"), F.lit(0.1))
    rows = videos.select("id", "bytes", F.greatest(F.col("bytes") - F.floor(size), F.lit(0)).alias("saving"), work.cast("double").alias("work"))
    rows = rows.where((F.col("saving") >= LEAST_SAVING) & (F.col("saving") >= F.col("bytes") * LEAST_SHARE))
    return rows.select("id", "saving", "work", (F.col("saving") / F.col("work")).alias("gain")).orderBy(F.desc("gain"), "id")


def not_skipped(plan: DataFrame, memory: DataFrame, as_of: float) -> DataFrame:
    """Plan rows (id, bytes) but those kept on purpose, or failed within 7 days, while the size is the same.

    memory: (id, state 'kept' or 'failed', size, at)."""
    hold = memory.where((F.col("state") == "kept") | (F.col("at") > as_of - RETRY_S)).select("id", F.col("size").alias("bytes")).distinct()
    return plan.join(hold, ["id", "bytes"], "left_anti")


def stray_partials(listing: DataFrame, as_of: float, root: str = "Originals/", older_than: float = PARTIAL_AGE_S) -> DataFrame:
    """(folder, name) of files under ``root`` that nobody wrote to for ``older_than`` seconds and that were left half made:
    the sending of a file (name.part), beside that file, or an encoding (.stem.smaller.mp4.part), beside its video.

    listing: (folder, name, mtime). Different names are given to what stands before each of their dots and dashes,
    of which the least and the greatest name are kept: the join is one of equal keys, a row each."""
    names = listing.select("folder", "name").distinct()
    cut = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)).isin(".", "-"))
    keys = F.concat(F.array(F.struct(F.col("name").alias("of"), F.lit(True).alias("whole"))), F.transform(cut, lambda i: F.struct(F.substring("name", F.lit(1), i - 1).alias("of"), F.lit(False).alias("whole"))))
    beside = names.select("folder", "name", F.inline(keys)).groupBy("folder", "of").agg(F.min("name").alias("least"), F.max("name").alias("most"), F.max("whole").alias("whole"))
    old = listing.where(F.endswith("name", F.lit(".part")) & F.startswith(F.concat("folder", F.lit("/")), F.lit(root)) & (F.lit(as_of) - F.coalesce("mtime", F.lit(0.0)) >= older_than))
    whole = F.regexp_extract("name", HALF_MADE, 1)
    half = F.when(whole != "", whole).otherwise(F.expr("substring(name, 1, length(name) - 5)"))
    old = old.select("folder", "name", half.alias("of"), (whole != "").alias("encoded")).distinct()
    fits = F.when(F.col("encoded"), (F.col("least") != F.col("name")) | (F.col("most") != F.col("name"))).otherwise(F.col("whole"))
    return old.join(beside, ["folder", "of"]).where(fits).select("folder", "name").distinct()


def estimate(files: DataFrame, measured: DataFrame, samples: int = 24) -> DataFrame:
    """One row: files, bytes, and the bytes after, by the ratio of at most ``samples`` evenly spread measured files.

    Which files to measure is sample_rows(); measured: (id, bytes, after)."""
    ratio = measured.orderBy("id").limit(samples).agg((F.sum("after") / F.sum("bytes")).alias("ratio")).first()["ratio"]  # one number
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.select("files", "bytes", (F.col("bytes") * F.lit(ratio).cast("double")).alias("after"))


def sample_rows(files: DataFrame, samples: int = 24) -> DataFrame:
    """Every step-th file in the order of paths (ties: of ids), at most ``samples``: the step is the files over the samples.

    Ranges of paths are counted first, so each ranks its own files; no task holds all."""
    dealt = saved(files.repartitionByRange("path", "id").withColumn("__slice", F.spark_partition_id()))
    sums = dealt.groupBy("__slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    sums = sums.select("__slice", before.alias("__n0"), F.greatest(F.lit(1), F.floor(total / max(1, samples))).alias("__step"))
    place = F.row_number().over(Window.partitionBy("__slice").orderBy("path", "id")) - 1 + F.col("__n0")
    rows = dealt.join(sums, "__slice").withColumn("__place", place)
    return rows.where((F.col("__place") % F.col("__step") == 0) & (F.col("__place") < F.col("__step") * samples)).drop("__slice", "__n0", "__step", "__place")


def best_rung(tries: DataFrame, profile: str = "visually_lossless") -> DataFrame:
    """(id, rung, size): of each picture's encodings, the smallest that passes all gates.

    Columns: id, rung, size, ssim, worst_block, chroma_error."""
    ssim, block, chroma = GATES[profile]
    good = tries.where((F.col("ssim") >= ssim) & (F.col("worst_block") >= block) & (F.col("chroma_error") <= chroma))
    return good.groupBy("id").agg(F.min(F.struct("size", "rung")).alias("b")).select("id", "b.rung", "b.size")
