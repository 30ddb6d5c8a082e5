"""Face vectors: groups, known people, margins, links and learned thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved

# Likeness thresholds.
ASSIGN = 0.48
MARGIN = 0.04
BARRED = -9.0
NEIGHBOURS = 5
# The audit of people's faces.
AUDIT_FACES = 30
AUDIT_MOVE = 0.65
AUDIT_MARGIN = 0.1
AUDIT_CONFIRMED = 0.15
AUDIT_LOOSEN = 0.4
AUDIT_MOMENT = 900.0
ABSENT = -9.0
#: Faces per block of comparisons.
BLOCK = 2048
PEOPLE_PER_BLOCK = 512
#: Nearest faces: parts that meet each other, and faces in one at most; faces of a person dealt together; rows and columns of one
#: product; rows that a pair of parts gives.
PARTS, PART = 8, 65_536
PERSON = 16_384
STRIP, WIDE = 1024, 8192
GIVEN = 4_000_000


def unit(vector: str) -> Column:
    """The vector at length 1. Vector and norm are bound as lambda variables: once for each row, not for each component."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    scaled = lambda v: F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))[0]
    return F.transform(F.array(F.col(vector)), scaled)[0]


def centroids(faces: DataFrame, by: str = "person_id") -> DataFrame:
    """(by, faces, total): the sum of the unit vectors of each person, added up per dimension before the shuffle's end."""
    flat = faces.where(F.col(by).isNotNull()).select(by, F.posexplode(unit("emb")).alias("dim", "x"))
    sums = flat.groupBy(by, "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("faces"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("total"))


def _blocks(df: DataFrame, size: int, *columns: str) -> tuple[DataFrame, int]:
    """(block, rows): df in blocks of about ``size`` rows by a hash of its first column, and their number."""
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(columns[0]), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows")), n


def _meet(one: DataFrame, two: DataFrame, n: int, compare: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Each block of one (mine) compared with each of the n blocks of two (theirs), by an equality join on the block's number.

    A pair of blocks goes to Python alone: a batch of rows would hold all pairs of a task at once.
    """
    wide = one.select(F.col("block").alias("own"), F.col("rows").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    names = [c.split()[0] for c in schema.split(", ")]

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(compare(iter([rows])))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=names)

    return wide.join(two.select("block", F.col("rows").alias("theirs")), "block").groupBy("block", "own").applyInPandas(pair, schema)


def _matrix(rows, name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], "f8")


def class_links(faces: DataFrame, by: str = "person_id", least: float | None = None) -> DataFrame:
    """(a, b, link) with a < b: the average likeness of the faces of two people, from their sums alone.

    It compares every two people, which is the operator, in blocks; faces aren't compared. least: pairs that
    are less alike aren't given, so that what comes out doesn't grow with the square of the people.
    """
    sums = saved(centroids(faces, by))
    blocks, n = _blocks(sums, PEOPLE_PER_BLOCK, by, "faces", "total")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, theirs in zip(batch["mine"], batch["theirs"]):
                a, b = (np.array([r[by] for r in x], "i8") for x in (mine, theirs))
                link = _matrix(mine, "total") @ _matrix(theirs, "total").T / np.outer(_matrix(mine, "faces"), _matrix(theirs, "faces"))
                i, j = np.nonzero((a[:, None] < b) if least is None else (a[:, None] < b) & (link >= least))
                yield pd.DataFrame({"a": a[i], "b": b[j], "link": link[i, j]})

    return _meet(blocks, blocks, n, compare, "a long, b long, link double")


def _two_best(scored: DataFrame, *keep: str) -> DataFrame:
    """id, keep, person_id, s and next: the best person of each face and the next one's score.

    Spark limits each face to two rows before the shuffle.
    """
    order = Window.partitionBy("id").orderBy(F.desc("s"), "person_id")
    two = scored.withColumn("__rn", F.row_number().over(order)).where("__rn <= 2")
    best = two.groupBy("id", *keep).agg(F.max(F.when(F.col("__rn") == 1, F.struct("person_id", "s"))).alias("b"), F.max(F.when(F.col("__rn") == 2, F.col("s"))).alias("next"))
    return best.select("id", *keep, "b.person_id", "b.s", "next")


def assign(faces: DataFrame, people: DataFrame, least: float = ASSIGN, margin: float = MARGIN, present: DataFrame | None = None) -> DataFrame:
    """(id, person_id, likeness) of loose faces: the person of the best average likeness, if it passes
    ``least``. A face is left out if the next person passes it too and is less than ``margin`` behind.
    Of two faces of a photo the better one gets the person. present: (photo_id, person_id) of people who
    are in a photo already, or whom the user took a face of that photo out of; they don't count there.

    people: centroids(). Blocks of faces meet blocks of people; a face keeps its two best of each.
    """
    means = people.select("person_id", F.transform("total", lambda x: x / F.col("faces")).alias("u"))
    theirs, n = _blocks(means, PEOPLE_PER_BLOCK, "person_id", "u")
    loose = faces.select("id", "photo_id", unit("emb").alias("u")).where("u is not null")
    if present is None:
        loose = loose.withColumn("barred", F.array().cast("array<long>"))
    else:  # as many as there are faces in a photo
        loose = loose.join(present.groupBy("photo_id").agg(F.collect_set(F.col("person_id").cast("long")).alias("barred")), "photo_id", "left")
    mine, _ = _blocks(loose, BLOCK, "id", "photo_id", "u", "barred")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["mine"], batch["theirs"]):
                s = _matrix(a, "u") @ _matrix(b, "u").T
                who = np.array([r["person_id"] for r in b], "i8")
                for k, r in enumerate(a):
                    if r["barred"] is not None and len(r["barred"]):
                        s[k, np.isin(who, r["barred"])] = BARRED
                order = np.lexsort((np.broadcast_to(who, s.shape), -s), axis=1)[:, :2]
                i = np.repeat(np.arange(len(a)), order.shape[1])
                yield pd.DataFrame({"id": np.array([r["id"] for r in a], "i8")[i], "photo_id": np.array([r["photo_id"] for r in a], "i8")[i], "person_id": who[order.ravel()], "s": s[i, order.ravel()]})

    scored = _meet(mine, theirs, n, compare, "id long, photo_id long, person_id long, s double")
    best = _two_best(scored, "photo_id")
    close = (F.col("next") >= least) & (F.col("s") - F.col("next") < margin)
    good = best.where((F.col("s") >= least) & ~F.coalesce(close, F.lit(False)))
    once = good.groupBy("photo_id", "person_id").agg(F.max(F.struct("s", (-F.col("id")).alias("neg"))).alias("b"))
    return once.select((-F.col("b.neg")).alias("id"), "person_id", F.col("b.s").alias("likeness"))


def _columns(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _best_of(s: np.ndarray, k: int) -> np.ndarray:
    return -np.partition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else s


def _tops(one: pa.Table, two: pa.Table, k: int, moment: float | None, but_itself: bool) -> Iterator[tuple[slice, int, bool, np.ndarray]]:
    """(rows of one, person, whole, likenesses): the k best of each person of two, from the highest down; -inf for those that there aren't."""
    order = np.argsort(two["person_id"].to_numpy(), kind="stable")
    who, key, whole, v = two["person_id"].to_numpy()[order], two["key"].to_numpy()[order], two["whole"].to_numpy()[order], _columns(two["u"])[order]
    ids, u = one["id"].to_numpy(), _columns(one["u"])
    at, theirs = (one["at"].to_numpy(), two["at"].to_numpy()[order]) if moment is not None else (None, None)
    for r in range(0, len(u), STRIP):
        rows, held = slice(r, min(r + STRIP, len(u))), None
        for c in range(0, len(v), WIDE):
            s = u[rows] @ v[c : c + WIDE].T
            if but_itself:
                own = np.flatnonzero(np.isin(key[c : c + WIDE], ids[rows]))
                x, y = np.nonzero(ids[rows][:, None] == key[c : c + WIDE][own])
                s[x, own[y]] = -np.inf
            if moment is not None:
                s[np.abs(at[rows][:, None] - theirs[c : c + WIDE]) <= moment] = -np.inf
            ends = [*(np.flatnonzero(np.diff(who[c : c + WIDE])) + 1).tolist(), s.shape[1]]
            for a, b in zip([0, *ends], ends):
                top = _best_of(s[:, a:b], k)
                if held and held[1] == who[c + a]:  # went on from the columns before
                    top = _best_of(np.concatenate([held[3], top], axis=1), k)
                elif held:
                    yield *held[:3], -np.sort(-held[3], axis=1)
                held = (rows, who[c + a], whole[c + a], top)
        if held:
            yield *held[:3], -np.sort(-held[3], axis=1)


def nearest_faces(mine: DataFrame, known: DataFrame, k: int, least: float | None = None, moment: float | None = None, but_itself: bool = False) -> DataFrame:
    """The columns of mine but u and at, person_id and top: how alike the k faces of each person are that are most alike to each of mine.

    mine: id, u and others; known: key, person_id, u. All are compared: each part of mine with each of known, in a task. There are PARTS of
    each, so that a face is sent PARTS times, until a part has PART faces. A person's faces lie in one part, if they are no more than PERSON;
    least: if given, of such a person only means of so much are given. moment: as in knn_means(), by the column at of both.
    """
    count, number = mine.count(), lambda n: max(1, min(PARTS, -(-n // BLOCK)), -(-n // PART))
    size = known.groupBy("person_id").agg(F.count("*").alias("__n"))
    faces, people = size.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
    cols = number(faces)
    rows = max(number(count), -(-count * people // (cols * GIVEN)) if least is None else 1)
    pieces = F.ceil(F.col("__n") / PERSON).cast("int")
    dealt = known.select(*(F.col(c).alias(c) for c in known.columns)).join(size, "person_id").withColumns({"whole": pieces == 1, "__piece": F.pmod(F.xxhash64("key"), pieces)})
    dealt = dealt.withColumns({"__b": F.pmod(F.xxhash64("person_id", "__piece"), F.lit(cols)).cast("int"), "__a": F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))}).withColumn("person_id", F.col("person_id").cast("long"))
    sent = mine.withColumns({"__a": F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int"), "__b": F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))})
    kept = [c for c in mine.columns if c not in ("u", "at")]

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        at, who, sizes, values = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.zeros(1, "i8")], [np.empty(0)]
        for rows, person, whole, top in _tops(one, two, k, moment, but_itself) if len(one) and len(two) else ():
            there = np.isfinite(top)
            n = there.sum(axis=1)
            good = n > 0
            if least is not None and whole:
                good &= np.where(there, top, 0).sum(axis=1) / np.maximum(n, 1) >= least - 1e-9
            at.append(np.flatnonzero(good) + rows.start)
            who.append(np.full(good.sum(), person))
            sizes.append(n[good])
            values.append(top[good][there[good]])
        tops = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), np.concatenate(values))
        own = one.select(kept).take(pa.array(np.concatenate(at)))
        return own.append_column("person_id", pa.array(np.concatenate(who), pa.int64())).append_column("top", tops)

    types = dict(mine.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", person_id long, top array<double>"
    found = sent.groupBy("__a", "__b").cogroup(dealt.groupBy("__a", "__b")).applyInArrow(compare, schema)
    tops = found.groupBy(*kept, "person_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
    return tops if least is None else tops.where(total("top") / F.size("top") >= least)


def total(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def knn_means(faces: DataFrame, k: int = NEIGHBOURS, moment: float | None = None) -> DataFrame:
    """(id, person_id, mean): for each face and person, the mean likeness of the k nearest faces of that person but itself.

    All faces of a person are compared.
    moment: if given, only faces of photos that ``taken_at`` puts more than so many seconds apart are
    compared (null: 0), and each of the k that is lacking counts as ABSENT; a pair without any has no row.
    """
    at = F.lit(0.0) if moment is None else F.coalesce(F.col("taken_at").cast("double"), F.lit(0.0))
    rows = saved(faces.select(F.col("id").cast("long").alias("id"), "person_id", unit("emb").alias("u"), at.alias("at")).where("u is not null"))
    known = rows.where(F.col("person_id").isNotNull()).withColumnRenamed("id", "key")
    top = nearest_faces(rows.drop("person_id"), known, k, moment=moment, but_itself=True)
    mean = total("top") / F.size("top") if moment is None else (total("top") + ABSENT * (k - F.size("top"))) / k
    return top.select("id", "person_id", mean.alias("mean"))


def margins(means: DataFrame) -> DataFrame:
    """(id, person_id, mean, margin): the best person of each face, and how far the next one is behind."""
    best = _two_best(means.withColumnRenamed("mean", "s"))
    return best.select("id", "person_id", F.col("s").alias("mean"), (F.col("s") - F.col("next")).alias("margin"))


def audit(faces: DataFrame, move: float = AUDIT_MOVE, margin: float = AUDIT_MARGIN, confirmed: float = AUDIT_CONFIRMED, loosen: float = AUDIT_LOOSEN, least: int = AUDIT_FACES, moment: float = AUDIT_MOMENT) -> DataFrame:
    """(id, person_id, to): faces that lie better with another person (to), or with none (to null).

    faces: id, person_id, photo_id, taken_at, state (0: placed by the engine, 1: confirmed with a group),
    pinned (chosen one by one: stays), emb. Only people with ``least`` faces are judged, and only by faces
    of other moments. A confirmed face needs the greater margin and is never loosened. Nobody gets a
    second face in a photo: of two that would move there the better one does, ties by the lesser id.
    """
    known = faces.where("person_id is not null and emb is not null")
    big = known.groupBy("person_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("person_id")
    known = saved(known.join(big, "person_id", "left_semi"))
    means = saved(knn_means(known, moment=moment))
    own = known.where(~F.coalesce(F.col("pinned").cast("boolean"), F.lit(False))).select("id", "person_id", "photo_id", F.coalesce("state", F.lit(0)).alias("state"))
    mine = own.join(means, ["id", "person_id"], "left").withColumn("mine", F.coalesce("mean", F.lit(ABSENT))).drop("mean")
    other = means.select("id", F.col("person_id").alias("p"), "mean").join(own.select("id", "person_id"), "id").where("p <> person_id").groupBy("id").agg(F.max(F.struct("mean", (-F.col("p")).alias("neg"))).alias("b"))
    judged = mine.join(other, "id", "left").withColumn("to", -F.col("b.neg"))
    need = F.when(F.col("state") == 0, margin).otherwise(confirmed)
    better = judged.where((F.col("b.mean") >= move) & (F.col("b.mean") >= F.col("mine") + need))
    taken = known.select("photo_id", F.col("person_id").alias("to")).distinct()
    free = better.join(taken, ["photo_id", "to"], "left_anti")
    moves = free.groupBy("photo_id", "to").agg(F.max(F.struct(F.col("b.mean").alias("m"), (-F.col("id")).alias("neg"))).alias("w")).select((-F.col("w.neg")).alias("id"), "to")
    found = judged.drop("to").join(moves, "id", "left")
    loose = (F.col("state") == 0) & (F.col("mine") < loosen)
    return found.where(F.col("to").isNotNull() | loose).select("id", "person_id", "to")


def learned_thresholds(answers: DataFrame, share: float = 0.9, least: int = 6, floor: float = 0.42) -> DataFrame:
    """One row: join_from, the lowest link down to which at least ``share`` of at least ``least`` answers say yes
    (counted from the top, not below ``floor``), and ask_from, the link above the run of noes at the bottom.

    answers: (link, same 0/1, at). Answers are added up per thousandth of a link first; those sums, a
    thousand rows or so, are what one task adds up, and each thousandth then goes through its own answers.
    """
    rows = answers.select("link", "same", "at", F.floor(F.col("link") * 1000).cast("long").alias("part"))
    sums = rows.groupBy("part").agg(F.sum("same").alias("y"), F.count("*").alias("n"))
    above, below = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("part", total("y", above).alias("y_above"), total("n", above).alias("n_above"), total("y", below).alias("y_below"))
    down = Window.partitionBy("part").orderBy(F.desc("link"), "at").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("part").orderBy("link", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, "part").select("link", (F.col("y_above") + F.sum("same").over(down)).alias("yes"), (F.col("n_above") + F.count("*").over(down)).alias("n"), (F.col("y_below") + F.sum("same").over(up)).alias("yes_up"))
    good = (F.col("n") >= least) & (F.col("yes") / F.col("n") >= share) & (F.col("link") >= floor)
    return placed.agg(F.min(F.when(good, F.col("link"))).alias("join_from"), F.max(F.when(F.col("yes_up") == 0, F.col("link"))).alias("ask_from"))


def suggestions(links: DataFrame, people: DataFrame, apart: DataFrame, together: DataFrame, ask: float, join: float, k: int) -> DataFrame:
    """The k likeliest pairs of people to ask about: linked from ``ask`` to below ``join``, not both
    named, not marked apart (a, b), and never in one photo (together: a, b)."""
    name = lambda side: people.select(F.col("id").alias(side), F.col("name").isNotNull().alias("named_" + side))
    pairs = links.where((F.col("link") >= ask) & (F.col("link") < join)).join(name("a"), "a").join(name("b"), "b").where("NOT (named_a AND named_b)")
    for other in (apart, together):
        pairs = pairs.join(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return pairs.select("a", "b", "link").orderBy(F.desc("link"), "a", "b").limit(k)


def work_queue(photos: DataFrame, scans: DataFrame, faces: DataFrame, version: int) -> DataFrame:
    """Photos to look at: never looked at, or by an older version with a doubtful face (state 0) in it."""
    doubt = faces.where("state = 0").select("photo_id").distinct().withColumn("doubt", F.lit(1))
    rows = photos.select(F.col("id").alias("photo_id")).join(scans.select("photo_id", "version"), "photo_id", "left").join(doubt, "photo_id", "left")
    return rows.where(F.col("version").isNull() | ((F.col("version") < version) & F.col("doubt").isNotNull())).select("photo_id")


def cover_faces(faces: DataFrame) -> DataFrame:
    """(person_id, id): the clearest face of each person: score times size, less for a turned head; least id."""
    clear = F.coalesce("score", F.lit(0.0)) * F.coalesce("px", F.lit(0.0)) * (1 - F.least(F.lit(0.9), F.abs(F.coalesce("yaw", F.lit(0.0)))))
    best = faces.where("person_id is not null and state < 2").groupBy("person_id").agg(F.max(F.struct(clear.alias("c"), (-F.col("id")).alias("neg"))).alias("b"))
    return best.select("person_id", (-F.col("b.neg")).alias("id"))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes struct(x, y, w, h)."""
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{q}"), F.col(f"{b}.{p}") + F.col(f"{b}.{q}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")))
    both = side("x", "w") * side("y", "h")
    return both / (F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both)


def matched_boxes(mine: DataFrame, theirs: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, other_id): for each of my boxes, the one of the same photo that overlaps most, from ``least`` on."""
    pairs = mine.select("photo", "id", F.col("box").alias("a")).join(theirs.select("photo", F.col("id").alias("other_id"), F.col("box").alias("b")), "photo").withColumn("iou", overlap("a", "b")).where(F.col("iou") >= least)
    return pairs.groupBy("id").agg(F.max_by("other_id", F.struct("iou", (-F.col("other_id")).alias("neg"))).alias("other_id"))
