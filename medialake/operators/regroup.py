"""Faces that belong to nobody: put to known people, then grouped into new ones."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved
from .components import components
from .people import BLOCK, nearest_faces, total, unit

# Likeness, numbers of faces and photos.
SAME_PERSON = 0.50
JOIN_PERSON = 0.48
JOIN_MARGIN = 0.04
ANCHOR_JOIN = 0.50
ANCHORS = 3
REJECTED_LIKE = 0.8
KNOWN_FACES = 300
KNOWN_ALIKE = 0.58
KNOWN_MARGIN = 0.12
KNOWN_NEAREST = 5
SOMEBODY = 0.30
RELAX = 0.05
MIN_PHOTOS = 3
MOST_MERGES = 50
SEED_YAW = 0.6
SEED_ROLL = 45.0
AUTO, CONFIRMED, REMOVED = 0, 1, 2
#: Joining of groups: parts that meet each other, and groups in one at most; groups of a connected piece of near ones;
#: near groups listed for each; groups that tell how alike they are; links for each group in a large and in a small table.
PARTS, PART = 8, 65_536
PIECE = 65_536
LISTED = 64
PROBES = 256
FEW_NEAR, SOME_NEAR = 0.5, 16


def nearest(faces: DataFrame, known: DataFrame, k: int, least: float) -> DataFrame:
    """(id, photo_id, person_id, s): people whose k nearest vectors are on average ``least`` alike to a face.

    faces: id, photo_id, u; known: person_id, key, u.
    """
    top = nearest_faces(faces.select("id", "photo_id", "u"), known.select("key", "person_id", "u"), k, least)
    return top.select("id", "photo_id", "person_id", (total("top") / F.size("top")).alias("s"))


def without(scored: DataFrame, present: DataFrame, rejected: DataFrame) -> DataFrame:
    """scored, but for people who are in the photo already (photo_id, person_id) or from whom the user took such a face (id, person_id)."""
    return scored.join(present, ["photo_id", "person_id"], "left_anti").join(rejected, ["id", "person_id"], "left_anti")


def two_best(scored: DataFrame) -> DataFrame:
    """(id, photo_id, person_id, s, next): the likeliest person of each face, ties by the lesser id, and the next one's likeness."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "person_id"))
    two = scored.withColumn("__rn", rank).where("__rn <= 2").groupBy("id", "photo_id")
    best = two.agg(F.max(F.when(F.col("__rn") == 1, F.struct("person_id", "s"))).alias("b"), F.max(F.when(F.col("__rn") == 2, F.col("s"))).alias("next"))
    return best.select("id", "photo_id", "b.person_id", "b.s", "next")


def well_known(free: DataFrame, known: DataFrame, present: DataFrame, rejected: DataFrame, least_faces: int = KNOWN_FACES) -> DataFrame:
    """(id, photo_id, person_id) of faces that the nearest faces of a person with many say are theirs.

    Faces go by id, and a person who has got a face of a photo is somebody else for the later ones of it.
    In each round the faces of a photo are placed up to the first one whose person an earlier one takes;
    that one and those after it choose again, so the result is that of going one by one.
    """
    many = known.groupBy("person_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_faces).select("person_id")
    shown = saved(known.join(many, "person_id").select("person_id", "key", "u"))
    left = saved(without(nearest(free, shown, KNOWN_NEAREST, KNOWN_ALIKE - KNOWN_MARGIN), present, rejected))
    placed = None
    while not left.isEmpty():
        best = two_best(left)
        sure = best.where((F.col("s") >= KNOWN_ALIKE) & (F.col("s") - F.coalesce("next", F.lit(SOMEBODY)) >= KNOWN_MARGIN))
        first = F.min("id").over(Window.partitionBy("photo_id", "person_id"))
        late = F.min(F.when(F.col("id") > F.col("first"), F.col("id"))).over(Window.partitionBy("photo_id"))
        round_ = saved(sure.withColumn("first", first).withColumn("late", late).select("id", "photo_id", "person_id", "late"))
        done = round_.where("late is null or id < late").select("id", "photo_id", "person_id")
        placed = done if placed is None else placed.union(done)
        again = round_.where("late is not null").select("photo_id", "late").distinct()
        taken = done.select("photo_id", "person_id")
        left = saved(left.join(again, "photo_id").where("id >= late").drop("late").join(taken, ["photo_id", "person_id"], "left_anti"))
    return free.select("id", "photo_id", F.lit(None).cast("long").alias("person_id")).limit(0) if placed is None else saved(placed)


def to_known(free: DataFrame, known: DataFrame, anchors: DataFrame, present: DataFrame, rejected: DataFrame, join_person: float = JOIN_PERSON, anchor_join: float = ANCHOR_JOIN) -> DataFrame:
    """(id, photo_id, person_id) of faces whose average likeness to a person is enough and not as good for another.

    A person with three confirmed faces (anchors) is also known by the three nearest of them: if those
    are ``anchor_join`` alike, the person counts as just alike enough.
    """
    sums = known.select("person_id", F.posexplode("u").alias("dim", "x")).groupBy("person_id", "dim").agg(F.avg("x").alias("x"))
    means = sums.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("u")).withColumn("key", F.col("person_id"))
    vouched = anchors.groupBy("person_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= ANCHORS).select("person_id")
    by_mean = nearest(free, saved(means), 1, join_person)
    by_anchor = nearest(free, saved(anchors.join(vouched, "person_id").select("person_id", "key", "u")), ANCHORS, anchor_join).withColumn("s", F.lit(join_person))
    scored = by_mean.union(by_anchor).groupBy("id", "photo_id", "person_id").agg(F.max("s").alias("s"))
    best = two_best(without(scored, present, rejected))
    return best.where(F.col("next").isNull() | (F.col("s") - F.col("next") >= JOIN_MARGIN)).select("id", "photo_id", "person_id")


class _Groups:
    """Groups of an Arrow table, with their sets looked up when asked for."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.g, self.n = rows["g"].to_numpy(), rows["n"].to_numpy().astype("f8")
        self.total = rows["total"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.g), -1)
        self.u = (self.total / self.n[:, None]).astype("f4")
        self.lists = {c: rows[c].combine_chunks() for c in ("ids", "photos", "apart")}
        self.sets: dict[tuple[str, int], frozenset] = {}

    def of(self, name: str, i: int) -> frozenset:
        if (name, i) not in self.sets:
            self.sets[name, i] = frozenset(self.lists[name][i].as_py())
        return self.sets[name, i]

    def may_join(self, i: int, other: _Groups, j: int) -> bool:
        return self.of("photos", i).isdisjoint(other.of("photos", j)) and self.of("apart", i).isdisjoint(other.of("ids", j))

    def links(self, other: _Groups, least: float, strip: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, link) of pairs at least so alike, strip by strip; same: each pair of one table once.

        Single precision finds them, with room for its error (the means are no longer than 1); double says.
        """
        room = 2e-7 * self.u.shape[1] + 1e-6
        for r in range(0, len(self.g), strip):
            for c in range(r // strip * strip if same else 0, len(other.g), strip):
                i, j = np.nonzero(self.u[r : r + strip] @ other.u[c : c + strip].T >= np.float32(least - room))
                i, j = i + r, j + c
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    link = np.round(np.einsum("kd,kd->k", self.total[x], other.total[y]) / (self.n[x] * other.n[y]), 9)
                    good = (link >= least) & (self.g[x] != other.g[y])
                    if good.any():
                        yield x[good], y[good], link[good]

    def best(self, other: _Groups, i: np.ndarray, j: np.ndarray, link: np.ndarray, most: int) -> Iterator[tuple[int, int, float, bool]]:
        """(g, other, link, full): the best ``most`` of each of my groups that it may join; full: there may be more after this one."""
        low, high = np.minimum(self.g[i], other.g[j]), np.maximum(self.g[i], other.g[j])
        order = np.lexsort((high, low, -link, i))
        i, j, link = i[order].tolist(), j[order].tolist(), link[order].tolist()
        k = 0
        while k < len(i):
            own, found = i[k], 0
            while k < len(i) and i[k] == own and found < most:
                if self.may_join(own, other, j[k]):
                    found += 1
                    yield int(self.g[own]), int(other.g[j[k]]), link[k], found == most
                k += 1
            while k < len(i) and i[k] == own:
                k += 1


NEAR = "g long, other long, link double, full boolean"
GROUP = "g long, total array<double>, n long, ids array<long>, photos array<long>, apart array<long>"
MERGED = f"{GROUP}, log array<struct<g: long, other: long, link: double>>"


def _near(rows: Iterable[tuple[int, int, float, bool]]) -> pa.Table:
    g, other, link, full = zip(*rows) if (rows := list(rows)) else ((), (), (), ())
    return pa.table({"g": pa.array(g, pa.int64()), "other": pa.array(other, pa.int64()), "link": pa.array(link, pa.float64()), "full": pa.array(full, pa.bool_())})


def _likely(live: DataFrame, least: float, degree: float) -> float:
    """A likeness that a group shares with about ``degree`` others that it may join, by PROBES of them against all; least, if there are fewer."""
    probes = live.orderBy(F.xxhash64("g"), "g").limit(PROBES).toArrow()
    some, strip = max(4, 4 * int(degree)), BLOCK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _Groups(probes)
        for batch in batches:
            theirs = _Groups(pa.Table.from_batches([batch]))
            found = [row for hits in mine.links(theirs, least, strip) for row in mine.best(theirs, *hits, some)]
            yield from _near(found).to_batches()

    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("link")))
    top = live.mapInArrow(compare, NEAR).withColumn("rn", rank).where(F.col("rn") <= some)
    enough = max(1, int(probes.num_rows * degree))
    links = [r["link"] for r in top.select("link").orderBy(F.desc("link")).limit(enough).collect()]
    return links[-1] if len(links) == enough else least


def _near_groups(live: DataFrame, count: int, least: float) -> DataFrame:
    """(g, other, link, full): LISTED groups that each group is most alike to and may join, of those ``least`` alike; full as for best().

    The groups are dealt into parts, and every two parts meet in a task. There are PARTS of them, so
    that a group is sent PARTS times, whatever the number of groups, until a part has PART of them.
    """
    parts = max(min(PARTS, -(-count // BLOCK)), -(-count // PART))
    part, strip, most = F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int"), BLOCK, LISTED
    sent = live.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = sent.withColumn("cell", F.least("part", "with") * parts + F.greatest("part", "with")).drop("with")

    def compare(table: pa.Table) -> pa.Table:
        side = table["part"].to_numpy()
        sides = [_Groups(table.filter(pa.array(side == k))) for k in np.unique(side)]
        mine, theirs = sides[0], sides[-1]
        found = []
        for i, j, link in mine.links(theirs, least, strip, same=len(sides) == 1):
            found += mine.best(theirs, i, j, link, most)
            found += theirs.best(mine, j, i, link, most)
        return _near(found)

    found = sent.repartition(parts * (parts + 1) // 2, "cell").groupBy("cell").applyInArrow(compare, NEAR)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("link"), F.least("g", "other"), F.greatest("g", "other")))
    return found.withColumn("rn", rank).where(F.col("rn") <= most).select("g", "other", "link", (F.col("full") | (F.col("rn") == most)).alias("full"))


def _merging(least: float) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        return _merged(table, least)

    return merge


def _merged(table: pa.Table, least: float) -> pa.Table:
    """Groups of pieces of the graph of near groups, joined as far as that graph says whose best is whose.

    A group knows all its links above its floor, so its best is known while that is not below. Links are
    taken from the best down; a group whose best can't be taken (a floor is above it) waits, and so does
    what is most alike to it. A new group is near to what either of its two was near to, and to nothing
    else above the greater floor.
    """
    a = _Groups(table)
    g, n, total = a.g.tolist(), a.n.tolist(), list(a.total)
    ids, photos, apart = ([set(a.of(c, i)) for i in range(len(g))] for c in ("ids", "photos", "apart"))
    floor, place = table["floor"].to_pylist(), {x: i for i, x in enumerate(g)}
    log: list[list[tuple[int, int, float]]] = [[] for _ in g]
    near: list[dict[int, float]] = [{} for _ in g]
    for i, around in enumerate(table["around"].to_pylist()):
        for r in around or ():
            j = place[r["other"]]
            near[i][j] = near[j][i] = r["link"]
    entry = lambda i, j, link: (-link, min(g[i], g[j]), max(g[i], g[j]), i, j)
    heap = [entry(i, j, link) for i in range(len(g)) for j, link in near[i].items() if i < j]
    heapq.heapify(heap)
    gone, waits = [False] * len(g), [False] * len(g)
    while heap:
        link, _, _, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or near[i].get(j) != -link:
            continue
        if waits[i] or waits[j] or -link < max(floor[i], floor[j]):
            waits[i] = waits[j] = True
            continue
        if g[j] < g[i]:
            i, j = j, i
        log[i] += [*log[j], (g[i], g[j], -link)]
        gone[j] = True
        total[i] = total[i] + total[j]
        n[i] += n[j]
        floor[i] = max(floor[i], floor[j])
        for c in (ids, photos, apart):
            c[i] |= c[j]
        both = (near[i].keys() | near[j].keys()) - {i, j}
        for k in both:
            near[k].pop(i, None)
            near[k].pop(j, None)
        near[i], near[j] = {}, {}
        for k in both:
            if photos[i].isdisjoint(photos[k]) and apart[i].isdisjoint(ids[k]):
                new = round(float(total[i] @ total[k]) / (n[i] * n[k]), 9)
                if new >= least:
                    near[i][k] = near[k][i] = new
                    heapq.heappush(heap, entry(i, k, new))
    left = [i for i in range(len(g)) if not gone[i]]
    lists = {c: pa.array([sorted(v[i]) for i in left], pa.list_(pa.int64())) for c, v in (("ids", ids), ("photos", photos), ("apart", apart))}
    step = pa.struct([("g", pa.int64()), ("other", pa.int64()), ("link", pa.float64())])
    steps = pa.array([[dict(zip(("g", "other", "link"), x)) for x in log[i]] for i in left], pa.list_(step))
    return pa.table({"g": pa.array([g[i] for i in left], pa.int64()), "total": pa.array([total[i] for i in left], pa.list_(pa.float64())), "n": pa.array([int(n[i]) for i in left], pa.int64()), **lists, "log": steps})


def _pieces(edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, piece of each group, floors): edges (a, b, link) cut until a piece has at most PIECE groups, or links that are all alike.

    A piece that is too large keeps its links above their median, which is then a floor for its groups.
    """
    floors = None
    if count <= PIECE:
        return edges, edges.select(F.explode(F.array("a", "b")).alias("g")).distinct().withColumn("piece", F.lit(0).cast("long")), floors
    while True:
        piece = components(edges.select("a", "b"))
        large = piece.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
        links = edges.join(piece.select(F.col("id").alias("a"), "root"), "a").join(F.broadcast(large), "root")
        cuts = saved(links.groupBy("root").agg(F.percentile_approx("link", 0.5).alias("cut"), F.max("link").alias("top")).where("cut < top").select("root", "cut"))
        if cuts.isEmpty():
            return edges, piece.select(F.col("id").alias("g"), F.col("root").alias("piece")), floors
        cut = saved(piece.join(F.broadcast(cuts), "root").select(F.col("id").alias("g"), "cut"))
        floors = cut if floors is None else floors.unionByName(cut)
        edges = saved(edges.join(cut.withColumnRenamed("g", "a"), "a", "left").where("cut is null or link > cut").select("a", "b", "link"))


def joined(live: DataFrame, least: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups joined by average likeness, the most alike two first, as long as they are ``least`` alike.

    live: g, total (the sum of the group's unit vectors), n (how many), ids, photos and apart (arrays: what is
    in it, the photos of that, and ids that it must never be joined with). Groups with a photo in common are
    never joined. Returns the groups in the end, and (g, other, link) of every joining, g the lesser.
    most: it may end when the first so many joinings are known; others may be lacking then.

    A group made of two is nowhere more alike than the likelier of the two was. So of all links above a
    likeness, those of new groups are among what their two had: once the links above it are known, all
    joinings above it are too. Each round takes a likeness that leaves a few links per group (some
    groups tell; any would be right), finds the links above it, and makes the joinings
    within each connected piece of their graph; a table of PIECE groups is one piece. The next round has fewer groups and less likeness.
    """
    live = saved(live.select("g", "total", F.col("n").cast("long").alias("n"), "ids", "photos", "apart"))
    log = []
    while True:
        count = live.count()
        if count < 2:
            break
        cut = _likely(live, least, FEW_NEAR if count > PIECE else SOME_NEAR)
        near = saved(_near_groups(live, count, cut))
        edges = saved(near.select(F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"), "link").distinct())
        if edges.isEmpty():
            break
        edges, piece, cuts = _pieces(edges, count)
        floors = near.where("full").select("g", F.col("link").alias("floor"))
        floors = floors if cuts is None else floors.union(cuts)
        floors = saved(floors.groupBy("g").agg(F.max("floor").alias("floor")))
        around = edges.groupBy(F.col("a").alias("g")).agg(F.collect_list(F.struct(F.col("b").alias("other"), "link")).alias("around"))
        n = max(1, -(-count // PIECE))
        all_ = saved(live.join(piece, "g", "left").join(around, "g", "left").join(floors, "g", "left").withColumn("floor", F.coalesce("floor", F.lit(cut))))
        deal = all_.where("piece is not null").withColumn("task", F.pmod(F.xxhash64("piece"), F.lit(n)))
        made = deal.repartition(n, "task").groupBy("task").applyInArrow(_merging(cut), MERGED)
        made = saved(made)
        log.append(made.select(F.explode("log").alias("m")).select("m.*"))
        live = saved(made.drop("log").unionByName(all_.where("piece is null").select(*live.columns)))
        highest = floors.agg(F.max("floor")).first()[0]
        if cut <= least and highest is None:
            break
        if most is not None and reduce(DataFrame.unionByName, log).where(F.col("link") > max(cut, highest or cut)).count() >= most:
            break
    none = live.select("g", F.col("g").alias("other"), F.lit(0.0).alias("link")).limit(0)
    return live, reduce(DataFrame.unionByName, log, none)


def groups(faces: DataFrame, least: float = SAME_PERSON) -> DataFrame:
    """(id, photo_id, cluster): faces joined into groups by average likeness, never two of a photo; cluster: the least id."""
    none = F.array().cast("array<long>")
    one = faces.select(F.col("id").alias("g"), F.col("u").alias("total"), F.lit(1).alias("n"), F.array(F.col("id").cast("long")).alias("ids"), F.array(F.col("photo_id").cast("long")).alias("photos"), none.alias("apart"))
    made, _ = joined(one, least)
    return made.select(F.array_min("ids").alias("cluster"), F.explode(F.arrays_zip("ids", "photos")).alias("m")).select(F.col("m.ids").alias("id"), F.col("m.photos").alias("photo_id"), "cluster")


def merged_people(faces: DataFrame, people: DataFrame, apart: DataFrame, join_at: float, most: int = MOST_MERGES, min_photos: int = MIN_PHOTOS) -> DataFrame:
    """(person_id, into): unnamed people that are joined without asking, the likeliest first, at most ``most`` joinings.

    faces: person_id, photo_id, state, emb; people: id, name; apart: a, b, whom the user told to be two. People
    with few photos, a name, or a photo in common aren't joined; what is joined has the photos and the
    enemies of both. No joining is likelier than one before it, so the first ``most`` are those of all
    that are most alike.
    """
    rows = faces.where(F.col("person_id").isNotNull() & (F.coalesce("state", F.lit(AUTO)) < REMOVED)).select("person_id", "photo_id", unit("emb").alias("u")).where("u is not null")
    rows = rows.join(people.where("name is null").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    sums = rows.select("person_id", F.posexplode("u").alias("dim", "x")).groupBy("person_id", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("total"), F.max("n").alias("n"))
    shots = rows.groupBy("person_id").agg(F.collect_set("photo_id").alias("photos")).where(F.size("photos") >= min_photos)
    enemies = apart.select("a", "b").union(apart.select("b", "a")).groupBy(F.col("a").alias("person_id")).agg(F.collect_set(F.col("b").cast("long")).alias("apart"))
    live = sums.join(shots, "person_id").join(enemies, "person_id", "left")
    live = live.select(F.col("person_id").cast("long").alias("g"), "total", "n", F.array(F.col("person_id").cast("long")).alias("ids"), "photos", F.coalesce("apart", F.array().cast("array<long>")).alias("apart"))
    _, log = joined(live, join_at, most)
    first = log.orderBy(F.desc("link"), "g", "other").limit(most)
    return components(first.select(F.col("g").alias("a"), F.col("other").alias("b"))).where("id <> root").select(F.col("id").alias("person_id"), F.col("root").alias("into"))


def joined_by_hand(questions: DataFrame, shown: DataFrame, faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the user's picks do: (q, keep, gone, whole) of the questions that join something, and (q, id, person_id) of the picked faces.

    questions: q, a, b (two people); shown: q, id, picked; faces: id, person_id, state; people: id, name. A face
    of each has to be picked. The named one is kept, else the one with more picked faces, then with more faces,
    then a. The other goes whole if all its shown faces were picked, else only those that were. Questions
    that share a person are for the caller to put one after the other.
    """
    count = faces.where(F.coalesce("state", F.lit(AUTO)) < REMOVED).groupBy("person_id").agg(F.count("*").alias("n"))
    seen = shown.join(faces.select("id", "person_id"), "id").groupBy("q", "person_id").agg(F.count_if("picked").alias("mine"), F.count_if(~F.coalesce("picked", F.lit(False))).alias("left"))
    sides = questions.select("q", F.explode(F.array(F.struct(F.col("a").alias("person_id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("person_id"), F.lit(1).alias("side")))).alias("s")).select("q", "s.*")
    sides = sides.join(seen, ["q", "person_id"]).where("mine > 0").join(people.select(F.col("id").alias("person_id"), F.col("name").isNotNull().alias("named")), "person_id", "left").join(count, "person_id", "left")
    rank = F.struct(F.coalesce("named", F.lit(False)).alias("named"), "mine", F.coalesce("n", F.lit(0)).alias("n"), (-F.col("side")).alias("first"))
    both = sides.groupBy("q").agg(F.count("*").alias("sides"), F.max_by("person_id", rank).alias("keep"), F.min_by("person_id", rank).alias("gone"), F.min_by("left", rank).alias("left")).where("sides = 2")
    made = both.select("q", "keep", "gone", (F.col("left") == 0).alias("whole"))
    moved = shown.where("picked").join(made, "q").join(faces.select("id", "person_id"), "id").where("person_id = keep or person_id = gone").select("q", "id", F.col("keep").alias("person_id"))
    return made, moved


def new_people(free: DataFrame, join_at: float = SAME_PERSON, min_photos: int = MIN_PHOTOS) -> DataFrame:
    """(id, photo_id, cluster) of groups with enough photos, made of faces that are turned and tilted little enough to start one."""
    straight = (F.abs(F.coalesce("yaw", F.lit(0.0))) <= SEED_YAW) & (F.abs(F.coalesce("roll", F.lit(0.0))) <= SEED_ROLL)
    made = saved(groups(free.where(straight), join_at))
    enough = made.groupBy("cluster").agg(F.count_distinct("photo_id").alias("__n")).where(F.col("__n") >= min_photos).select("cluster")
    return made.join(enough, "cluster", "left_semi").select("id", "photo_id", "cluster")


def regroup(faces: DataFrame, join_at: float = SAME_PERSON, min_photos: int = MIN_PHOTOS, relaxed: bool = False, least_faces: int = KNOWN_FACES) -> DataFrame:
    """(id, person_id, cluster, how) of the faces that find a place; how: known, joined or new.

    faces: id, photo_id, person_id, state (0 placed by the engine, 1 confirmed, 2 taken out, other: ignored),
    was_person, yaw, roll, emb. First the well-known people take what is clearly theirs, then faces go to
    people there are, then those left are grouped; a group of enough photos is a new person, named by
    ``cluster``, its least id. Faces that the user touched stay where they are. relaxed: a little less
    likeness will do, as asked for. Faces without a vector have no place; an empty table gives an empty one.
    """
    rows = saved(faces.select("id", "photo_id", "person_id", F.coalesce("state", F.lit(AUTO)).alias("state"), "was_person", "yaw", "roll", unit("emb").alias("u")).where("u is not null"))
    less = RELAX if relaxed else 0.0
    known = rows.where(F.col("person_id").isNotNull() & F.col("state").isin(AUTO, CONFIRMED)).select("person_id", F.col("id").alias("key"), "u", "photo_id", "state")
    free = rows.where(F.col("person_id").isNull() & (F.col("state") == AUTO)).select("id", "photo_id", "yaw", "roll", "u")
    out_ = rows.where((F.col("state") == REMOVED) & F.col("was_person").isNotNull()).select(F.col("was_person").alias("person_id"), F.col("id").alias("key"), "u")
    present = known.select("photo_id", "person_id").distinct()
    rejected = saved(nearest(free, out_, 1, REJECTED_LIKE).select("id", "person_id"))
    sure = well_known(free, known.select("person_id", "key", "u"), present, rejected, least_faces)
    left = saved(free.join(sure, "id", "left_anti"))
    present = present.union(sure.select("photo_id", "person_id")).distinct()
    placed = saved(to_known(left, known.select("person_id", "key", "u"), known.where(F.col("state") == CONFIRMED).select("person_id", "key", "u"), present, rejected, JOIN_PERSON - less, ANCHOR_JOIN - less))
    made = new_people(left.join(placed, "id", "left_anti"), join_at, min_photos)
    none = F.lit(None).cast("long")
    parts = [sure.select("id", "person_id", none.alias("cluster"), F.lit("known").alias("how")), placed.select("id", "person_id", none.alias("cluster"), F.lit("joined").alias("how"))]
    return parts[0].union(parts[1]).union(made.select("id", none.alias("person_id"), "cluster", F.lit("new").alias("how")))
