"""Exact top-k by inner product with a cover tree over queries and data.

A farthest-first traversal of a bounded sample gives the nodes of the tree's upper levels: each prefix
of it covers the sample within the next insertion distance. Every row, query or datum, goes to its
nearest leaf; leaves are cut into blocks, each with its own centre, covering radius and sub-nodes. Pairs
of a query node and a data node are descended together and dropped if no product across their
covering radii reaches the worst kth score of the queries below. The tree's lower levels grow with the rows, as blocks do: Spark joins the centres and radii of blocks
under the pairs of leaves that are left, prunes pairs of blocks by the same bound, and joins the vectors of
those that pass, by block, so that a dense leaf is no hot key. Sub-nodes inside a block are pruned alike
before products are taken. Bounds start from the sample; a query is then compared with the other rows of the
block that it lies in itself, the nearest there are, before any pair is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The tree's upper levels and the first bounds come from at most so many rows; every row is indexed.
SAMPLE_ROWS = 4096
#: Leaves that the driver's descent sees, the square root of the rows until then (half that of the queries);
#: what lies below them are blocks, as many as the rows need.
MOST_LEAVES = 256
BLOCK_ROWS = 2048
QUERY_BLOCK_ROWS = 512
SUB_NODES = 16
SCALE = 256
SLACK = 1e-6


@dataclass
class Tree:
    """Nodes of a farthest-first traversal; children of a node are the ones that lie nearest to it."""

    centres: np.ndarray
    parent: np.ndarray

    def leaf(self, x: np.ndarray, leaves: int) -> np.ndarray:
        c = self.centres[:leaves]
        return np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)


def farthest_first(x: np.ndarray, n: int) -> Tree:
    """The first n rows of the traversal; a node's parent is the nearest node of a coarser level."""
    chosen, gap = [0], [np.inf]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        i = int(np.argmax(near))
        if near[i] <= 0:
            break
        chosen.append(i)
        gap.append(float(near[i]) ** 0.5)
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    c = x[chosen]
    level = np.floor(np.log2(np.array(gap[1:]))) if len(gap) > 1 else np.empty(0)
    parent = np.zeros(len(c), "i8")
    for i in range(1, len(c)):
        coarser = np.concatenate([[0], 1 + np.flatnonzero(level[: i - 1] > level[i - 1])])
        parent[i] = coarser[np.argmin(((c[coarser] - c[i]) ** 2).sum(1))]
    return Tree(c, parent)


def bound(qc: np.ndarray, qr: np.ndarray, dc: np.ndarray, dr: np.ndarray) -> np.ndarray:
    """The largest product of a vector within qr of qc and one within dr of dc, for all pairs of rows."""
    qn, dn = np.sqrt((qc * qc).sum(1)), np.sqrt((dc * dc).sum(1))
    most = qc @ dc.T + qn[:, None] * dr + qr[:, None] * dn + qr[:, None] * dr
    return most + SLACK * (1 + np.abs(most) + (qn + qr)[:, None] * (dn + dr))


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles while they are exact, else by Python integers, held in 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype("f8") @ d.astype("f8").T).astype("i8")
    if most < 2**62:
        return q @ d.T
    return np.clip(q.astype(object) @ d.astype(object).T, -(2**63), 2**63 - 1).astype("i8")


def dual_descent(tree: Tree, queries: dict[int, tuple[float, int]], data: dict[int, float]) -> list[tuple[int, int]]:
    """Leaf pairs (query leaf, data leaf) that may hold a top-k pair.

    queries: leaf -> (covering radius, worst kth score so far); data: leaf -> covering radius. A
    node stands for the leaves below it, itself among them.
    """

    def nodes(leaves) -> dict[int, list[int]]:
        below: dict[int, list[int]] = {}
        for leaf in leaves:
            node, seen = leaf, {leaf}
            below.setdefault(leaf, []).append(leaf)
            while tree.parent[node] != node:
                node = int(tree.parent[node])
                if node in seen:
                    break
                seen.add(node)
                below.setdefault(node, []).append(leaf)
        return below

    qb, db = nodes(queries), nodes(data)
    radius = lambda node, leaves, own: max(float(np.linalg.norm(tree.centres[n] - tree.centres[node])) + own(n) for n in leaves)
    q_info = {n: (radius(n, ls, lambda leaf: queries[leaf][0]), min(queries[leaf][1] for leaf in ls)) for n, ls in qb.items()}
    d_info = {n: radius(n, ls, lambda leaf: data[leaf]) for n, ls in db.items()}
    children: dict[int, list[int]] = {}
    for n in {*qb, *db}:
        if tree.parent[n] != n:
            children.setdefault(int(tree.parent[n]), []).append(n)

    def passes(q: tuple[int, float, float], d: tuple[int, float]) -> bool:
        return bound(tree.centres[q[0]][None], np.array([q[1]]), tree.centres[d[0]][None], np.array([d[1]]))[0, 0] >= q[2]

    def split(node: int, info, leaf_info, own) -> list:
        """A node's parts: its own leaf, if it is one, and its children."""
        parts = [(node, *leaf_info(node), True)] if node in own else []
        return parts + [(c, *info(c), False) for c in children.get(node, []) if c in (qb if own is queries else db)]

    q_of = lambda n: q_info[n]
    d_of = lambda n: (d_info[n],)
    out: list[tuple[int, int]] = []
    stack = [((0, *q_info[0], False), (0, d_info[0], False))] if 0 in q_info and 0 in d_info else []
    while stack:
        q, d = stack.pop()
        if not passes(q[:3], d[:2]):
            continue
        if q[3] and d[2]:
            out.append((q[0], d[0]))
        elif d[2] or not q[3] and q[1] >= d[1]:
            stack += [(part, d) for part in split(q[0], q_of, lambda n: queries[n], queries)]
        else:
            stack += [(q, part) for part in split(d[0], d_of, lambda n: (data[n],), data)]
    return out


def scaled(vectors: DataFrame, scale: int, queries_every: int) -> DataFrame:
    """uid, vec_id, query, dim, data (64-bit integers as bytes): floor(scale * x) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "dim": [len(v) for v in b["v"]], "data": [np.asarray(v, "<i8").tobytes() for v in b["v"]]})

    packed = rows.mapInPandas(pack, "vec_id long, dim int, data binary")
    return saved(packed.select(F.monotonically_increasing_id().alias("uid"), "vec_id", (F.col("vec_id") % queries_every == 0).alias("query"), "dim", "data"))


def unpacked(data, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<i8").reshape(-1, dim)


def raised(x: np.ndarray, query: np.ndarray, kth: np.ndarray, k: int) -> np.ndarray:
    """kth, raised for the queries among the rows x to their kth best score against the other rows of x."""
    mine = np.flatnonzero(query)
    if len(mine) and len(x) > k:
        score = products(x[mine], x)
        score[np.arange(len(mine)), mine] = -(2**63)
        kth = kth.copy()
        kth[mine] = np.maximum(kth[mine], np.partition(score, -k, axis=1)[:, -k])
    return kth


def blocked(rows: DataFrame, cap: int, k: int | None = None) -> DataFrame:
    """(leaf, dim, centre, radius, least, centres, radii, sizes, ids, uids, kth, data): blocks of up to ``cap`` rows of a leaf.

    rows: leaf, part, vec_id, uid, query, kth, data. A block has its centre, its covering radius and its least kth
    score. Its rows are ordered by its sub-nodes, whose centres, radii and sizes it holds. With k given, the kth
    scores of its queries are raised by its own rows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def filled(part: pd.DataFrame) -> pd.DataFrame:
            out = []
            for a in range(0, len(part), cap):
                own = part.iloc[a : a + cap]
                x = unpacked(own["data"], int(own["dim"].iloc[0])) if own["dim"].iloc[0] else np.zeros((len(own), 0), "i8")
                f = x.astype("f8")
                tree = farthest_first(f, SUB_NODES)
                sub = tree.leaf(f, len(tree.centres))
                order = np.argsort(sub, kind="stable")
                f, x, sub = f[order], x[order], sub[order]
                sizes = np.bincount(sub, minlength=len(tree.centres))
                distance = np.sqrt(((f - tree.centres[sub]) ** 2).sum(1))
                radii = np.array([distance[sub == s].max(initial=0.0) for s in range(len(sizes))])
                own, centre = own.iloc[order], f.mean(0)
                kth = own["kth"].to_numpy("<i8")
                kth = kth if k is None else raised(x, own["query"].to_numpy(bool), kth, k)
                radius = float(np.sqrt(((f - centre) ** 2).sum(1)).max(initial=0.0))
                out.append((int(own["leaf"].iloc[0]), int(own["dim"].iloc[0]), centre.astype("<f8").tobytes(), radius, int(kth.min()), tree.centres.tobytes(), radii.tobytes(), sizes.astype("<i8").tobytes(), own["vec_id"].to_numpy("<i8").tobytes(), own["uid"].to_numpy("<i8").tobytes(), kth.astype("<i8").tobytes(), x.tobytes()))
            return pd.DataFrame(out, columns=["leaf", "dim", "centre", "radius", "least", "centres", "radii", "sizes", "ids", "uids", "kth", "data"])

        key = None
        for batch in batches:  # sorted by leaf and part
            for at, part in batch.groupby(["dim", "leaf", "part"], sort=False):
                if key is not None and at != key:
                    yield filled(pd.concat(held))
                    held = []
                key = at
                held.append(part)
        if held:
            yield filled(pd.concat(held))

    dealt = rows.repartition("dim", "leaf", "part").sortWithinPartitions("dim", "leaf", "part")
    return dealt.mapInPandas(pack, "leaf long, dim int, centre binary, radius double, least long, centres binary, radii binary, sizes binary, ids binary, uids binary, kth binary, data binary")


def raised_scores(blocks: DataFrame) -> DataFrame:
    """(uid, kth) of the queries in blocks whose kth score is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            uid, kth = (np.frombuffer(b"".join(b[c]), "<i8") for c in ("uids", "kth"))
            yield pd.DataFrame({"uid": uid, "kth": kth})[kth > -(2**63)]

    return blocks.select("uids", "kth").mapInPandas(run, "uid long, kth long")


def near_blocks(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, dim: int) -> DataFrame:
    """(q_block, d_block): blocks under pairs of leaves (q_leaf, d_leaf) that may hold a top-k pair, by centres and radii."""

    def pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, d = (np.frombuffer(b"".join(b[c]), "<f8").reshape(len(b), dim) for c in ("q_centre", "d_centre"))
            qr, dr = b["q_radius"].to_numpy(), b["d_radius"].to_numpy()
            qn, dn = np.sqrt((q * q).sum(1)), np.sqrt((d * d).sum(1))
            most = (q * d).sum(1) + qn * dr + qr * dn + qr * dr
            most += SLACK * (1 + np.abs(most) + (qn + qr) * (dn + dr))
            yield b.loc[most >= b["least"].to_numpy("f8"), ["q_block", "d_block"]]

    of = lambda df, side, *more: df.select(F.col("leaf").alias(side + "_leaf"), *(F.col(c).alias(f"{side}_{c}") for c in ("block", "centre", "radius")), *more)
    met = of(queries, "q", "least").join(F.broadcast(leaves), "q_leaf").join(of(blocks, "d"), "d_leaf")
    return met.mapInPandas(pruned, "q_block long, d_block long")


def top_k(vectors: DataFrame, k: int = 5, queries_every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but itself, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``queries_every``. Vectors that are null, or
    hold null or non-finite components, or have a null vec_id, take no part; vectors are compared
    with those of their own length. Rows that repeat a vec_id are rows of their own: each is a
    candidate, and a query if the id says so. Fewer candidates than k give fewer rows; an empty table
    gives none. Products beyond 64 bits are held at the largest.
    """
    rows = scaled(vectors, scale, queries_every)
    schema = "query_id long, rank int, vec_id long, score long"
    out = None
    for dim in sorted(r["dim"] for r in rows.where("query").select("dim").distinct().collect()):
        found = _top_k(rows.where(F.col("dim") == dim), dim, k)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def indexed(rows: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of queries, blocks of all rows, and the pairs (q_leaf, d_leaf) of their leaves that the descent leaves."""
    spark = rows.sparkSession
    n, m = rows.agg(F.count("*"), F.count_if("query")).first()
    picked = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE_ROWS).select("uid", "data").collect()
    sample, own = unpacked([r["data"] for r in picked], dim) if dim else np.zeros((len(picked), 0), "i8"), np.array([r["uid"] for r in picked])
    tree = farthest_first(sample.astype("f8"), max(1, min(MOST_LEAVES, isqrt(n))))
    leaves = len(tree.centres)
    q_leaves = max(1, min(leaves, isqrt(m) // 2))
    state = spark.sparkContext.broadcast((tree, sample, own))  # at most SAMPLE_ROWS vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree_, sample_, own_ = state.value
        for b in batches:
            x = unpacked(b["data"], dim) if dim else np.zeros((len(b), 0), "i8")
            f, query = x.astype("f8"), b["query"].to_numpy(bool)
            leaf, q_leaf = tree_.leaf(f, leaves), np.full(len(b), -1)
            q_leaf[query] = tree_.leaf(f[query], q_leaves)
            kth = np.full(len(b), -(2**63), "i8")
            for i in np.flatnonzero(query):  # the kth best of the sample: no better one can be missed below it
                s = products(x[i : i + 1], sample_)[0][own_ != b["uid"].iat[i]]
                if len(s) >= k:
                    kth[i] = np.partition(s, -k)[-k]
            gap = lambda c: np.sqrt(((f - c) ** 2).sum(1))
            yield b.assign(leaf=leaf, q_leaf=q_leaf, kth=kth, gap=gap(tree_.centres[leaf]), q_gap=gap(tree_.centres[np.maximum(q_leaf, 0)]))

    placed = saved(rows.mapInPandas(assign, "uid long, vec_id long, query boolean, dim int, data binary, leaf long, q_leaf long, kth long, gap double, q_gap double"))
    data = {r["leaf"]: r for r in placed.groupBy("leaf").agg(F.max("gap").alias("r"), F.count("*").alias("n")).collect()}  # a row per leaf

    def parts(sizes: dict, leaf: str, cap: int):
        table = {i: r["n"] // cap + 1 for i, r in sizes.items()}
        count = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(leaf))
        return F.pmod(F.xxhash64("uid"), count)

    block = F.monotonically_increasing_id().alias("block")
    cols = ["uid", "vec_id", "query", "dim", "data"]
    blocks = saved(blocked(placed.select(*cols, "kth", "leaf", parts(data, "leaf", BLOCK_ROWS).alias("part")), BLOCK_ROWS, k).select(block, "*"))
    better = raised_scores(blocks).withColumnRenamed("kth", "better")
    asking = placed.where("query").join(better, "uid", "left").withColumn("kth", F.greatest("kth", "better"))
    asking = saved(asking.select(*cols, "kth", "q_leaf", "q_gap"))
    asked = {r["q_leaf"]: r for r in asking.groupBy("q_leaf").agg(F.max("q_gap").alias("r"), F.min("kth").alias("kth"), F.count("*").alias("n")).collect()}
    pairs = dual_descent(tree, {i: (r["r"], float(r["kth"])) for i, r in asked.items()}, {i: r["r"] for i, r in data.items()})
    queries = asking.select(*cols, "kth", F.col("q_leaf").alias("leaf"), parts(asked, "q_leaf", QUERY_BLOCK_ROWS).alias("part"))
    queries = saved(blocked(queries, QUERY_BLOCK_ROWS).select(block, "*"))
    return queries, blocks, spark.createDataFrame(pairs or [(-1, -1)], "q_leaf long, d_leaf long")  # at most MOST_LEAVES squared


def _top_k(rows: DataFrame, dim: int, k: int) -> DataFrame:
    queries, blocks, near = indexed(rows, dim, k)
    met = near_blocks(queries, blocks, near, dim)
    q = met.join(queries.select(F.col("block").alias("q_block"), *(F.col(c).alias("q_" + c) for c in ("data", "kth", "uids", "ids"))), "q_block").drop("q_block")
    joined = q.join(blocks.select(F.col("block").alias("d_block"), "data", "ids", "uids", "sizes", "centres", "radii"), "d_block").drop("d_block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, kth, uid, qid = unpacked([r.q_data], dim) if dim else np.zeros((len(r.q_ids) // 8, 0), "i8"), np.frombuffer(r.q_kth, "<i8"), np.frombuffer(r.q_uids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                d, ids, uids, sizes = unpacked([r.data], dim) if dim else np.zeros((len(r.ids) // 8, 0), "i8"), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.uids, "<i8"), np.frombuffer(r.sizes, "<i8")
                centres = np.frombuffer(r.centres, "<f8").reshape(len(sizes), dim)
                reach = bound(x.astype("f8"), np.zeros(len(x)), centres, np.frombuffer(r.radii, "<f8")) >= kth[:, None]
                ends = np.cumsum(sizes)
                best: list = [np.empty((0, 4), "i8")]
                for s in np.flatnonzero(reach.any(axis=0)):
                    mine = np.flatnonzero(reach[:, s])
                    at = slice(ends[s] - sizes[s], ends[s])
                    score = products(x[mine], d[at])
                    i, j = np.nonzero((score >= kth[mine, None]) & (uid[mine, None] != uids[None, at]))
                    best.append(np.stack([mine[i], score[i, j], ids[at][j], uids[at][j]], axis=1))
                rows_ = np.concatenate(best)
                rows_ = rows_[np.lexsort((rows_[:, 3], rows_[:, 2], -rows_[:, 1].astype(object) if (rows_[:, 1] == -(2**63)).any() else -rows_[:, 1], rows_[:, 0]))]
                first = np.searchsorted(rows_[:, 0], rows_[:, 0])
                rows_ = rows_[np.arange(len(rows_)) - first < k]
                yield pd.DataFrame({"query_uid": uid[rows_[:, 0]], "query_id": qid[rows_[:, 0]], "vec_id": rows_[:, 2], "uid": rows_[:, 3], "score": rows_[:, 1]})

    found = joined.mapInPandas(compare, "query_uid long, query_id long, vec_id long, uid long, score long")
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
