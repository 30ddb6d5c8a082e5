import duckdb
import numpy as np
import pytest

from medialake.llm import queries, topk
from medialake.llm.common import scratch as topk_scratch

SF = "/root/testdata/sf0.01"


def brute(rows, k=5, every=50):
    good = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(good):
        if qi % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i, b) for b, (i, v) in enumerate(good) if b != a and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i, _) in enumerate(scored)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_op3_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got(queries.op3_topk(spark, SF)) == sorted(con.execute(queries.ORACLES["op3_topk"]).fetchall())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9) for i, v in rows], "vec_id long, embedding array<float>, label int, uid int")


@pytest.mark.parametrize("shape", ["clusters", "one point", "huge"])
def test_small_blocks(spark, monkeypatch, shape):
    for name, n in (("BLOCK_ROWS", 16), ("QUERY_BLOCK_ROWS", 4), ("SAMPLE_ROWS", 60), ("SUB_NODES", 4)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    x = {"clusters": centres[rng.integers(0, 6, 300)] + 0.05 * rng.normal(size=(300, 5)), "one point": np.ones((300, 5)), "huge": rng.normal(size=(300, 5)) * 1e6}[shape].astype("f4")
    rows = [(i, v.tolist()) for i, v in zip(rng.permutation(300).tolist(), x)]
    assert got(topk.top_k(table(spark, rows), 5, 10)) == brute(rows, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (50, [0.5, -1.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 0.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [3.0, 1.0, 2.0]), (250, [1.0, 0.0, 0.0]), (300, []), (9, [])]
    assert got(topk.top_k(table(spark, rows))) == brute(rows)
    assert topk.top_k(table(spark, rows).limit(0)).count() == 0


def test_far_pairs_are_dropped():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(50, 3)) + c for c in ([100, 0, 0], [-100, 0, 0])])
    tree = topk.farthest_first(x, 2)
    leaf = tree.leaf(x, 2)
    radius = {i: float(np.sqrt(((x[leaf == i] - tree.centres[i]) ** 2).sum(1)).max()) for i in (0, 1)}
    pairs = topk.dual_descent(tree, {i: (radius[i], 5000.0) for i in (0, 1)}, radius)
    assert sorted(pairs) == [(0, 0), (1, 1)]


def test_pairs_of_clustered_vectors_are_pruned(spark):
    """Seven clusters of the given vectors: over half of the pairs of leaves and of blocks go unseen, and results stay exact."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in given])
    x = x[np.arange(len(x)) % 7] + 0.1 * x
    ids = [r["vec_id"] for r in given]
    vectors = table(spark, [(i, v.tolist()) for i, v in zip(ids, x.astype("f4"))])
    with topk_scratch(spark):
        queries_, blocks, near = topk.indexed(topk.scaled(vectors, topk.SCALE, 5), x.shape[1], 5)
        leaves = [b.select("leaf").distinct().count() for b in (queries_, blocks)]
        assert min(leaves) > 2 and near.count() < leaves[0] * leaves[1] / 2
        assert topk.near_blocks(queries_, blocks, near, x.shape[1]).count() < queries_.count() * blocks.count() / 2
    v = np.floor(256.0 * x.astype("f4").astype("f8")).astype("i8")
    want = []
    for a in (a for a, i in enumerate(ids) if i % 5 == 0):
        scores = v @ v[a]
        best = [b for b in np.lexsort((ids, -scores)) if b != a][:5]
        want += [(ids[a], r + 1, ids[b], int(scores[b])) for r, b in enumerate(best)]
    assert got(topk.top_k(vectors, 5, 5)) == sorted(want)


def test_bounds_are_raised_by_rows_nearby():
    x = np.array([[3, 0], [2, 0], [1, 0], [0, 5]], "i8")
    low = np.full(4, -(2**63), "i8")
    assert topk.raised(x, np.array([True, False, True, False]), low, 2).tolist() == [3, -(2**63), 2, -(2**63)]
    assert topk.raised(x, np.array([True] * 4), low, 4).tolist() == low.tolist()
