from collections import Counter

import corpus_pipeline
import pytest
from test_pii import brute as personal
from test_repeats import brute as repeated
from test_simhash import shingles
from test_tokens import check_packing
from tokenizers import Tokenizer

from medialake.llm import queries, toxicity
from medialake.llm.common import saved

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and the last result."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], SF)))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for df in steps[1:5]:
        assert df.columns == steps[0].columns
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit_rows(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scorer()
    assert texts(steps[1]) == {i: t for i, t in texts(steps[0]).items() if score(t) < 0.5}


def test_one_of_each_group_of_near_copies_stays(steps):
    before, kept = texts(steps[1]), set(texts(steps[2]))
    sets = {i: shingles(t) for i, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    order = sorted(before)
    for i in order:
        if i in kept:
            assert all(like(i, j) < 0.8 for j in kept if j < i)  # no near copy is left
        else:
            assert any(like(i, j) >= 0.8 for j in order if j != i)  # nothing else goes


def test_repeats_go(steps):
    before = texts(steps[2])
    after = texts(steps[3])
    assert set(after) == set(before)
    for (i, _), (n, gone, *_) in zip(before.items(), repeated(before.values())):
        left = len(after[i].encode())
        assert n - gone - 8 <= left <= n - gone and (gone or after[i] == before[i])


def test_base_spans_are_redacted(steps):
    before, after = texts(steps[3]), texts(steps[4])
    for i, text in before.items():
        n = Counter(f"[{k}]" for _, k, _ in personal(text))
        assert sum(after[i].count(k) for k in n) <= n.total() or n
        assert not personal(after[i]) and (n or "[" in after[i] or after[i] == text)


def test_packing(steps):
    check_packing(steps[5].collect(), steps[4], Tokenizer.from_file(queries.tokenizer_path()))


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = odd.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if k < 4:
            rows = stage(spark, odd, str(tmp_path))
            assert rows.columns == odd.columns and all(r["score"] == 7 and r["digest"] == 7 for r in rows.collect())
