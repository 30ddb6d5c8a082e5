import zlib

import numpy as np
import pytest

from medialake.llm import quality, queries, toxicity
from medialake.llm.common import labelled

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,parts,rest,cut,least", [("op8_quality", "quality", 4, 2, 0.7, 0.95), ("op10_toxicity", "toxic", 5, 0, 0.5, 0.9)])
def test_held_out_accuracy(spark, name, label, parts, rest, cut, least):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % parts == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    known = [(r[label], rows[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in known]) >= least


@pytest.mark.parametrize("size,found,wrong", [("sf0.1", 0.85, 0.02), ("sf0.001", 0.5, 0.05)])
def test_toxic_rows_are_found_and_clean_ones_left_alone(spark, size, found, wrong):
    """Shares of held-out rows: at least ``found`` of the toxic ones, at most ``wrong`` of the others."""
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_toxicity"](spark, f"/root/testdata/{size}").collect()}
    known = [(r["toxic"], rows[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"/root/testdata/{size}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([said for y, said in known if y == 1]) >= found
    assert np.mean([said for y, said in known if y == 0]) <= wrong


def test_labelled_rows_are_one_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, None), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    rows = sorted(tuple(r) for r in labelled(docs, labels, "toxic", 1, 5, 10).collect())
    assert [r for r in rows if r[0] not in "ab" or not r[0]] == [("", 0), ("c", 0), ("c", 1)] and len(rows) == 4
    assert labelled(docs, labels, "toxic", 1, 5, 1).count() <= 2


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows(spark, odd, op):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op.fit_rows(odd, labels, 4, 9)
    rows = op.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert op.score(odd.limit(0), model).count() == 0
    untaught = op.fit_rows(odd, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in op.score(odd, untaught).collect())


def test_words_and_units():
    assert toxicity.words("Ab, cd_EF 9é") == [b"ab", b"cd", b"ef", "9é".encode()]
    assert toxicity.units(b"wordy") == [b"wordy", b"word"]


def test_dictionaries_are_trained_by_zstandard_and_tell_windows_apart():
    import zstandard

    bad, good = [(b"nastyword", 900), (b"vilephrase", 700), (b"foulname", 800)], [(b"plain%d" % i, 30) for i in range(300)]
    pair = toxicity.dictionary(good, 32), toxicity.dictionary(bad, 32)
    assert all(zstandard.ZstdCompressionDict(d).dict_id() for d in pair)  # a trained dictionary has an id; raw content has none
    gap = toxicity.Gap(pair)
    assert gap(b"nastyword") > 2 and gap(b"foulname") > 2
    assert gap(b"plain77") <= 0 and gap(b"elsewhere") <= 1


def test_scores_equal_a_plain_loop(spark):
    """No cache, no windows counted twice: each window of each text is compressed by itself."""
    import re

    import zstandard as z

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_rows(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.count and all(z.ZstdCompressionDict(d).dict_id() for d in model.dictionaries)

    def size(window: bytes, dictionary: bytes) -> int:
        how = z.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(dictionary), min_match=4, strategy=z.STRATEGY_GREEDY, search_log=8, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary), compression_params=how).compress(b" " + window + b" <<window of text>> "))

    rows = toxicity.score(table.where("doc_id % 25 = 0"), model).collect()
    for r in rows:
        n = hits = 0
        for run in re.findall("[^\x00-/:-@\\[-`{-\x7f]+", r["text"].lower()):
            run = run.encode()
            if len(run) <= 12:
                cuts = [run]
            elif max(run) < 0xE0:
                cuts = [run[i : i + 32] for i in range(0, max(1, len(run) - 16), 16)]
            else:
                cuts = [run[i : i + 12] for i in range(len(run)) if i % 12 == 0 or run[i] >= 0xE0]
            n += len(cuts)
            hits += sum(size(w, model.dictionaries[0]) - size(w, model.dictionaries[1]) >= model.gap for w in cuts)
        need = max(min(model.count, max(1, n / 50)), model.share * n)
        assert r["score"] == pytest.approx(1 - 0.5 ** (hits / need) if n else 0.0)


def test_pairs_rank_the_good_above_the_bad():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.FEATURES))
    y = (x[:, 0] > 0).astype(int)
    model = quality.fit(x, y)
    s = model(x)
    assert np.mean((s >= quality.CUT) == (y == 1)) > 0.95


def test_the_fit_reads_whole_texts(spark, docs):
    """Toxic passages that stand after 12,000 characters of ordinary words are learned."""
    rng = np.random.default_rng(3)
    plain = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choice(plain, 1600), *rng.choice(["nastyword", "vilephrase", "foulname"] if i % 2 else plain, 6)])) for i in range(120)]
    assert all(len(" ".join(t.split()[:1600])) > 11_000 for _, t in rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    score = toxicity.fit_rows(docs(rows), labels).scorer()
    assert np.mean([(score(t) >= toxicity.CUT) == i % 2 for i, t in rows]) > 0.95


def test_every_byte_of_a_text_is_in_a_window():
    letters = np.random.default_rng(5).permutation([chr(c) for c in [*range(0x3041, 0x3091), *range(0x100, 0x140, 2)]])
    narrow = [chr(97 + c % 26) + chr(97 + c // 26) for c in np.random.default_rng(6).permutation(400)]
    for run in (*("".join(letters[:n]).lower() for n in range(4, 60)), *("".join(narrow)[:n] for n in range(12, 99))):
        data = run.encode()
        at = end = 0
        for w in toxicity.words(run):
            at = data.index(w, at) if len(set(run)) > 1 else end
            assert at <= end and len(w) <= toxicity.WINDOW_BYTES
            end = max(end, at + len(w))
        assert end == len(data)


def test_a_toxic_word_is_found_within_a_text_without_spaces():
    bad = "悪口雑言"
    pair = toxicity.dictionary([("普通の話".encode(), 50), ("良い天気".encode(), 50)], 32), toxicity.dictionary([(bad.encode(), 90)], 32)
    gap = toxicity.Gap(pair)
    assert max(map(gap, toxicity.words("今日はとても良い天気で" + bad + "と言われました"))) >= 3
    assert max(map(gap, toxicity.words("今日はとても良い天気でしたので散歩をしてから帰りました"))) <= 1


def test_quality_scores_equal_a_plain_loop(spark):
    """Shares counted one character at a time, the learned weights applied by hand."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_rows(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert 0 < model.quantile < 1

    def shares(text):
        data, words = text.encode(), text.split()
        n, k = max(1, len(data)), max(1, len(words))
        upper = sum(65 <= b <= 90 for b in data)
        letters = upper + sum(97 <= b <= 122 for b in data) + sum(b >= 128 for b in data)
        plain = sum(data.count(c) for c in b".,'-")
        marks = sum(chr(b) in r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""" for b in data)
        again = sum(a == b for a, b in zip(words, words[1:]))
        lines = [x for x in text.split("\n") if x]
        pairs = {(a, b) for a, b in zip(words, words[1:])}
        caps = upper / max(1, letters)
        return [
            caps, (marks - plain) / n, data.count(b"|") / k, data.count(b"!") / k, plain / n, sum(48 <= b <= 57 for b in data) / n, letters / n, again / k,
            len(pairs) / max(1, k - 1) if k > 1 else 1.0, len(set(words)) / k**0.9, max((words.count(w) for w in set(words)), default=0) / k,
            len(set(lines)) / max(1, len(lines)), min(1.0, n / k / 20), min(1.0, k / 20), min(1.0, k / 200), caps > 0.3, again / k > 0.2, (marks - plain) / k > 0.5,
        ]

    for r in quality.score(table.where("doc_id % 9 = 0"), model).collect():
        raw = sum(min(8.0, max(-8.0, (x - m) / s)) * w for x, m, s, w in zip(shares(r["text"]), model.mean, model.scale, model.weights))
        z = min(30.0, max(-30.0, model.slope * (raw - model.cut) + np.log(0.7 / 0.3)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_weights_lower_the_pairwise_loss():
    """The logistic loss over all pairs of a good and a bad row falls, and the cut is a quantile of the scores."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, quality.FEATURES))
    y = (x[:, 1] - x[:, 2] + rng.normal(size=120) / 2 > 0).astype(int)
    model = quality.fit(x, y)
    raw = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights
    loss = np.mean([np.log1p(np.exp(b - a)) for a in raw[y == 1] for b in raw[y == 0]])
    assert loss < 0.5 * np.log(2)
    assert model.cut == pytest.approx(np.quantile(raw, model.quantile))
    assert abs(np.mean(raw < model.cut) - model.quantile) < 0.02
