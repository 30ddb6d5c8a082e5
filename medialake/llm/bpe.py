"""Byte-level BPE: encoding and decoding through a table of distinct words.

The words of a text (the tokenizer's own pre-tokens) are split inside Spark tasks. A block of
documents keeps, for each document, the positions of its words in the block's vocabulary; the words
themselves go once per block into a word table, which is split by a hash of the word, made distinct
over the corpus, and encoded once a word. The ids are joined back by block and put in place by
position; decoding joins them with the id-to-piece table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

BLOCK_CHARS = 8_000_000
CACHE_WORDS = 400_000
#: Texts of these characters only are split by SPLIT; others by the tokenizer's own splitter, which is slower.
PLAIN = re.compile("[^\t-\r -~\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(path: str) -> dict[int, bytes]:
    """Id -> bytes, of the vocabulary and the added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = byte_chars()
    pieces = {i: bytes(chars[c] for c in p) if all(c in chars for c in p) else p.encode() for p, i in spec["model"]["vocab"].items()}
    return pieces | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class Splitter:
    """Splits texts into the words that BPE never merges across; added tokens are words of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def part(self, text: str) -> list[str]:
        if PLAIN.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(a in text for a in self.added):
            return self.part(text)
        return [w for p in self.cut.split(text) if p for w in ([p] if p in self.added else self.part(p))]


class Encoder:
    """Encodes single words; a bounded cache holds the ids as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        self.split = Splitter(path)
        pieces = piece_bytes(path)
        special = set(self.split.added.values())
        # merges rank as ids do here, so ids are ranks
        self.bpe = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks={b: i for i, b in pieces.items() if i not in special}, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        if word in self.split.added:
            return [self.split.added[word]]
        return self.bpe.encode_ordinary(word)

    def packed(self, text: str) -> bytes:
        cache, words = self.cache, self.split(text)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = np.array(self.word(w), "<u4").tobytes()
            return b"".join([cache[w] for w in words])


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def split_blocks(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """A block's words, in rows (key, block, places, words) by bucket, and its documents, in one row.

    A word's bucket is a hash of it, and the key of a row of words; places are sorted and stored as
    differences. The key of a row of documents is below zero; there places holds the documents' word
    places one after the other, and words their ids and numbers of words.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter, part, chars = Splitter(path), 0, 0
        vocab: dict[str, int] = {}
        rows: list = []
        places: list = []

        def filled(block: int) -> Iterator[pd.DataFrame]:
            seen = np.concatenate(places) if places else np.empty(0, "u4")
            order = np.argsort(-np.bincount(seen, minlength=len(vocab)), kind="stable")
            rank = np.empty(len(vocab), "u4")  # frequent words get small numbers, which compress better
            rank[order] = np.arange(len(vocab), dtype="u4")
            by: dict[int, list] = {}
            listed = list(vocab)
            for place, i in enumerate(order.tolist()):
                by.setdefault(zlib.crc32(listed[i].encode("utf-8", "surrogatepass")) % buckets, []).append((listed[i], place))
            keys = list(by)
            yield pd.DataFrame(
                {
                    "key": [-1 - block, *keys],
                    "block": block,
                    "places": [squeezed(rank[seen]), *(squeezed(np.diff([p for _, p in by[k]], prepend=0)) for k in keys)],
                    "words": [json.dumps(rows).encode(), *(zlib.compress(json.dumps([w for w, _ in by[k]], ensure_ascii=False).encode(), 3) for k in keys)],
                }
            )

        block = 0
        for batch in batches:
            for pid, doc_id, text in zip(batch["pid"], batch["doc_id"], batch["text"]):
                block = (int(pid) << 24) + part
                words = splitter(text)
                for w in words:
                    if w not in vocab:
                        vocab[w] = len(vocab)
                places.append(np.fromiter(map(vocab.__getitem__, words), "<u4", len(words)))
                rows.append((doc_id, len(words)))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from filled(block)
                    vocab, rows, places, chars, part = {}, [], [], 0, part + 1
        if rows:
            yield from filled(block)

    rows = docs.select(F.spark_partition_id().alias("pid"), F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(split, "key long, block long, places binary, words binary")


def encode_words(blocks: DataFrame, path: str) -> DataFrame:
    """The word table: gathers each bucket's words over all blocks, encodes each distinct one once.

    Returns (key, places, sizes, ids) with the key of the block's documents: for a block's words in
    the bucket, how many ids each has, and the ids.
    """

    def encode(key, rows: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder(path)
        table: dict[str, np.ndarray] = {}
        sizes, ids = [], []
        for data in rows["words"]:
            words = json.loads(zlib.decompress(data))
            for w in words:
                if w not in table:
                    table[w] = np.array(encoder.word(w), "<u4")
            found = [table[w] for w in words]
            sizes.append(squeezed([len(x) for x in found]))
            ids.append(squeezed(np.concatenate(found)))
        return pd.DataFrame({"key": -1 - rows["block"], "places": rows["places"], "sizes": sizes, "ids": ids})

    return blocks.groupBy("key").applyInPandas(encode, "key long, places binary, sizes binary, ids binary")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns one row per row of docs: doc_id, ids array<int>, decoded string. Null texts count as
    empty and have no ids; equal rows stay separate; other columns of docs are left aside; an empty
    table gives an empty one. A word costs one entry per block of BLOCK_CHARS characters, however
    often it is there; a bucket of the word table holds a word at most once per block, so frequent
    words make none larger.
    """
    spark = docs.sparkSession
    buckets = max(32, 4 * docs.rdd.getNumPartitions())
    blocks = split_blocks(docs, path, buckets).repartition("key")
    # floor(rand()) is 0, and keeps Spark from filtering before the shuffle: words and documents share it, so texts are split once
    words, payload = blocks.where(F.col("key") + F.floor(F.rand(0)) >= 0), blocks.where(F.col("key") + F.floor(F.rand(0)) < 0)
    coded = encode_words(words, path)
    shared = spark.sparkContext.broadcast(piece_bytes(path))  # one entry per id of the vocabulary

    def join(key, own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        pieces = shared.value
        home = np.concatenate([np.cumsum(unsqueezed(x), dtype="i8") for x in table["places"]] or [np.empty(0, "u4")])
        sizes = np.concatenate([unsqueezed(x) for x in table["sizes"]] or [np.empty(0, "u4")]).astype("i8")
        flat = np.concatenate([unsqueezed(x) for x in table["ids"]] or [np.empty(0, "u4")]).astype("i4")
        ends = np.cumsum(sizes)
        first, size = np.empty(len(home), "i8"), np.empty(len(home), "i8")
        first[home], size[home] = ends - sizes, sizes
        listed = flat.tolist()
        spelled = [b"".join([pieces[i] for i in listed[a : a + n]]) for a, n in zip(first.tolist(), size.tolist())]
        out = []
        for places, docs_ in zip(own["places"], own["words"]):
            places, at = unsqueezed(places), 0
            for doc_id, n in json.loads(docs_):
                mine, at = places[at : at + n], at + n
                lengths = size[mine]
                start = np.cumsum(lengths) - lengths
                ids = flat[np.arange(lengths.sum()) + np.repeat(first[mine] - start, lengths)]
                out.append((None if doc_id is None else int(doc_id), ids, b"".join([spelled[p] for p in mine.tolist()]).decode("utf-8", "replace")))
        return pd.DataFrame({"doc_id": pd.Series([o[0] for o in out], dtype="Int64"), "ids": [o[1] for o in out], "decoded": [o[2] for o in out]})

    return payload.groupBy("key").cogroup(coded.groupBy("key")).applyInPandas(join, "doc_id long, ids array<int>, decoded string")
