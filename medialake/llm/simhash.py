"""SimHash fingerprints of word shingles, linked by pivot distance tables.

A table of Hamming distances from each distinct fingerprint to reference fingerprints is computed once.
Pairs whose largest coordinate difference passes the threshold are discarded (the triangle inequality),
and only survivors are compared. No equality join on coordinates is selective: any fingerprint is 32 bits
from any pivot, give or take four. So fingerprints are first grouped under keys of three of six bit
blocks: two at most three bits apart share three whole blocks, so no link is lost. A large group is cut
by its first pivot coordinate into stripes of more bits than the threshold, of which only equal and
neighbouring ones meet. A group yields a spanning forest of its links, not its pairs.

keep_one() looks further: for five-word shingles and a Jaccard similarity of 0.8, whose fingerprints
differ in ten bits or so, groups share a band of minima of hash orders, the pivot tables discard with
a wide radius, and minima propose pairs. What proposed pairs connect is a family; inside a family the
shingle sets themselves are compared, and only they decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, saved, whole_text
from .graph import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, width)
#: A group of more rows is large; of a stripe, at most so many times as many (before chance) are in a chunk.
GROUP_ROWS = 512
CHUNKS_PER_GROUP = 4
PIVOTS = 16


def simhash(data: bytes, words_per_shingle: int = SHINGLE) -> int:
    """Bit b is set if over half of the shingles' XXH64 values have it; ASCII case is folded."""
    words = data.lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    if k == 3:
        h = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        h = [digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]
    bits = np.zeros(64, "i8")
    for i in range(0, len(h), 4096):
        part = np.array(h[i : i + 4096], "<u8").view("u1").reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; null texts count as empty."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([simhash(t, shingle) for t in batch["data"]], "u8").view("i8")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), whole_text().cast("binary").alias("data"))
    return rows.mapInPandas(score, "doc_id decimal(20,0), fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(n)], "u8")


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds ``table``: a byte per pivot, the Hamming distance of column fp to it."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pivots = pivot_fingerprints()
        for batch in batches:
            yield pd.Series([r.tobytes() for r in np.bitwise_count(batch.to_numpy("i8").view("u8")[:, None] ^ pivots)], dtype="object")

    return fps.withColumn("table", F.pandas_udf(run, "binary")("fp"))


def forest(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints, given their rows of the pivot table."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first, alive = np.ascontiguousarray(table[:, 0]), np.ones(len(fp), bool)
    us, vs = [], []
    for start in range(len(fp)):
        stack = [start] if alive[start] else []
        alive[start] = False
        while stack:
            i = stack.pop()
            lo, hi = np.searchsorted(first, first[i] - bits), np.searchsorted(first, first[i] + bits, "right")
            near = lo + np.flatnonzero(alive[lo:hi])
            near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= bits]
            alive[near] = False
            us.append(np.full(len(near), fp[i]))
            vs.append(fp[near])
            stack.extend(near.tolist())
    return np.concatenate(us or [fp[:0]]), np.concatenate(vs or [fp[:0]])


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links among distinct fingerprints (columns fp, table) that connect what pairs within bits connect."""
    if bits > len(BLOCKS) - 3:
        raise ValueError("the block keys find pairs of at most three differing bits")
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in BLOCKS]
    keys = []
    for n, (i, j, k) in enumerate(itertools.combinations(range(len(BLOCKS)), 3)):
        keys.append(((F.lit(n) * 2048 + parts[i]) * 2048 + parts[j]) * 2048 + parts[k])
    keyed = fps.select("fp", "table", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes what is exploded as if it weren't, and would broadcast millions of keys: these joins say that they sort
    rows = keyed.join(shared.hint("merge"), "key")
    # in a large group, chunks of the same stripe meet pair by pair, and those of neighbouring stripes; each meeting (g, a, b) is a group of its own
    large, stripe = F.col("n") > GROUP_ROWS, F.floor(F.conv(F.hex(F.substring("table", 1, 1)), 16, 10).cast("int") / (bits + 1)).cast("int")
    chunks = F.when(large, F.ceil(F.col("n") / (CHUNKS_PER_GROUP * GROUP_ROWS))).otherwise(1).cast("int")
    rows = rows.select("key", "fp", "table", F.when(large, stripe).otherwise(0).alias("stripe"), large.alias("large"), chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("own"))

    def meeting(g: Column, a: Column, b: Column) -> Column:
        return F.struct(g.alias("g"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    every, own, g = F.sequence(F.lit(0), F.col("chunks") - 1), F.col("own"), 2 * F.col("stripe")
    same = F.transform(every, lambda c: meeting(g, F.least(own, c), F.greatest(own, c)))
    beside = F.concat(F.transform(every, lambda c: meeting(g + 1, own, c)), F.transform(every, lambda c: meeting(g - 1, c, own)))
    rows = rows.select("key", "fp", "table", F.explode(F.when(F.col("large"), F.concat(same, beside)).otherwise(same)).alias("at")).select("key", "at.*", "fp", "table")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def linked(part: pd.DataFrame) -> pd.DataFrame:
            fp, table = part["fp"].to_numpy().view("u8"), np.frombuffer(b"".join(part["table"]), "u1").reshape(len(part), -1).astype("i2")
            key = part[group].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            two = starts[ends - starts == 2]
            x, y = fp[two], fp[two + 1]
            far = np.abs(table[two] - table[two + 1]).max(axis=1, initial=0)
            near = (far <= bits) & (np.bitwise_count(x ^ y) <= bits)
            us, vs = [x[near]], [y[near]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                u, v = forest(fp[s:e], table[s:e], bits)  # distinct: a fingerprint meets a chunk once
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            return pd.DataFrame({"u": u.view("i8"), "v": v.view("i8")}).drop_duplicates()

        for batch in batches:  # sorted by group; the last group of a batch may go on in the next
            held = batch if held is None else pd.concat([held, batch])
            done = (held[group] != held[group].iloc[-1]).any(axis=1).to_numpy()
            if done.any():
                yield linked(held[done])
                held = held[~done]
        if held is not None and len(held):
            yield linked(held)

    group = ["key", "g", "a", "b"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id that links of at most ``bits`` differing bits reach. Equal
    texts have equal fingerprints; texts without words have fingerprint 0 and are linked like any
    other; rows with a null doc_id take part and get the smallest known id of their component (null
    if it has none); repeated rows stay; an empty table gives an empty one.
    """
    rows = saved(fingerprints(docs, shingle))
    fps = saved(pivot_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    roots = components(links(fps, bits))
    classes = fps.join(roots.hint("merge"), F.col("node") == F.col("fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = classes.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(placed.hint("merge"), "fp").select("doc_id", "fp", "component_id")


# Near copies by shingle similarity: SimHash only discards, and signatures verify.

SIMILAR = 0.8
SIMILAR_WORDS = 5
#: Minima propose pairs of at least this estimate: four deviations below SIMILAR, so 1 in 20,000 pairs at 0.8 isn't proposed.
PROPOSED = 0.65
#: Minima of so many hash orders make a signature; equal ones estimate the Jaccard similarity of shingle sets.
ORDERS = 128
BANDS = 16
BAND_ORDERS = 4
#: Shingle sets of similarity 0.8 differ in 10 of 64 bits at the mean, with a deviation of 3.
RADIUS = 26
#: A larger group is cut into chunks of so many rows, and each pair of chunks is a group of its own.
ROWS_PER_STREAM = 2048
#: And of so many bytes of text, where texts are compared.
BYTES_PER_CHUNK = 8_000_000


def shingle_set(data: bytes, k: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted XXH64 values of the distinct k-word shingles; ASCII case is folded, fewer words are one shingle."""
    words = data.lower().split()
    k = max(1, min(k, len(words)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)], "u8"))


def signature(data: bytes, k: int = SIMILAR_WORDS) -> tuple[int, np.ndarray]:
    """(SimHash, ORDERS minima) of the distinct k-word shingles."""
    h = shingle_set(data, k)
    least = np.full(ORDERS, np.uint64(2**64 - 1))
    bits = np.zeros(64, "i8")
    for i in range(0, len(h), 2048):
        part = h[i : i + 2048]
        least = np.minimum(least, (part[:, None] * _ODD + _PLUS).min(axis=0))
        bits += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0]), least


def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, ORDERS, dtype="u8") | np.uint64(1), rng.integers(0, 2**64, ORDERS, dtype="u8")


_ODD, _PLUS = _orders()


def sketches(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest and size (of the text), fp, minima (16 bits each), keys: one per band of minima."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signature(t) for t in batch["data"]]
            keys = [[xxhash.xxh64_intdigest(least[b * BAND_ORDERS : (b + 1) * BAND_ORDERS].tobytes(), b) - 2**63 for b in range(BANDS)] for _, least in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "size": batch["data"].map(len), "fp": np.array([f for f, _ in found], "u8").view("i8"), "minima": [(least >> np.uint64(40)).astype("<u2").tobytes() for _, least in found], "keys": keys})

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), whole_text().cast("binary").alias("data")).withColumn("digest", F.md5("data"))
    rows = rows.mapInPandas(run, "doc_id decimal(20,0), digest string, size long, fp long, minima binary, keys array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("uid", F.monotonically_increasing_id())


def _in_pairs(rows: DataFrame, chunks: Column) -> DataFrame:
    """Cuts each group (key) into chunks by a hash of uid; each pair of chunks (a <= b) is a group of its own."""
    rows = rows.withColumns({"__own": F.pmod(F.xxhash64("uid"), chunks).cast("int"), "__other": F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1))})
    rows = rows.withColumns({"a": F.least("__own", "__other"), "b": F.greatest("__own", "__other")}).drop("__own", "__other")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, bounds) of whole groups of batches sorted by (key, a, b): group i is rows[bounds[i] : bounds[i + 1]]."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = held[["key", "a", "b"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(cut):
            yield held[: cut[-1]], np.concatenate([[0], cut])
            held = held[cut[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of n rows; near(i, others) are those of the others that are linked to i."""
    alive, us, vs = np.ones(n, bool), [], []
    for start in range(n):
        stack = [start] if alive[start] else []
        alive[start] = False
        while stack:
            i = stack.pop()
            found = np.flatnonzero(alive)
            found = near(i, found) if len(found) else found
            alive[found] = False
            us.append(np.full(len(found), i))
            vs.append(found)
            stack.extend(found.tolist())
    none = np.empty(0, "i8")
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def _linked(rows: DataFrame, similar: float) -> DataFrame:
    """(u, v): a spanning forest of the pairs near enough by pivots, fingerprints and minima, per group of (key, a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = pivot_fingerprints()
        for part, bounds in _whole(batches):
            uid, fp = part["uid"].to_numpy("i8"), part["fp"].to_numpy("i8").view("u8")
            table = np.bitwise_count(fp[:, None] ^ pivots).astype("i2")
            sign = np.frombuffer(b"".join(part["minima"]), "<u2").reshape(-1, ORDERS)
            us, vs = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):

                def near(i: int, j: np.ndarray, s: int = s) -> np.ndarray:
                    j = j[np.abs(table[s + j] - table[s + i]).max(axis=1, initial=0) <= RADIUS]
                    j = j[np.bitwise_count(fp[s + j] ^ fp[s + i]) <= RADIUS]
                    return j[(sign[s + j] == sign[s + i]).mean(axis=1) >= similar]

                u, v = spanning(e - s, near)
                us.append(uid[s + u])
                vs.append(uid[s + v])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()

    return rows.select("key", "a", "b", "uid", "fp", "minima").mapInPandas(run, "u long, v long")


def similar_classes(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(uid, root) of sketches() rows whose minima are similar, and what such links connect."""
    keyed = saved(rows.select("uid", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(shared, "key").join(rows.select("uid", "fp", "minima"), "uid")
    edges = _linked(_in_pairs(held, F.ceil(F.col("n") / ROWS_PER_STREAM)), similar)
    return components(edges).withColumnRenamed("node", "uid")


def alike(sets: list[np.ndarray], i: int, others: np.ndarray, similar: float) -> np.ndarray:
    """Those of the others whose shingle set has a Jaccard similarity of ``similar`` or more to that of i."""
    one, size = sets[i], np.array([len(sets[j]) for j in others], "i8")
    able = np.minimum(size, len(one)) >= similar * np.maximum(size, len(one)) - 0.5  # the sizes alone allow it
    others, size = others[able], size[able]
    if not len(others):
        return others
    shared = np.empty(len(others), "i8")
    for k, j in enumerate(others):
        at = np.searchsorted(one, sets[j])
        shared[k] = np.count_nonzero(one[np.minimum(at, len(one) - 1)] == sets[j]) if len(one) else 0
    union = len(one) + size - shared
    return others[np.where(union > 0, shared / np.maximum(union, 1), 1.0) >= similar]  # without words: alike


def verified(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(u, v): a spanning forest of the pairs of a family (key) whose shingle sets are similar, from uid, minima, data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in _whole(batches):
            us, vs = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                uid = part["uid"].to_numpy("i8")[s:e]
                sign = np.frombuffer(b"".join(part["minima"].iloc[s:e]), "<u2").reshape(-1, ORDERS)
                sets = [shingle_set(x) for x in part["data"].iloc[s:e]]

                def near(i: int, j: np.ndarray, sign: np.ndarray = sign, sets: list = sets) -> np.ndarray:
                    return alike(sets, i, j[(sign[j] == sign[i]).mean(axis=1) >= min(PROPOSED, similar)], similar)

                u, v = spanning(e - s, near)
                us.append(uid[u])
                vs.append(uid[v])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("n") / ROWS_PER_STREAM, F.col("bytes") / BYTES_PER_CHUNK, F.lit(1)))
    dealt = _in_pairs(rows.join(sizes, "key"), chunks)
    return dealt.select("key", "a", "b", "uid", "minima", "data").mapInPandas(run, "u long, v long")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of docs per group of near copies: of its smallest doc_id, null ones last.

    Equal texts are copies; so are texts whose sets of five-word shingles have a Jaccard similarity of
    ``similar`` or more, and what such links connect. Minima propose what is compared; the sets decide.
    Texts without words are copies of each other. Repeated rows come once; an empty table gives an
    empty one.
    """
    rows = saved(sketches(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("head")
    texts = saved(rows.groupBy("digest").agg(first).select("digest", F.col("head.doc_id").alias("doc_id"), F.col("head.uid").alias("uid")))
    own = saved(rows.join(texts.select("uid"), "uid", "left_semi").select("uid", "digest", "size", "fp", "minima", "keys"))
    families = similar_classes(own, min(PROPOSED, similar)).withColumnRenamed("root", "key")
    members = saved(own.drop("fp", "keys").join(families, "uid"))
    data = docs.select(F.md5(whole_text().cast("binary")).alias("digest"), whole_text().cast("binary").alias("data"))
    # copies are put together before the join, so that a large group of them is no hot key
    data = data.groupBy("digest").agg(F.first("data").alias("data")).join(members.select("digest"), "digest", "left_semi")
    edges = verified(members.join(data, "digest"), similar)
    placed = texts.join(components(edges).withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    head = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("head"))
    own, kept_id, kept = (free(c, docs) for c in ("digest", "id", "kept"))
    head = head.select(F.col("head.doc_id").alias(kept_id), F.col("head.digest").alias(kept))
    keyed = docs.withColumn(own, F.md5(whole_text().cast("binary")))
    picked = keyed.join(head, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept)))
    return picked.dropDuplicates([kept_id, kept]).select(*docs.columns)
