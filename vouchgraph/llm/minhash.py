"""MinHash near-dedup with an LSH forest.

A text's word bigrams (lower case, outer punctuation off) give a signature of TREES * DEPTH minima. Each tree
is one order of DEPTH of them: rows are sorted by it, and rows with a common prefix of at least FIRST values
form a region. In a region of up to REGION rows all pairs are candidates; a larger one goes one value deeper,
part by part, and keeps the neighbours across the parts' borders, so dense regions are searched deeper than
sparse ones and the number of candidates stays linear. Candidates whose whole signatures agree in at least
AGREE of their values are copies; groups are the connected components, exact copies included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups

TREES = 16
DEPTH = 8
FIRST = 3
REGION = 16
AGREE = 0.5
VALUES = TREES * DEPTH
_TRIM = ".,;:!?\"'()[]"
_rng = np.random.default_rng(20_240_601)
_XOR = _rng.integers(1 << 32, size=VALUES, dtype=np.uint32)
_MUL = _rng.integers(1 << 31, size=VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MEMO_ENTRIES = 400_000


def _code(token: bytes) -> int:
    word = token.decode("utf-8", "replace").lower().strip(_TRIM)
    return (xxhash.xxh64_intdigest(word) or 1) if word else 0


def shingles(text: bytes) -> np.ndarray:
    """32-bit hashes of a text's word bigrams; of its only word if it has one."""
    memo = common.worker_state("minhash", dict)
    get = memo.get
    tokens = text.split()
    codes = [get(t) for t in tokens]
    if None in codes:
        if len(memo) > _MEMO_ENTRIES:
            memo.clear()
        for i, c in enumerate(codes):
            if c is None:
                t = tokens[i]
                codes[i] = memo[t] = _code(t)
    c = np.array(codes, dtype=np.uint64)
    c = c[c != 0]
    if len(c) > 1:
        c = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
    c ^= c >> np.uint64(29)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    return (c >> np.uint64(32)).astype(np.uint32)


def signature(text: bytes) -> bytes | None:
    """VALUES big-endian minima; None for a text without words."""
    h = shingles(text)
    if not len(h):
        return None
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(h), 1024):
        x = h[None, k : k + 1024] ^ _XOR[:, None]
        x *= _MUL[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return least.astype(">u4").tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            b = whole.slice(k, 2000)
            texts = common.binary_rows(b.column("text"))
            sums = [None if t is None else hashlib.md5(t).digest() for t in texts]
            known: dict[bytes | None, bytes | None] = {None: None}
            for s, t in zip(sums, texts):
                if s not in known:
                    known[s] = signature(t)
            sigs = [known.pop(s, None) for s in sums]  # with a text's first row; its others have the digest alone
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sums, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "sig"])


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _region(low: int, high: int, depth: int, shared: np.ndarray, out: list[np.ndarray]) -> None:
    """Candidate pairs of rows low..high-1, which share ``depth`` values; shared[i]: what row i shares with the one before."""
    todo = [(low, high, depth)]
    while todo:
        low, high, depth = todo.pop()
        n = high - low
        if n <= REGION:
            a, b = np.triu_indices(n, 1)
            out.append(np.stack([a + low, b + low]))
        elif depth == DEPTH:  # one order of values for all: a star and a chain join them
            i = np.arange(low + 1, high)
            out.append(np.stack([np.full(n - 1, low), i]))
            out.append(np.stack([i - 1, i]))
        else:
            cuts = np.flatnonzero(shared[low + 1 : high] == depth) + low + 1
            if len(cuts):
                out.append(np.stack([cuts - 1, cuts]))
            edges = [low, *cuts.tolist(), high]
            todo += [(x, y, depth + 1) for x, y in zip(edges, edges[1:]) if y - x > 1]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in groups.whole_runs(batches, "region"):
        labels = np.frombuffer(b"".join(t.column("label").to_pylist()), dtype=">u4").reshape(-1, DEPTH)
        nodes = t.column("digest").combine_chunks()
        trees = t.column("tree").to_numpy()
        same = (labels[1:] == labels[:-1]) & (trees[1:] == trees[:-1])[:, None]
        shared = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])
        starts = np.flatnonzero(shared < FIRST)
        ends = np.append(starts[1:], len(shared))
        out: list[np.ndarray] = []
        for i in np.flatnonzero(ends - starts > 1).tolist():
            _region(int(starts[i]), int(ends[i]), FIRST, shared, out)
        if out:
            pairs = np.concatenate(out, axis=1)
            for k in range(0, pairs.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(pairs[0, k : k + 100_000])), nodes.take(pa.array(pairs[1, k : k + 100_000]))], ["a", "b"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 5000):
            p = b.slice(k, 5000)
            x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), dtype=np.uint32).reshape(-1, VALUES) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE))


def signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, digest, n), the rows counted by id and text, and staged (digest, sig) of the distinct texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = common.stage(docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {kind}, digest binary, sig binary"), "minhash")
    texts = rows.where("digest is not null").groupBy("digest").agg(F.first("sig", ignorenulls=True).alias("sig"))
    return common.stage(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "minhash-rows"), common.stage(texts, "minhash-texts")


def copies(texts: DataFrame) -> DataFrame:
    """(a, b) digests of the distinct ``texts`` (digest, sig) that are near copies of each other."""
    width = 4 * DEPTH
    trees = texts.where("sig is not null").select("digest", F.posexplode(F.array(*[F.expr(f"substring(sig, {t * width + 1}, {width})") for t in range(TREES)])).alias("tree", "label"))
    region = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(label, 1, {4 * FIRST})"))
    ordered = trees.select("tree", "label", "digest", region.alias("region")).repartition("region").sortWithinPartitions("tree", "label", "digest")
    pairs = ordered.mapInArrow(_candidates, "a binary, b binary")
    pairs = common.stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-pairs")
    ends = common.stage(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), "minhash-ends")
    sigs = common.stage(texts.join(common.checked(ends, 64), "digest", "left_semi"), "minhash-ends")
    x = sigs.select(F.col("digest").alias("a"), F.col("sig").alias("x"))
    y = sigs.select(F.col("digest").alias("b"), F.col("sig").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_agree, "a binary, b binary")


def grouped(docs: DataFrame) -> DataFrame:
    """Staged (doc_id, digest, n, group_id, group_size, first) of the rows by id and text; first: one of these n stays.

    Groups are put together by aggregations and joins by digest: a text that comes a million times is one row of
    the forest, and no task holds its documents at once. Rows without text have a null digest and are left out.
    """
    rows, texts = signed(docs)
    found = common.stage(groups.components(copies(texts)), "minhash-groups")
    # of each text the number of rows and the first id, nulls last
    own = rows.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first_id"))
    own = common.stage(own.join(common.checked(found, 96), F.col("digest") == F.col("node"), "left").select("digest", "n", "first_id", F.coalesce("root", "digest").alias("root")), "minhash-texts-in-groups")
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest"))
    whole = own.groupBy("root").agg(F.sum("n").alias("group_size"), best.alias("best"))
    of_text = common.stage(own.select("digest", "root").join(whole, "root").select(F.col("digest").alias("d"), "group_size", F.col("best.first_id").alias("group_id"), F.col("best.digest").alias("of")), "minhash-whole-groups")
    first = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("group_id"))
    return common.stage(rows.join(of_text, F.col("digest") == F.col("d")).select("doc_id", "digest", "n", "group_id", "group_size", first.alias("first")), "minhash-places")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every row.

    group_id is the least doc_id of the group; one row of a group is kept: that of the least doc_id, nulls
    last, then the least digest. Byte-equal texts are copies, empty ones too, and repeated rows; a null text
    copies nothing (a group of its own, kept). A text without words has only exact copies. Texts are read
    whole. Empty input gives no rows; further columns are ignored.
    """
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")
    some = grouped(docs).select("doc_id", "group_id", "group_size", "first", each).select("doc_id", "group_id", "group_size", (F.col("first") & (F.col("i") == 1)).alias("keep"))
    none = docs.where("text is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return some.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps.

    Dropped rows are found by (doc_id, digest): the list is broadcast if its counted size allows it. Rows that
    repeat a kept one exactly in both are reduced to one. Null texts all stay; empty texts are copies of each other.
    Ties, repeated rows, very long texts, an empty table and extra columns are as :func:`near_duplicates` has them.
    """
    keys = common.stage(grouped(docs).where("not first or n > 1").select(F.col("doc_id").alias("__m_id"), F.col("digest").alias("__m_digest"), "first"), "minhash-drop")
    on = docs["doc_id"].eqNullSafe(F.col("__m_id")) & (_digest() == F.col("__m_digest"))
    kept = docs.join(common.checked(keys.drop("first"), 96), on, "left_anti")
    again = keys.where("first").drop("first")
    if again.isEmpty():
        return kept
    once = docs.join(common.checked(again, 96), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
