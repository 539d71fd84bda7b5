"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so a cosine is a distance; equal ones are one vector from then on. A table's key is the hash
of several WIDTH-quantised random projections; projections a table and the number of tables follow from the number
of vectors and their mean (:func:`plan`): about CROWD unrelated vectors share a key with a vector, and a pair at the
least cosine shares one with probability RECALL. Only keys, ids and short sketches are shuffled. Within a key,
sketches (signs of SKETCH other projections) tell which vectors may be near; these alone get their vectors back, once
for each different set of them, and are compared by exact cosine in a breadth-first search whose output is linear.
Groups are the connected components of the pairs found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups

LEAST_COSINE = 0.95
RECALL = 0.98
WIDTH = 2.0
#: Unrelated vectors that may share a key with a vector, on average: each costs a comparison of sketches.
CROWD = 1000
SKETCH = 128
#: Standard deviations by which the sketches of a pair at the least cosine may differ more than expected.
_DEVIATIONS = 5.5
_SEED = 77


def _collide(distance: float) -> float:
    """Probability that one quantised projection is equal for two points at this distance."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def _crowd(n: int, k: int, mean: float, size: int, least: float) -> float:
    """Unrelated vectors that share all of k quantised projections: cosines around the mean, as wide as random directions'."""
    spread = math.sqrt(max(1 - mean * mean, 1e-9) / max(size, 1))
    at = np.linspace(-4, 4, 33)
    weight = np.exp(-at * at / 2)
    cosine = np.clip(mean + spread * at, -1.0, least)
    chance = np.array([_collide(math.sqrt(max(2 - 2 * c, 1e-9))) ** k for c in cosine])
    return n * float((weight * chance).sum() / weight.sum())


def plan(n: int, least: float = LEAST_COSINE, mean: float = 0.0, size: int = 64) -> tuple[int, int]:
    """Projections a table and tables for n vectors of a size; ``mean`` is their mean cosine, that of all pairs.

    Both grow with the logarithm and a small power of n, so that comparisons a vector stay the same.
    """
    near, k = _collide(math.sqrt(2 - 2 * least)), 2
    while k < 60 and _crowd(n, k, min(mean, least), size, least) > CROWD:
        k += 1
    return k, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def _furthest(least: float) -> int:
    """Most bits in which the sketches of a pair at the least cosine differ, but for a chance of some 10^-8."""
    p = math.acos(least) / math.pi
    return math.ceil(SKETCH * p + _DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their normalised vectors) by length, of those that are usable: not null or zero, no null, NaN or infinity in them."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = flat[start[at][:, None] + np.arange(d)]
        most = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (most > 0)
        x = x[ok] / most[ok, None]  # no overflow in the norm
        yield at[ok], x / np.linalg.norm(x, axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, v): normalised vectors as 32-bit floats and the digest that equal ones share, null where unusable."""
    for b in _slices(batches):
        v: list[bytes | None] = [None] * b.num_rows
        for at, x in _units(b.column("embedding")):
            for i, row in zip(at.tolist(), x.astype(np.float32)):
                v[i] = row.tobytes()
        digest = [None if x is None else xxhash.xxh3_128_digest(x) for x in v]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "digest", "v"])


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of vectors of each length."""
    raw = column.to_pylist()
    sizes = np.array([len(x) // 4 for x in raw], dtype=np.int64)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.float32).reshape(len(at), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, i, n, s): the number of vectors of each length and the sum of each coordinate."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for b in _slices(batches):
        for at, x in _by_size(b.column("v")):
            n, s = found.get(x.shape[1], (0, 0.0))
            found[x.shape[1]] = n + len(at), s + x.sum(axis=0, dtype=np.float64)
    for d, (n, s) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(s)], ["size", "i", "n", "s"])


def _keys(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, ...]] = {}
        for b in _slices(batches):
            for at, v in _by_size(b.column("v")):
                d = v.shape[1]
                if d not in drawn:
                    rng = np.random.default_rng([_SEED, d])
                    drawn[d] = rng.standard_normal((d, k * tables)), rng.random(k * tables) * WIDTH, rng.integers(1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=tables, dtype=np.uint64), rng.standard_normal((d, SKETCH))
                a, shift, mix, table, signs = drawn[d]
                x = v.astype(np.float64)
                q = np.floor((x @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(at), tables, k)
                code = ((q + np.uint64(97)) * mix).sum(axis=2, dtype=np.uint64) ^ table
                code ^= code >> np.uint64(31)
                code *= np.uint64(0x94D049BB133111EB)
                code ^= code >> np.uint64(29)
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                each = np.repeat(np.arange(len(at)), tables)
                ids = b.column("vec_id").take(pa.array(at[each]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(code.reshape(-1).view(np.int64)), pa.array(sketch[each, 0]), pa.array(sketch[each, 1])], ["vec_id", "key", "s0", "s1"])

    return run


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether sketches of a and b differ in at most so many bits."""
    x = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0])
    x += np.bitwise_count(a[:, 1][:, None] ^ b[:, 1])
    return x <= most


def _spans(size: int, linked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that span each component of rows 0..size-1; linked(rows, others) says which of them are linked."""
    left = np.arange(size)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.full(len(left), -1)
            for k in range(0, len(front), 512):
                part = front[k : k + 512]
                hit = linked(part, left)
                any_hit = hit.any(axis=0) & (reached < 0)
                reached[any_hit] = part[hit.argmax(axis=0)[any_hit]]
            new = reached >= 0
            if new.any():
                yield reached[new], left[new]
            front, left = left[new], left[~new]


def _sets(sketches: np.ndarray, most: int) -> list[np.ndarray]:
    """Components of two or more rows whose sketches are near, of the rows of one key."""
    with_mate = np.zeros(len(sketches), dtype=bool)
    for k in range(0, len(sketches), 256):
        part = slice(k, k + 256)
        with_mate[part] = _near(sketches[part], sketches, most).sum(axis=1) > 1  # one is the row itself
    rows = np.flatnonzero(with_mate)
    x = sketches[rows]
    root = np.arange(len(rows))
    for a, b in _spans(len(rows), lambda i, j: _near(x[i], x[j], most)):
        root[b] = root[a]  # a is a component's first row, or was reached from it before
    order = np.argsort(root, kind="stable")
    return [rows[part] for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(part) > 1]


def _mates(most: int):
    """(g, vec_id): sets of ids that may be near, from rows sorted by key; g is the set's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole_runs(batches, "key"):
            keys = t.column("key").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            ids = t.column("vec_id").combine_chunks()
            sketches = np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], axis=1).view(np.uint64)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if high - low < 2:
                    continue
                for at in _sets(sketches[low:high], most):
                    own = ids.take(pa.array(at + low))
                    own = own.take(pc.sort_indices(own))
                    g = xxhash.xxh3_128_digest("|".join(map(str, own.to_pylist())).encode("utf-8", "surrogatepass"))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.binary()), own], ["g", "vec_id"])

    return run


def _verify(least: float):
    """(a, b): pairs of at least the cosine that span the components of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole_runs(batches, "g"):
            names = t.column("g").to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            ids, v = t.column("vec_id").combine_chunks(), t.column("v").combine_chunks()
            found_a, found_b = [], []
            for low, high in zip(cuts, cuts[1:]):
                for at, x in _by_size(v[low:high]):
                    for a, b in _spans(len(at), lambda i, j, x=x: x[i] @ x[j].T >= least):
                        found_a.append(at[a] + low)
                        found_b.append(at[b] + low)
            if found_a:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(found_a))), ids.take(pa.array(np.concatenate(found_b)))], ["a", "b"])

    return run


def linked(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(a, b) ids of near vectors, from distinct rows (vec_id, v); a written table, read several times."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    sums = vectors.select("v").mapInArrow(_sums, "size int, i int, n long, s double").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # the square of the mean vector is the mean cosine of all pairs
    most = sums.groupBy("size").agg(F.max("n").alias("n"), F.sum(F.pow(F.col("s") / F.col("n"), 2)).alias("mean")).orderBy(F.col("n").desc(), "size").first()
    if most is None:
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    k, tables = plan(most["n"], least, most["mean"], most["size"])
    keyed = vectors.mapInArrow(_keys(k, tables), f"vec_id {kind}, key long, s0 long, s1 long")
    sets = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_mates(_furthest(least)), f"g binary, vec_id {kind}")
    sets = common.stage(sets.distinct(), "embed-sets")  # one set is mostly found in several tables
    filled = sets.join(vectors, "vec_id").repartition("g").sortWithinPartitions("g", "vec_id").select("g", "vec_id", "v")
    return filled.mapInArrow(_verify(least), f"a {kind}, b {kind}")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, group_id, group_size, keep) of every row.

    group_id is the least vec_id of the group, whose first row is kept. Null, empty, zero and non-finite
    vectors match nothing and are kept; vectors of different lengths don't match. Vectors of one direction are
    equal. Rows with one vec_id are one group, of which one row is kept; rows with a null vec_id can't be named
    and are kept, unmatched. A cosine of just ``least`` is near; there are no other ties. Empty input gives no
    rows; further columns are ignored.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    named = vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(_named, f"vec_id {kind}, digest binary, v binary")
    reps = common.stage(named.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v")), "embed-distinct")
    counted = named.groupBy("vec_id", "digest").agg(F.count("*").alias("n")).join(reps.select("digest", F.col("vec_id").alias("rep")), "digest", "left")
    counted = common.stage(counted.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), "n"), "embed-counted")
    ids = counted.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("rep").alias("first"))
    several = counted.join(ids.select("vec_id", "first"), "vec_id").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    found = common.stage(groups.components(linked(reps.select("vec_id", "v"), least).unionByName(several)), "embed-groups")
    rooted = ids.join(common.checked(found, 64), F.col("first") == F.col("node"), "left").select("vec_id", "n", F.coalesce("root", "first").alias("group_id"))
    rooted = common.stage(rooted, "embed-rooted")
    sizes = rooted.groupBy("group_id").agg(F.sum("n").alias("group_size"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    out = rooted.join(sizes, "group_id").select("vec_id", "group_id", "group_size", each.alias("i")).select("vec_id", "group_id", "group_size", ((F.col("vec_id") == F.col("group_id")) & (F.col("i") == 1)).alias("keep"))
    return out.unionByName(vectors.where("vec_id is null").select("vec_id", F.col("vec_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
