"""Language-model scoring by online logistic context mixing.

Bit predictors of the orders ONLINE learn within the text, bit by bit: their logits lie in slots that the last
bytes and the bits so far are hashed to. Those of the orders ORDERS start from the whole corpus: byte grams are
counted over all documents, and each gives what comes after its context. All logits are mixed with weights gated
by the bit's place in its byte; the weights learn after every bit, and an adaptive map refines the mixed
probability. The cost of all bits over the bytes is the score.

The counts are a partitioned table that grows with the corpus, keyed by the exact context, so no two contexts
ever share one. No task holds it whole: documents form groups of about GROUP_BYTES; each group sends its distinct
grams to the partitions of the table and gets their logits back.

Each text is coded from its first to its last byte with one online state. Texts of similar length are coded in
step, thousands at once, each in a lane of its own; a document's score depends on its own bytes and the corpus
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDERS = (3, 4)
#: Bits of a bit context's exact key: the order's bytes, then eight for the node. Its slot is this key.
SLOT_BITS = (32, 40)
#: Orders of the predictors that learn within the text.
ONLINE = (1, 2)
#: Bits of the number of groups, of 16 slots each, that such a predictor has; contexts that meet there share them.
ONLINE_BITS = 8
#: Texts coded in step, and bytes of each that are laid out at once; only speed and memory depend on them.
LANES, BLOCK = 1024, 16
#: Bytes of text whose documents look up their grams and are coded together.
GROUP_BYTES = 16 << 20
#: Texts below this power of two of bytes are grouped as if of one length, longer ones by the power of two below.
SHORT_BITS = 10
#: First weights: of the corpus's predictors, then of those that learn.
_START = (0.35, 0.4, 0.25, 0.25)
_BUCKETS = 24
#: Learning rates of the weights, of the online logits, and of the refining map.
_RATES, _MAP_RATE = np.array([[0.02], [0.5]], np.float32), np.float32(0.02)
_SCALE = 15.0
_HIGH = np.float32(_BUCKETS - 0.01)
#: Constants of a step as arrays without axes, which numpy takes faster than scalars.
_MIXES, _LEARNS = _RATES[0].reshape(()), _RATES[1].reshape(())
_DRAWS, _KEEPS, _UNIT, _ONE, _HALF = (np.array(x, np.float32) for x in (_MAP_RATE, np.float32(1) - _MAP_RATE, 1 / _SCALE, 1, 0.5))
_PER, _MIDDLE = np.array(_BUCKETS / 16, np.float32), np.array(_BUCKETS / 2, np.float32)
_SPREAD = np.uint64(1)
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
_FLOOR = np.float32(1 / 4096)
_TAG = 40


def _base(order: int, context: np.ndarray) -> np.ndarray:
    """Key of a context (its last bytes, as a 32-bit integer) in the table of its order, with the node still zero."""
    return (context.astype(np.uint64) & np.uint64((1 << (8 * order)) - 1)) << np.uint64(8)


def _gram(order: int, gram: np.ndarray) -> np.ndarray:
    """The last bytes of 5-grams: a context of that order and the byte after it."""
    return gram & ((1 << (8 * order + 8)) - 1)


def groups_of(context: np.ndarray, byte: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of slots of an online predictor for the first and the last four bits of ``byte`` after the ``context``.

    The context (its last bytes, as a 32-bit integer) is hashed to a group for the first four bits, with these four
    to another for the rest; within a group the bits so far tell the slot (:data:`_NODES`). Groups of first bits
    are even, the others odd, so the bits of one byte never share a slot.
    """
    h = (context + np.uint32(order << 24)) * np.uint32(0x9E3779B1)
    both = (h ^ ((byte >> 4).astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    shift, two = np.uint32(33 - ONLINE_BITS), np.uint32(2)
    return ((h >> shift) * two).astype(np.uint16), ((both >> shift) * two + np.uint32(1)).astype(np.uint16)


#: By group and four bits (16 * group + bits): the slots of these bits. By byte: its bits.
_CELLS = np.array([[16 * g + ((x | 16) >> (4 - j)) for j in range(4)] for g in range(1 << ONLINE_BITS) for x in range(16)], dtype=np.int64)
_BITS = np.array([[x >> (7 - j) & 1 for j in range(8)] for x in range(256)], dtype=np.float32)


def _lay_out(texts: list[bytes]) -> np.ndarray:
    """All texts in one array, four zero bytes before each."""
    return np.frombuffer(b"".join(x for t in texts for x in (b"\0\0\0\0", t)) + b"\0\0\0\0", dtype=np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct 5-grams of the partition's texts with their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal keys, counts
        k = np.concatenate([keys, *(x for x, _ in held)])
        c = np.concatenate([counts, *(x for _, x in held)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        keys, counts = k[first], np.add.reduceat(c, first) if len(first) else c
        held.clear()

    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            texts = [t for t in common.binary_rows(whole.slice(k, 1000).column("text")) if t]
            if not texts:
                continue
            a = _lay_out(texts)
            real = np.ones(len(a), dtype=bool)
            ends = np.cumsum([len(t) + 4 for t in texts])
            starts = np.concatenate([[0], ends])
            for j in range(4):
                real[starts + j] = False
            gram = np.zeros(len(a) - 4, np.int64)
            for j in range(5):
                gram = (gram << 8) | a[j : len(a) - 4 + j]
            gram = np.sort(gram[real[4:]])
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            held.append((gram[first], np.diff(np.append(first, len(gram)))))
            if sum(len(x) for x, _ in held) > 2_000_000:
                fold()
    fold()
    for k in range(0, len(keys), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 200_000]), pa.array(counts[k : k + 200_000])], ["gram", "n"])


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, the sums of n over each, and which of them each row has."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(n, first) if len(first) else n, np.cumsum(new) - 1


def _logits(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logits in 1/_SCALE of the eight nodes on the way to each gram's last byte; grams are sorted, contexts whole."""
    out = np.empty((len(grams), 8), np.int8)
    _, sums, which = _sums(grams >> 8, n)
    here = sums[which]
    for j in range(8):
        _, sums, which = _sums(grams >> (7 - j), n)
        below = sums[which]
        one = np.where((grams >> (7 - j)) & 1 == 1, below, here - below)
        p = (one + 0.4) / (here + 0.8)
        out[:, j] = np.clip(np.round(np.log(p / (1 - p)) * _SCALE), -127, 127)
        here = below
    return out


def _group_grams(docs: pa.Table) -> pa.Table:
    """(grp, key, n) of the distinct 4- and 5-grams of one group of documents; the key's top bits are the order."""
    found = pa.Table.from_batches(_count(iter(docs.to_batches())), pa.schema([("gram", pa.int64()), ("n", pa.int64())]))
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    keys, counts = [], []
    for order in ORDERS:
        g = _gram(order, gram)
        by = np.argsort(g, kind="stable")
        k, c, _ = _sums(g[by], n[by])
        keys.append(k | (order << _TAG))
        counts.append(c)
    key = np.concatenate(keys)
    group = docs.column("grp").slice(0, 1).to_numpy()
    return pa.table({"grp": np.full(len(key), group[0], np.int64), "key": key, "n": np.concatenate(counts)})


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, key, v) of rows (grp, key, n) sorted by key with contexts whole: the corpus's logits, eight bytes as one integer."""
    held: list[np.ndarray] = []
    size = 0

    def out(a: np.ndarray) -> pa.RecordBatch:
        keys, n, which = _sums(a[1], a[2])
        v = _logits(keys, n).view(np.int64)[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(v[which])], ["grp", "key", "v"])

    for b in batches:
        held.append(np.stack([b.column(c).to_numpy() for c in ("grp", "key", "n")]))
        size += b.num_rows
        if size >= 200_000:
            a = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(a[1], (a[1, -1] >> 8) << 8))  # the last context may go on
            if cut:
                yield out(a[:, :cut])
            held, size = [a[:, cut:]], a.shape[1] - cut
    if size:
        yield out(np.concatenate(held, axis=1))


class Table:
    """Logits of bit contexts by their exact keys, 0 where the corpus has none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values

    def __getitem__(self, key: int | np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(np.shape(key), np.int8)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.values[i], np.int8(0))

    def rows(self, gram: np.ndarray) -> np.ndarray:
        """Logits on the way to each 5-gram's last byte, by order, gram and bit."""
        out = np.empty((len(ORDERS), len(gram), 8), np.int8)
        for i, order in enumerate(ORDERS):
            base = _base(order, (gram >> 8).astype(np.uint32)).astype(np.int64) + _OFFSETS[i]
            for j in range(8):
                out[i, :, j] = self[base + (((gram & 255) | 256) >> (8 - j))]
        return out


class Group:
    """Logits that one group of documents has looked up: of each gram that it has, nothing else."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]

    def grams(self) -> np.ndarray:
        """The group's distinct 5-grams."""
        return self.keys[np.searchsorted(self.keys, ORDERS[-1] << _TAG) :] & ((1 << _TAG) - 1)

    def rows(self, gram: np.ndarray) -> np.ndarray:
        """Logits on the way to each 5-gram's last byte, by order, gram and bit."""
        out = np.empty((len(ORDERS), len(gram)), np.int64)
        for i, order in enumerate(ORDERS):
            key = _gram(order, gram) | (order << _TAG)
            at = np.searchsorted(self.keys, key)
            if len(key) and (at[-1] >= len(self.keys) or not np.array_equal(self.keys[np.minimum(at, len(self.keys) - 1)], key)):
                raise ValueError("a gram of the documents wasn't counted: the input changed between two reads")
            out[i] = self.values[at]
        return out.view(np.int8).reshape(len(ORDERS), len(gram), 8)


def train(docs: DataFrame) -> Table:
    """The whole table in one place, to score texts that aren't in the corpus; ``score`` never gathers it."""
    grams = docs.select("text").where("text is not null").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = grams.orderBy("gram").toArrow()
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    keys, values = [], []
    for i, order in enumerate(ORDERS):
        g = _gram(order, gram)
        by = np.argsort(g, kind="stable")
        k, c, _ = _sums(g[by], n[by])
        node = ((k & 255) | 256)[:, None] >> (8 - np.arange(8))
        key, first = np.unique(((k >> 8) << 8)[:, None] + node + _OFFSETS[i], return_index=True)
        keys.append(key)
        values.append(_logits(k, c).ravel()[first])
    return Table(np.concatenate(keys), np.concatenate(values))


class _Places:
    """Places of integers in an array of distinct ones, by open addressing; every key is compared in full."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for one that isn't there."""
        at = self._first(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        lost = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[lost]
        while len(lost):
            at = (at + 1) & self.mask
            out[lost] = self.slots[at]
            still = (out[lost] >= 0) & (self.keys[out[lost]] != keys[lost])
            lost, at = lost[still], at[still]
        return out


class Coder:
    """Codes texts in step."""

    def __init__(self, table: Table | Group) -> None:
        self.table = table

    def _placed(self, a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of distinct 5-grams by order, eight as one integer, and which gram ends in each of the laid out bytes."""
        step = 1 << 20

        def grams(k: int) -> np.ndarray:
            part = np.concatenate([np.zeros(max(0, 4 - k), np.uint8), a[max(0, k - 4) : k + step]])
            g = np.zeros(len(part) - 4, np.int64)
            for j in range(5):
                g = (g << 8) | part[j : len(part) - 4 + j]
            return g

        if isinstance(self.table, Group):
            keys = self.table.grams()
        else:
            keys = np.unique(np.concatenate([np.unique(grams(k)) for k in range(0, len(a), step)]))
        places, which = _Places(keys), np.empty(len(a), np.int32)
        for k in range(0, len(a), step):
            which[k : k + step] = places.of(grams(k))
        for j in range(1, 5):
            which[starts - j] = which[len(a) - j] = 0  # what lies between texts is never coded
        if len(keys) and which.min() < 0:
            raise ValueError("a gram of the documents wasn't counted: the input changed between two reads")
        return self.table.rows(keys).view(np.int64)[:, :, 0], which

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text."""
        a = _lay_out(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes + 4) - sizes
        if not sizes.any():
            return np.zeros(len(texts))
        logits, which = self._placed(a, starts)
        cost = np.zeros(len(texts))
        order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        for k in range(0, len(order), LANES):
            part = order[k : k + LANES]
            cost[part] = self._lanes(a, logits, which, starts[part], sizes[part])
        return cost

    def _lanes(self, a: np.ndarray, logits: np.ndarray, which: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bits of texts of falling length: in each step one byte of every text that has it.

        The eight bits of a byte have weights and online slots of their own, so they are mixed at once; only
        the refining map goes bit by bit. A byte's bits lie side by side, so its slots are read a cache line a group;
        the map has its bits one after the other. A text that ends within a block goes on to the block's end with
        what follows it, uncounted.
        """
        lanes, k, online = len(first), len(ORDERS), len(ONLINE)
        f, before = np.float32, max(ONLINE)
        weights = np.empty((k + online, lanes, 8), f)
        weights[:] = np.array(_START, f)[:, None, None]
        size = 16 << ONLINE_BITS
        own = np.zeros(online * lanes * size, f)  # by predictor, text, slot: a byte of a text touches two cache lines
        middle = (np.arange(_BUCKETS, dtype=np.float64) + 0.5) / _BUCKETS * 16 - 8
        refine = np.repeat((1 / (1 + np.exp(-middle))).astype(f), lanes)  # by bucket, then text: most lie in few buckets
        row, width = np.arange(lanes), np.array(lanes, f)
        cost = np.zeros(lanes)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if lanes else 0), side="left").tolist()
        m = -1
        for s in range(0, len(active), BLOCK):
            if active[s] != m:  # texts have ended: narrower buffers
                m = active[s]
                z, zw, xs = np.empty((k + online, m, 8), f), np.empty((k + online, m, 8), f), np.empty((1 + online, m, 8), f)
                known, learnt, found, ones = z[:k], z[k:], np.empty((k, m), np.int64), np.empty((m, 8), f)
                mine, rows, w = np.empty((online, m, 8), np.int64), row[:m], weights[:, :m]
                cells, eights = mine.reshape(online, m, 2, 4), found.view(np.int8).reshape(k, m, 8)
                place = np.repeat((np.arange(online)[:, None] * lanes + rows) * size, 8, axis=1).reshape(online, m, 8)
                x, p, q, bit, drawn = (np.empty((8, m), f) for _ in range(5))
                cell, step, chance = np.empty((8, m), np.int64), np.empty(m, f), np.empty(m, f)
                lowest, highest, least = (np.full((8, m), v, f) for v in (0, _HIGH, _FLOOR))
                texts = np.tile(rows.astype(f), (8, 1))
                by_bit = list(zip(cell, q, drawn, strict=True))
            at = np.minimum(first[:m] + np.arange(s - before, s + BLOCK)[:, None], len(a) - 1)
            seen, grams = a.take(at), which.take(at[before:])
            bytes_, context = seen[before:], np.zeros((BLOCK, m), np.uint32)
            slots = np.empty((BLOCK, online, m, 2), np.uint16)
            for j in range(1, before + 1):
                context |= seen[before - j : -j].astype(np.uint32) << np.uint32(8 * j - 8)
                if j in ONLINE:
                    high, low = groups_of(context, bytes_, j)
                    slots[:, ONLINE.index(j), :, 0] = (high << np.uint16(4)) | (bytes_ >> 4)
                    slots[:, ONLINE.index(j), :, 1] = (low << np.uint16(4)) | (bytes_ & 15)
            for byte, gram, slot, now in zip(bytes_, grams, slots, active[s : s + BLOCK]):
                _BITS.take(byte, 0, ones, "clip")
                for i in range(k):
                    logits[i].take(gram, None, found[i], "clip")
                np.multiply(eights, _UNIT, out=known)
                _CELLS.take(slot, 0, cells, "clip")
                np.add(mine, place, out=mine)
                own.take(mine, None, learnt, "clip")
                np.multiply(w, z, out=zw)
                np.add.reduce(zw, axis=0, out=xs[0])
                x[:] = xs[0].T
                np.negative(xs[0], out=xs[0])
                np.negative(learnt, out=xs[1:])
                np.exp(xs, out=xs)
                xs += _ONE
                np.reciprocal(xs, out=xs)  # probability of a one: mixed, and by what the text itself taught
                p[:] = xs[0].T
                np.subtract(ones, xs, out=xs)
                xs[0] *= _MIXES
                xs[1:] *= _LEARNS
                np.multiply(z, xs[0], out=zw)
                w += zw
                learnt += xs[1:]
                own[mine] = learnt
                x *= _PER
                x += _MIDDLE
                np.maximum(x, lowest, out=x)
                np.minimum(x, highest, out=x)
                np.trunc(x, out=x)
                x *= width
                x += texts
                cell[:] = x  # whole numbers below 2^24, exact as floats
                bit[:] = ones.T
                np.multiply(bit, _DRAWS, out=drawn)
                for c, refined, d in by_bit:
                    refine.take(c, None, refined, "clip")
                    np.multiply(refined, _KEEPS, out=step)
                    step += d
                    refine[c] = step
                p += q
                p *= _HALF
                np.subtract(_ONE, bit, out=bit)
                p -= bit
                np.abs(p, out=p)  # what the bit that came had been given
                np.maximum(p, least, out=p)
                np.multiply.reduce(p, axis=0, out=chance)
                cost[:now] -= np.log2(chance[:now])
        return cost


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, grp): groups of about GROUP_BYTES and similar length, which follow from the row: each read has the same."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    power = F.greatest(F.lit(SHORT_BITS), F.floor(F.log2(F.greatest(size, F.lit(1))))).cast("int")
    totals = docs.groupBy(power.alias("power")).agg(F.sum(size).alias("n")).collect()
    if not totals:
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias("grp"))
    parts = F.create_map(*[F.lit(x) for r in totals for x in (r["power"], -(-r["n"] // GROUP_BYTES) or 1)])
    return docs.select("doc_id", "text", (F.shiftleft(power.cast("long"), 40) + F.pmod(F.xxhash64("doc_id", "text"), parts[power])).alias("grp"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row.

    A null or empty text has no bytes, no bits and null bits_per_byte. Repeated rows get equal results, each
    its own row, and count as often as they come; texts are coded whole. Rows of equal scores are in no order. Empty
    input gives no rows; further columns are ignored.
    """
    groups = _grouped(docs)
    counted = groups.where("text is not null").groupBy("grp").applyInArrow(_group_grams, "grp long, key long, n long")
    placed = counted.withColumn("c", F.shiftright("key", 8)).repartition("c").sortWithinPartitions("key").select("grp", "key", "n")
    looked = placed.mapInArrow(_looked_up, "grp long, key long, v long")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts = [t or b"" for t in common.binary_rows(rows.column("text"))]
        bits = np.round(Coder(Group(found.column("key").to_numpy(), found.column("v").to_numpy())).bits(texts), 3)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        per = pa.array(bits / np.maximum(n, 1), mask=n == 0)
        return pa.table([rows.column("doc_id"), pa.array(n), pa.array(bits), per], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return groups.groupBy("grp").cogroup(looked.groupBy("grp")).applyInArrow(run, f"doc_id {kind}, n_bytes long, bits double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
