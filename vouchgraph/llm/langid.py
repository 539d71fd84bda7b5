"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language, over the lower-case letters of words between word boundaries. Its
n-grams are 64-bit hashes in sorted arrays, one array an order, with a column of discounted probabilities
and of back-off weights for each language. A document goes to the language of the lowest cross-entropy per
character; it is rejected if that entropy is above what held-out documents of the language and of this
length show (level REJECT). Models are fitted on about PER_LANGUAGE labelled documents a language, chosen by
a hash of the id; a fifth of these is held out for the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Expected number of labelled documents a language; the models see four fifths of them.
PER_LANGUAGE = 1000
#: Expected number of other labelled documents a language that calibrate rejection, where there are as many.
HELD_OUT = 3000
#: Part of the held-out documents that may be rejected.
REJECT = 0.001
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, ORDER + 1)]
_EDGE = 2  # code of a word boundary; no letter has it
_MEMO_ENTRIES = 300_000


def letters(token: str) -> str:
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Code points of edge+word+edge, each one's place in its word, the words' sizes, and H[k-1]: hash of the k-gram that ends there."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(("\x02" + "\x02\x02".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    one = flat + np.uint64(1)
    found = [one * _POWERS[0]]
    for k in range(1, ORDER):
        h = found[-1].copy()
        h[k:] += one[:-k] * _POWERS[k]
        found.append(h)
    return flat, place, sizes, found


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes
    prob: list[np.ndarray]  # [n-gram, language]: discounted probability
    back: list[np.ndarray]  # [n-gram, language]: weight of the lower order after this context
    empty: np.ndarray  # the same for the empty context
    uniform: float
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))  # mean, a, b, z by language

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Thousandths of a bit of each word in each language, and the number of characters predicted."""
        out, size = np.zeros((len(words), len(self.langs)), np.int64), np.zeros(len(words), np.int64)
        some = [i for i, w in enumerate(words) if w]
        for k in range(0, len(some), 20_000):
            part = some[k : k + 20_000]
            flat, place, sizes, h = _hashes([words[i] for i in part])
            at = np.flatnonzero(place > 0)
            p = np.full((len(at), len(self.langs)), self.uniform)
            for o in range(ORDER):
                use = place[at] >= o
                i = at[use]
                if o == 0:
                    weight = self.empty
                else:
                    j, hit = self._find(o - 1, h[o - 1][i - 1])
                    weight = np.where(hit[:, None], self.back[o - 1][j], 1.0)
                j, hit = self._find(o, h[o][i])
                p[use] = np.where(hit[:, None], self.prob[o][j], 0.0) + weight * p[use]
            cost = np.floor(-1000.0 * np.log2(p) + 0.5).astype(np.int64)
            sums = np.concatenate([np.zeros((1, cost.shape[1]), np.int64), np.cumsum(cost, axis=0)])
            ends = np.cumsum(sizes - 1)
            out[part] = sums[ends] - sums[ends - (sizes - 1)]
            size[part] = sizes - 1
        return out, size

    def _find(self, o: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[o]
        j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return j, keys[j] == key

    def choose(self, bits: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its bits per character, and whether that is within the limits; nothing to score is rejected."""
        n = np.maximum(chars, 1)
        best = np.argmin(bits, axis=1)
        per = bits[np.arange(len(bits)), best] / (1000.0 * n)
        ok = chars > 0
        if len(self.limits):
            mean, a, b, z = self.limits[best].T
            ok &= per <= mean + z * np.sqrt(a + b / n)
        return best, per, ok


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """Kneser-Ney models from the word counts of each language."""
    langs = sorted(counts)
    per: list[list[tuple[np.ndarray, ...]]] = []
    chars: set[int] = {_EDGE}
    empty = np.ones(len(langs))
    for c in langs:
        words = sorted(counts[c])
        flat, place, sizes, h = _hashes(words)
        chars.update(np.unique(flat).tolist())
        times = np.repeat(np.array([counts[c][w] for w in words], dtype=np.float64), sizes)
        tables = []
        higher: np.ndarray | None = None  # a position of each distinct n-gram of the order above
        for o in range(ORDER - 1, -1, -1):
            at = np.flatnonzero(place >= max(o, 1))
            keys, first, which = np.unique(h[o][at], return_index=True, return_inverse=True)
            count = np.bincount(which, weights=times[at], minlength=len(keys))
            place_of = at[first]
            if higher is not None:  # how many different characters come before it; at a word's start the count itself
                inner = place[place_of] > o
                left = np.bincount(np.searchsorted(keys, h[o][higher]), minlength=len(keys))
                count = np.where(inner & (left > 0), left, count)
            ones, twos = np.sum(count == 1), np.sum(count == 2)
            discount = ones / (ones + 2.0 * twos) if ones and twos else 0.5
            if o:
                ctx, of = np.unique(h[o - 1][place_of - 1], return_inverse=True)
            else:
                ctx, of = np.zeros(1, np.uint64), np.zeros(len(keys), np.int64)
            total = np.bincount(of, weights=count, minlength=len(ctx))
            kinds = np.bincount(of, minlength=len(ctx))
            tables.append((keys, (count - discount).clip(0) / total[of], ctx, (discount * kinds / total)))
            higher = place_of
        per.append(tables[::-1])
    for i, t in enumerate(per):
        empty[i] = t[0][3][0]
    model = Model(langs, [], [], [], empty, 1.0 / (len(chars) + 1))
    for o in range(ORDER):
        keys = np.unique(np.concatenate([x for t in per for x in (t[o][0], *([t[o + 1][2]] if o + 1 < ORDER else []))]))
        prob, back = np.zeros((len(keys), len(langs))), np.ones((len(keys), len(langs)))
        for i, t in enumerate(per):
            prob[np.searchsorted(keys, t[o][0]), i] = t[o][1]
            if o + 1 < ORDER:
                back[np.searchsorted(keys, t[o + 1][2]), i] = t[o + 1][3]
        model.keys.append(keys)
        model.prob.append(prob)
        model.back.append(back)
    return model


class Scorer:
    """Scores batches of texts; scores of tokens seen before come from a memo."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}
        self.table = np.zeros((1024, len(model.langs) + 1), np.int64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Thousandths of a bit by language, and characters predicted, of each text."""
        if len(self.memo) > _MEMO_ENTRIES:
            self.memo.clear()
        tokens: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = t.split()
                sizes[i] = len(w)
                tokens += w
        new = [t for t in set(tokens) if t not in self.memo]
        if new:
            bits, n = self.model.bits([letters(t.decode("utf-8", "replace")) for t in new])
            start = len(self.memo)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start : start + len(new), :-1], self.table[start : start + len(new), -1] = bits, n
            self.memo.update(zip(new, range(start, start + len(new))))
        at = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        sums = np.concatenate([np.zeros((1, self.table.shape[1]), np.int64), np.cumsum(self.table[at], axis=0)])
        ends = np.cumsum(sizes)
        got = sums[ends] - sums[ends - sizes]
        return got[:, :-1], got[:, -1]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Models and limits from rows of ``docs`` that have a language; None without any."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    seen = {c: 0.8 * min(1.0, per_language / n) for c, n in sizes.items()}
    below = lambda parts: F.create_map(*[x for c, p in parts.items() for x in (F.lit(c), F.lit(int(1e6 * p)))])[F.col("lang")]
    drawn = {c: min(1.0, p + HELD_OUT / sizes[c]) for c, p in seen.items()}
    sample = common.stage(labelled.where(draw < below(drawn)).withColumn("held", draw >= below(seen)).repartition(8), "langid-sample")
    words = sample.where("not held").select("lang", F.explode(F.split("text", r"\s+")).alias("w")).groupBy("lang", "w").count().toArrow()
    counts: dict[str, dict[str, int]] = {}
    for b in words.to_batches(max_chunksize=50_000):
        for c, w, n in zip(*(x.to_pylist() for x in b.columns)):
            if x := letters(w):
                own = counts.setdefault(c, {})
                own[x] = own.get(x, 0) + n
    del words
    if not counts:
        return None
    model = fit(counts)
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(bc.value)
        for b in batches:
            bits, n = score(common.binary_rows(b.column("text")))
            best, per, ok = bc.value.choose(bits, n)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(per), pa.array(n)], ["best", "per", "n"])

    rows = sample.where("held").select("text").mapInArrow(run, "best long, per double, n long").where("n > 0").toPandas()
    limits = []
    for i in range(len(model.langs)):
        own = rows[rows.best == i]
        limits.append(_limits(own.per.to_numpy(), own.n.to_numpy()))
    model.limits = np.array(limits)
    return model


def _limits(per: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """Mean entropy, variance a + b/n, and how many deviations still pass; anything passes without held-out rows."""
    if not len(per):
        return 0.0, 1.0, 0.0, np.inf
    mean = float(np.average(per, weights=n))
    square = (per - mean) ** 2
    x = np.stack([np.ones(len(n)), 1.0 / n], axis=1)
    a, b = np.linalg.lstsq(x * np.sqrt(n)[:, None], square * np.sqrt(n), rcond=None)[0] if len(per) > 2 else (0.01, 4.0)
    a, b = max(float(a), 1e-3), max(float(b), 1.0)
    z = np.sort((per - mean) / np.sqrt(a + b / n))
    k = int(np.ceil((1 - REJECT) * (len(z) + 1)))
    # too few rows for the quantile: as far as the largest seen
    return mean, a, b, float(z[k - 1]) if k <= len(z) else max(4.0, float(z[-1]))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, predicted, bits_per_char, n_chars, accepted) of every row.

    Null, empty and letterless texts have no language: predicted is null and they are rejected. Ties go to
    the first language by name. Repeated rows get equal results. Texts are read whole. Without labelled rows
    predicted is null and all is accepted. Empty input gives no rows; further columns are ignored.
    """
    model = model or train(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, predicted string, bits_per_char double, n_chars long, accepted boolean"
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("bits_per_char"), F.lit(0).cast("long").alias("n_chars"), F.lit(True).alias("accepted"))
    bc, key = docs.sparkSession.sparkContext.broadcast(model), common.uuid.uuid4().hex
    names = pa.array(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = common.worker_state(key, lambda: Scorer(bc.value))
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                bits, n = score(common.binary_rows(b.column("text")))
                best, per, ok = score.model.choose(bits, n)
                none = pa.array(n == 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.if_else(none, None, names.take(pa.array(best))), pc.if_else(none, None, pa.array(per)), pa.array(n), pa.array(ok)], ["doc_id", "predicted", "bits_per_char", "n_chars", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`identify` accepts; they are filtered where they are read."""
    model = model or train(docs)
    if model is None:
        return docs
    bc, key, at = docs.sparkSession.sparkContext.broadcast(model), common.uuid.uuid4().hex, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = common.worker_state(key, lambda: Scorer(bc.value))
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                bits, n = score(common.binary_rows(b.column(at)))
                yield b.filter(pa.array(score.model.choose(bits, n)[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
