"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into BUCKETS; two multinomials are counted over them, one from all
documents, one from the trusted ones (labels: quality 1, toxic 0) but for every HELD-th, by a hash of the id.
A document's score is the sum of its
n-grams' log ratios over (their number + PRIOR), in thousandths of a nat. The threshold is the score bin
below which TRIM of the held-out trusted documents lie (theirs, like most documents', aren't in the target's counts); every document is kept iff it isn't below. All sums are of
integers, so the outcome doesn't depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 65_536
PRIOR = 8
#: Part of the trusted documents that may fall below the threshold.
TRIM = 0.002
HELD = 4
_R1, _R2 = 1_000_003, 1_009
_MEMO_ENTRIES = 400_000


def _codes(tokens: list[bytes]) -> np.ndarray:
    """md5-based residue of each token; known tokens come from a memo."""
    memo = common.worker_state("quality", dict)
    get = memo.get
    found = [get(t, -1) for t in tokens]
    out = np.array(found, dtype=np.int64)
    for i in np.flatnonzero(out < 0).tolist():
        t = tokens[i]
        v = get(t, -1)
        if v < 0:
            v = int(hashlib.md5(t).hexdigest()[:15], 16) % _R1
            if len(memo) >= _MEMO_ENTRIES:
                memo.clear()
            memo[t] = v
        out[i] = v
    return out


def _features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one text after the other, and the number of each text's n-grams."""
    tokens: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.split()
            sizes[i] = len(w)
            tokens += w
    if not tokens:
        return np.zeros(0, np.int64), sizes
    r = _codes(tokens)
    ends = np.cumsum(sizes)
    uni = r % BUCKETS
    bi = np.full(len(r), -1, dtype=np.int64)
    bi[:-1] = (r[:-1] * _R2 + r[1:] + 1) % BUCKETS
    bi[ends[sizes > 0] - 1] = -1  # no bigram crosses into the next text
    both = np.empty(2 * len(r), dtype=np.int64)
    both[0::2], both[1::2] = uni, bi
    return both[both >= 0], np.where(sizes > 0, 2 * sizes - 1, 0)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in _chunks(batches):
        codes, sizes = _features(common.binary_rows(b.column("text")))
        raw += np.bincount(codes, minlength=BUCKETS)
        trusted = np.repeat(np.asarray(b.column("__q_trusted").to_numpy(zero_copy_only=False), dtype=bool), sizes)
        target += np.bincount(codes[trusted], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["b", "raw", "target"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good and none calls bad or toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("g")).where("g = 1").select(F.col("doc_id").alias("__q_id"))


def log_ratios(marked: DataFrame) -> np.ndarray:
    """Log ratio of each bucket in millionths of a nat; zeros where no document is trusted."""
    counted = marked.select("text", "__q_trusted").mapInArrow(_count, "b int, raw long, target long")
    # as many rows as there are buckets, whatever the corpus
    rows = counted.groupBy("b").agg(F.sum("raw"), F.sum("target")).toArrow()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = rows.column(0).to_numpy()
    raw[at], target[at] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((target + 1.0) / float(target.sum() + BUCKETS)) - np.log((raw + 1.0) / float(raw.sum() + BUCKETS))
    return np.floor(ratio * 1e6 + 0.5).astype(np.int64)


def _bins(texts: list[bytes | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = _features(texts)
    sums = np.concatenate([[0], np.cumsum(weights[codes])])
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]) // (1000 * (sizes + PRIOR)), sizes


def mark(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with __q_trusted and __q_held; the ids are broadcast only if their counted size allows it."""
    held = common.hash60(F.col("__q_id")) % HELD == 0
    ids = common.checked(trusted_ids(labels).withColumn("__q_out", held), 48)
    both = docs.join(ids, docs["doc_id"] == F.col("__q_id"), "left").withColumn("__q_trusted", F.coalesce(~F.col("__q_out"), F.lit(False)))
    return both.withColumn("__q_held", F.coalesce("__q_out", F.lit(False))).drop("__q_out", "__q_id")


def threshold(bins: DataFrame) -> int | None:
    """Lowest bin that is kept, from (bin) rows of the held-out documents; None without any."""
    hist = bins.groupBy("bin").agg(F.count("*").alias("n"))
    running = hist.select("bin", F.sum("n").over(Window.orderBy("bin")).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return running.where(F.col("cum") > F.floor(F.col("total") * F.lit(TRIM))).agg(F.min("bin")).first()[0]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_grams, bin, keep) of every row.

    Null and empty texts have no n-grams, score 0. Repeated rows count as often as they come and get one
    outcome each; a document labelled both good and bad isn't trusted. With no trusted document every score
    is 0, and with none held out all is kept. Texts are read whole, however long. Empty input gives no rows; further columns are
    ignored.
    """
    spark = docs.sparkSession
    marked = mark(docs.select("doc_id", "text"), labels)
    bc = spark.sparkContext.broadcast(log_ratios(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            bins, sizes = _bins(common.binary_rows(b.column("text")), bc.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__q_held"), pa.array(sizes), pa.array(bins)], ["doc_id", "__q_held", "n_grams", "bin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = common.stage(marked.select("doc_id", "__q_held", "text").mapInArrow(run, f"doc_id {kind}, __q_held boolean, n_grams long, bin long"), "quality")
    least = threshold(scored.where("__q_held"))
    return scored.select("doc_id", "n_grams", "bin", F.lit(True).alias("keep") if least is None else (F.col("bin") >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score` keeps; they are filtered where they are read."""
    spark = docs.sparkSession
    marked = mark(docs.select("doc_id", "text"), labels)
    bc = spark.sparkContext.broadcast(log_ratios(marked))
    at = docs.columns.index("text")

    def bins_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_bins(common.binary_rows(b.column(0)), bc.value)[0])], ["bin"])

    least = threshold(marked.where("__q_held").select("text").mapInArrow(bins_only, "bin long"))
    if least is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            bins, _ = _bins(common.binary_rows(b.column(at)), bc.value)
            yield b.filter(pc.greater_equal(pa.array(bins), least))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL = r"""
WITH good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
  HAVING min(CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 1) = 0 THEN 1 ELSE 0 END) = 1),
marked AS (
  SELECT *, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM good) AS labelled,
         coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 4 = 0, false) AS fourth FROM documents),
docs AS (
  SELECT row_number() OVER () AS k, doc_id, labelled AND NOT fourth AS trusted, labelled AND fourth AS held,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS w FROM marked),
words AS (SELECT k, trusted, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM docs),
codes AS (SELECT t, ('0x' || substr(md5(t), 1, 15))::BIGINT % 1000003 AS r FROM (SELECT DISTINCT t FROM words)),
coded AS (SELECT k, trusted, i, r FROM words JOIN codes USING (t)),
grams AS (
  SELECT k, trusted, r % 65536 AS b FROM coded
  UNION ALL
  SELECT k, trusted, (r * 1009 + lead(r) OVER (PARTITION BY k ORDER BY i) + 1) % 65536 FROM coded
  QUALIFY lead(r) OVER (PARTITION BY k ORDER BY i) IS NOT NULL),
counts AS (SELECT b, count(*)::BIGINT AS raw, count(*) FILTER (trusted)::BIGINT AS target FROM grams GROUP BY b),
totals AS (SELECT sum(raw)::BIGINT AS nr, sum(target)::BIGINT AS nt FROM counts),
ratios AS (
  SELECT b, CASE WHEN nt = 0 THEN 0 ELSE floor((ln((target + 1.0::DOUBLE) / (nt + 65536)::DOUBLE)
         - ln((raw + 1.0::DOUBLE) / (nr + 65536)::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT END AS v
  FROM counts, totals),
sums AS (SELECT k, count(*)::BIGINT AS n, sum(v)::BIGINT AS s FROM grams JOIN ratios USING (b) GROUP BY k),
scored AS (
  SELECT doc_id, held, coalesce(n, 0)::BIGINT AS n_grams,
         coalesce((s - ((s % (1000 * (n + 8))) + 1000 * (n + 8)) % (1000 * (n + 8))) // (1000 * (n + 8)), 0)::BIGINT AS bin
  FROM docs LEFT JOIN sums USING (k)),
hist AS (SELECT bin, count(*) AS c FROM scored WHERE held GROUP BY bin),
cum AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS cum, sum(c) OVER () AS total FROM hist),
least AS (SELECT min(bin) AS m FROM cum WHERE cum > floor(total * 0.002::DOUBLE))
SELECT doc_id, n_grams, bin, coalesce(bin >= m, true) AS keep FROM scored, least
"""
