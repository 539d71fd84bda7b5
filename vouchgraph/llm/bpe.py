"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

Spark splits the texts into words by the tokenizer's own pattern. Documents are packed into blocks, in which
a word is a position in the block's list of distinct words; the lists alone are shuffled, by word, so that
every distinct word is encoded once, and its ids come back by position. Blocks are written bucketed by their
id, so texts never cross the network and no step needs the whole word table in one place. The id-to-piece
table has as many rows as the vocabulary, whatever the corpus; ids are joined to it by position.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

#: Ranks of a public byte-level BPE, one base64 piece and its id a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a block holds at least, unless its partition ends; a document is never cut.
BLOCK_WORDS = 3_000_000
#: Parts that a block's distinct words fall into by hash: with more, a block would send a few words a row.
MOST_PARTS = 1024
#: Words of a part whose ids are remembered at once; beyond, the memo starts anew and a word may be encoded again.
_MEMO_WORDS = 2_000_000
_ZSTD = "zstd"
_OWN = ("n_words", "n_tokens", "token_ids", "decoded")


@lru_cache(maxsize=4)
def ranks(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """Pieces by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [b""] * (1 + max(int(i) for _, i in pairs))
    for piece, i in pairs:
        pieces[int(i)] = base64.b64decode(piece)
    return tuple(pieces)


def encoder(pieces: tuple[bytes, ...]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces) if p}, special_tokens={})


def _pack(*arrays: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(arrays), [str(i) for i in range(len(arrays))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(data).read_next_batch().columns


def _planes(codes: np.ndarray) -> list[pa.Array]:
    """Bytes of 32-bit codes, place by place: they compress better apart."""
    return [pa.array(((codes >> s) & 255).astype(np.uint8)) for s in (0, 8, 16, 24)]


def _from_planes(planes: list[pa.Array]) -> np.ndarray:
    return sum(p.to_numpy().astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(planes)).astype(np.int64)


def _block(number: int, parts: int, ids: list[pa.Array], sizes: list[np.ndarray], words: list[pa.Array]) -> Iterator[tuple]:
    """(block, part, payload): documents as codes under part -1, and a row for each part of the distinct words."""
    flat = pa.chunked_array(words).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.string())
    coded = flat.dictionary_encode()
    codes, kinds = coded.indices.to_numpy(), coded.dictionary
    count = np.bincount(codes, minlength=len(kinds))
    common_first = np.argsort(-count, kind="stable")
    rank = np.empty(len(kinds), np.int64)
    rank[common_first] = np.arange(len(kinds))
    texts = kinds.take(pa.array(common_first)).to_pylist()
    part = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % parts for t in texts), np.int64, len(texts))
    by_text = np.array(sorted(range(len(texts)), key=lambda i: (part[i], texts[i])), dtype=np.int64)
    edges = np.searchsorted(part[by_text], np.arange(parts + 1))
    yield number, -1, _join(_pack(pa.concat_arrays(ids), pa.array(np.concatenate(sizes))), _pack(*_planes(rank[codes])), _pack(*_planes(by_text)))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield number, p, _pack(pa.array([texts[i] for i in by_text[edges[p] : edges[p + 1]].tolist()], pa.large_string()))


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, sizes, words = TaskContext.get().partitionId() << 32, 0, [], [], []

        def out() -> pa.RecordBatch:
            rows = list(_block(number, parts, ids, sizes, words))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "payload"])

        common.worker_state("bpe", dict)
        for b in (x.slice(k, 250) for x in batches for k in range(0, x.num_rows, 250)):
            lists = b.column("words")
            ids.append(b.column("kept"))
            sizes.append(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False), dtype=np.int32))
            words.append(lists.flatten())
            held += len(words[-1])
            if held >= BLOCK_WORDS:
                yield out()
                number, held, ids, sizes, words = number + 1, 0, [], [], []
        if ids:
            yield out()

    return run


def _encode(pieces):
    """Words of the parts, block by block: each distinct one of a part is encoded once, each block gets its own back.

    Rows come sorted by part and go through one by one: what is held is the words of one part, not its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, now = encoder(pieces.value).encode_ordinary, {}, None
        for b in batches:
            for k, part in enumerate(b.column("part").to_pylist()):
                if part != now or len(known) > _MEMO_WORDS:
                    known, now = {}, part
                ids = []
                for w in _unpack(b.column("payload")[k].as_py())[0].to_pylist():
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
                reply = _join(_pack(*_planes(n)), _pack(*_planes(flat)[:3]))
                yield pa.RecordBatch.from_arrays([b.column("block").slice(k, 1), b.column("part").slice(k, 1), pa.array([reply], pa.binary())], ["block", "part", "reply"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for payload, replies in zip(b.column("payload"), b.column("replies")):
            docs, codes, order = _split(payload.as_py())
            doc_ids, sizes = _unpack(docs)
            sizes = sizes.to_numpy().astype(np.int64)
            codes, order = _from_planes(_unpack(codes)), _from_planes(_unpack(order))
            lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in sorted(replies.as_py() or [], key=lambda r: r["part"]):
                n, flat = _split(r["reply"])
                lengths.append(_from_planes(_unpack(n)))
                ids.append(_from_planes(_unpack(flat)))
            n, flat = np.concatenate(lengths), np.concatenate(ids)
            if len(n) != len(order):
                raise RuntimeError(f"block {b.column('block')}: {len(order)} words went out, {len(n)} came back")
            start = np.empty(len(n), np.int64)
            start[order] = np.cumsum(n) - n
            size = np.empty(len(n), np.int64)
            size[order] = n
            words = np.where(sizes < 0, 0, sizes)
            first = np.concatenate([[0], np.cumsum(words)])
            for k in range(0, len(doc_ids), 500):
                top = min(k + 500, len(doc_ids))
                c = codes[first[k] : first[top]]
                s = size[c]
                ends = np.cumsum(s)
                at = np.repeat(start[c] - (ends - s), s) + np.arange(int(ends[-1]) if len(ends) else 0)
                bounds = np.concatenate([[0], ends])[first[k : top + 1] - first[k]]
                missing = sizes[k:top] < 0
                offsets = pa.array(bounds.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(bounds.astype(np.int32))
                tokens = pa.ListArray.from_arrays(offsets, pa.array(flat[at].astype(np.int32)))
                kept = doc_ids.slice(k, top - k)
                names = [f.name for f in kept.type]
                yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(words[k:top]), pa.array(np.diff(bounds)), tokens], [*names, *_OWN[:3]])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, n_words, n_tokens, token_ids) of every row.

    The ids are those that the tokenizer gives for the whole text. A null text has null token_ids and counts
    of 0, an empty one an empty array. Repeated rows and ids come out as often as they come in; a document of
    any length stays whole. Empty input gives no rows. Further columns are ignored, but for those named in
    ``keep``, which come out as they are; one named like a result column gives way to it.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(ranks(vocabulary))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(*[f"`{c}`" for c in keep if c not in _OWN])
    words = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("kept"), F.regexp_extract_all("text", F.lit("(?U)" + PATTERN), F.lit(0)).alias("words"))
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    made = words.mapInArrow(_blocks(min(MOST_PARTS, max(64, 4 * buckets))), "block long, part int, payload binary")
    with common.arrow_rows(spark, 1000):
        made.write.bucketBy(buckets, "block").option("path", common.new_path(spark, "bpe", name)).option("compression", "uncompressed").saveAsTable(name)
    blocks = spark.table(name)
    sent = blocks.where("part >= 0").repartition("part").sortWithinPartitions("part")
    replies = sent.mapInArrow(_encode(pieces), "block long, part int, reply binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("part", "reply")).alias("replies"))
    joined = blocks.where("part < 0").select("block", "payload").join(replies, "block", "left")
    out = StructType([*kept.schema.fields, *_counts()])
    return joined.mapInArrow(_finish, out)


def _counts() -> list[StructField]:
    return [StructField("n_words", LongType()), StructField("n_tokens", LongType()), StructField("token_ids", ArrayType(IntegerType()))]


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``tokens`` with a column decoded: the text of token_ids, joined to the pieces by id.

    Null token_ids give null, an empty array the empty text; an id beyond the vocabulary adds nothing, and
    bytes that are no UTF-8 come out as replacement characters. A column decoded that is there already is
    replaced.
    """
    table = F.split(F.lit(",".join(p.hex() for p in ranks(vocabulary))), ",")  # folded into one array
    pieces = F.transform("token_ids", lambda i: F.get(table, i))
    return tokens.withColumn("decoded", F.decode(F.unhex(F.array_join(pieces, "")), "UTF-8"))


def decode_by_join(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`decode` by a join of every single token: ids are exploded, joined to a table (id, piece) and collected again.

    The same result in all cases, at a row a token: the README says what that costs.
    """
    table = tokens.sparkSession.createDataFrame([(i, p) for i, p in enumerate(ranks(vocabulary))], "id int, piece binary")
    rows = common.stage(tokens.drop("decoded").withColumn("__row", F.monotonically_increasing_id()), "bpe-tokens")
    each = rows.select("__row", F.posexplode("token_ids").alias("__at", "id")).join(common.checked(table, 32), "id")
    pieces = each.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__at", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")), "UTF-8")
    both = rows.join(pieces.select("__row", text.alias("decoded")), "__row", "left")
    return both.withColumn("decoded", F.when(F.col("token_ids").isNotNull(), F.coalesce("decoded", F.lit("")))).drop("__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(common.table(spark, sf_dir, "documents")))
