"""WARC archives: writing, indexing, and resolving revisits.

Only headers are shuffled, by payload digest: the first response of a digest stays, other responses and
revisit records are joined to it. Then each archive is copied once, by the place of its records, into a new
one in which every record has fresh headers and repeated payloads have become revisit records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Every so manieth page is fetched again later, unchanged: the crawler writes a revisit record for it.
FETCHED_AGAIN = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATES = ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")
_LEVEL = 2
_END = re.compile(rb"\r?\n\r?\n")
_NAMES = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Profile", "WARC-Refers-To", "Content-Type", "Content-Length")}
#: Bytes read of an archive at once.
_READ = 1 << 20


def record_id(*of: object) -> str:
    h = hashlib.md5("|".join("null" if x is None else str(x) for x in of).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One gzip member with one WARC/1.1 record; line breaks in a value can't forge headers."""
    lines = ["WARC/1.1"] + [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", _LEVEL, mtime=0)


def _headers(head: bytes) -> dict[str, str]:
    """Headers of a record by their usual names; folded lines are joined, lines without a colon passed over, repeats: the first."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = _NAMES.get(name.strip().lower(), name.strip()) if colon and name.strip() not in found else None
        if last and last not in found:
            found[last] = value.strip()
        else:
            last = None
    return found


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, a gzip member or plain."""
    data = gzip.decompress(member) if member[:2] == b"\x1f\x8b" else member
    end = _END.search(data)
    if not end:
        raise ValueError("a record without the end of its headers")
    headers = _headers(data[: end.start()])
    return headers, data[end.end() : end.end() + int(headers.get("Content-Length", len(data)))]


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _again(key: object) -> bool:
    """Whether a page is fetched twice: ids that are whole numbers by themselves, others by the hash of their text."""
    if key is None:
        return False
    if not isinstance(key, int):
        key = int(hashlib.md5(str(key).encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
    return key % FETCHED_AGAIN == 0


_INDEX = "page_id {kind}, capture int, warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, file string, offset long, length long"


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives, one a partition, and return the staged index of their records.

    A null html has no record, an empty one an empty payload; a null id or URL is left out of the record's headers
    or name. Rows that repeat give records of one name. No pages, no archives; further columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        c = TaskContext.get()
        path, at, stream, ready = f"{base}/part-{c.partitionId():06d}-{c.taskAttemptId()}.warc.gz", 0, None, None
        for b in batches:
            rows: list[tuple] = []
            places: list[int] = []
            for i, (url, x) in enumerate(zip(b.column("url").to_pylist(), b.column("html"))):
                if (x := x.as_py()) is None:
                    continue
                key, payload = b.column("page_id")[i].as_py(), x.encode("utf-8", "surrogatepass")
                digest = "sha256:" + hashlib.sha256(payload).hexdigest()
                for capture in range(2 if _again(key) else 1):
                    name = record_id(key, capture)
                    headers = {"WARC-Type": "revisit" if capture else "response", "WARC-Record-ID": name, "WARC-Target-URI": url, "WARC-Date": _DATES[capture], "WARC-Payload-Digest": digest, "WARC-Profile": _PROFILE if capture else None, "Content-Type": "application/http; msgtype=response"}
                    data = record(headers, _http(len(payload)) + (b"" if capture else payload))
                    stream = files.open_output_stream(path, compression=None) if stream is None else stream
                    stream.write(data)
                    rows.append((capture, headers["WARC-Type"], name, url, _DATES[capture], digest, path, at, len(data)))
                    places.append(i)
                    at += len(data)
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int32(), *[pa.string()] * 6, pa.int64(), pa.int64()]
            if ready is not None:
                yield ready
            ready = pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(places, pa.int64())), *[pa.array(v, t) for v, t in zip(cols, kinds)]], ["page_id", "capture", "warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "file", "offset", "length"])
        if stream is not None:
            stream.close()  # before the last rows go out: nothing runs after them
        if ready is not None:
            yield ready

    return common.stage(pages.select("page_id", "url", "html").mapInArrow(run, _INDEX.format(kind=kind)), "warc-index")


class _Records:
    """Records of an archive, plain or gzip by members, one after the other: (offset, length, headers, block's digest)."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.at = stream, b"", 0

    def _more(self) -> bool:
        got = self.stream.read(_READ)
        self.buffer += got
        return bool(got)

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        while self.buffer or self._more():
            if len(self.buffer) < 2 and self._more():
                continue
            if self.buffer[:2] == b"\x1f\x8b":
                unzip, out, used = zlib.decompressobj(31), [], 0
                while not unzip.eof:
                    if not self.buffer and not self._more():
                        return  # cut off: what can't be read isn't there
                    out.append(unzip.decompress(self.buffer))
                    used += len(self.buffer) - len(unzip.unused_data)
                    self.buffer = unzip.unused_data
                data, start = b"".join(out), self.at
                self.at += used
                end = _END.search(data)
                if end and data.startswith(b"WARC/"):
                    headers = _headers(data[: end.start()])
                    yield start, used, headers, data[end.end() : end.end() + int(headers.get("Content-Length", len(data)))]
                continue
            while not (end := _END.search(self.buffer)) and self._more():
                pass
            if not end:
                return
            headers = _headers(self.buffer[: end.start()])
            if not self.buffer.startswith(b"WARC/") or not headers.get("Content-Length", "").isdigit():
                raise ValueError(f"no WARC record at byte {self.at}")
            size = end.end() + int(headers["Content-Length"])
            while len(self.buffer) < size and self._more():
                pass
            if len(self.buffer) < size:
                return
            yield self.at, size, headers, self.buffer[end.end() : size]
            rest = self.buffer[size:]
            while len(rest) < 4 and self._more():
                rest = self.buffer[size:]
            skip = len(rest) - len(rest.lstrip(b"\r\n"))
            self.buffer, self.at = rest[skip:], self.at + size + skip


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """What a response carries: behind the HTTP head where there is one, else the whole block."""
    if "application/http" not in headers.get("Content-Type", ""):
        return block
    end = _END.search(block)
    return block[end.end() :] if end else b""


def index_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The staged index of archives that are there already, one task an archive, for :func:`resolve` and :func:`rewrite`.

    Archives are plain or gzip with a member for each record, as the format asks. page_id is the record's id;
    records that are neither responses nor revisits (requests, warcinfo, metadata, resources) are listed and copied
    as they are. A response without a payload digest gets its SHA-256; a revisit without one stays unresolved, and
    so does one whose digest was computed otherwise. A record that the file's end cuts off is left out. No paths, no rows.
    """
    todo = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("file").to_pylist():
                files, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")
                rows: list[tuple] = []
                with files.open_input_file(path) as stream:
                    for at, size, h, block in _Records(stream):
                        kind, digest = h.get("WARC-Type"), h.get("WARC-Payload-Digest")
                        if kind == "response" and digest is None:
                            digest = "sha256:" + hashlib.sha256(_payload(h, block)).hexdigest()
                        rows.append((h.get("WARC-Record-ID"), 0, kind, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), digest if kind in ("response", "revisit") else None, path, at, size))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    names = ["page_id", "capture", "warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "file", "offset", "length"]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 6, pa.int64(), pa.int64()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [[]] * 10, kinds)], names)

    return common.stage(todo.mapInArrow(run, _INDEX.format(kind="string")), "warc-index")


def resolve(index: DataFrame) -> DataFrame:
    """``index`` with what each record becomes (action) and the original it refers to.

    The original of a digest is its earliest response, by (date, page, URI, place). "original": stays;
    "revisit": a later response or a revisit record, joined to the original; "unresolved": a revisit whose
    payload no archive holds or that names no digest; "other": any other kind of record. A response without digest
    is an original.
    """
    place = F.struct("warc_date", "page_id", "target_uri", "file", "offset")
    first = index.where("warc_type = 'response' and payload_digest is not null").groupBy(F.col("payload_digest").alias("d")).agg(F.min_by(F.struct("record_id", "target_uri", "warc_date", "file", "offset"), place).alias("o"))
    both = index.join(first, F.col("payload_digest") == F.col("d"), "left")
    own = (F.col("o.file") == F.col("file")) & (F.col("o.offset") == F.col("offset"))
    action = F.when(own | ((F.col("warc_type") == "response") & F.col("o").isNull()), "original").when(~F.col("warc_type").isin("response", "revisit") | F.col("warc_type").isNull(), "other").when(F.col("o").isNotNull(), "revisit").otherwise("unresolved")
    return both.withColumn("action", action).drop("d")


def rewrite(resolved: DataFrame, folder: str) -> DataFrame:
    """Copy every archive into ``folder`` with fresh headers; returns a row for each record written.

    An archive's records keep their order. Repeated payloads leave only their HTTP head; null headers are left
    out; records of other kinds keep theirs but for the id. Archives of one base name get names of their own.
    """
    kind = resolved.schema["page_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        t = t.sort_by("offset")
        source = t.column("file")[0].as_py()
        path, at, out = f"{base}/{source.rpartition('/')[2].removesuffix('.gz').removesuffix('.warc')}-{TaskContext.get().taskAttemptId()}.warc.gz", 0, []
        with files.open_input_file(source) as read, files.open_output_stream(path, compression=None) as write:
            for r in t.drop_columns(["page_id"]).to_pylist():
                old, block = parse(read.read_at(r["length"], r["offset"]))
                o = r["o"] if r["action"] == "revisit" else None
                if o and r["warc_type"] == "response":  # the payload is in the original
                    payload = _payload(old, block)
                    block = block[: len(block) - len(payload)]
                whole = r["action"] == "original"
                if r["action"] == "other":
                    name = record_id(r["record_id"], "dedup")
                    data = record({**{k: v for k, v in old.items() if k not in ("WARC-Record-ID", "Content-Length")}, "WARC-Record-ID": name}, block)
                    write.write(data)
                    out.append((r["warc_type"], name, None, len(block), path, at, len(data)))
                    at += len(data)
                    continue
                name, to = record_id(r["record_id"], "dedup"), record_id(o["record_id"], "dedup") if o else None
                headers = {"WARC-Type": "response" if whole else "revisit", "WARC-Record-ID": name, "WARC-Target-URI": r["target_uri"], "WARC-Date": r["warc_date"], "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "WARC-Profile": None if whole else _PROFILE, "WARC-Refers-To": to, "WARC-Refers-To-Target-URI": o["target_uri"] if o else None, "WARC-Refers-To-Date": o["warc_date"] if o else None, "Content-Type": old.get("Content-Type")}
                data = record(headers, block)
                write.write(data)
                out.append((headers["WARC-Type"], name, to, len(block), path, at, len(data)))
                at += len(data)
        cols = list(zip(*out))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        keep = ["page_id", "capture", "target_uri", "payload_digest", "action"]
        return pa.table([*[t.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(cols, kinds)]], names=[*keep, "warc_type", "record_id", "refers_to", "content_length", "file", "offset", "length"])

    schema = f"page_id {kind}, capture int, target_uri string, payload_digest string, action string, warc_type string, record_id string, refers_to string, content_length long, file string, offset long, length long"
    return resolved.groupBy("file").applyInArrow(run, schema)


def deduplicate(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive the pages, resolve revisits, write deduplicated archives, and return their index.

    The archives go to ``archives`` and the index, as Parquet, to ``index`` (which mustn't exist) in ``folder``, a
    path or URI that all executors share, and stay there; what the index doesn't name is left by failed tasks.
    Without a folder both are temporary: they are removed when Python ends.

    A page with null html was never captured and has no record; an empty one has an empty payload; a null URL
    leaves the target out. Rows that repeat are responses with one digest: one stays, the others become
    revisits. Ties in date and page go by URI, then by place in the archives. Empty input gives no rows;
    further columns are ignored. page_id may have any type that sorts. Very long pages are one record each.
    """
    spark = pages.sparkSession
    index = archive(pages, common.new_path(spark, "warc-in"))
    if folder is None:
        return common.stage(rewrite(resolve(index), common.new_path(spark, "warc-out")), "warc-out-index")
    base = folder.rstrip("/")
    written = rewrite(resolve(index), f"{base}/archives")
    written.write.parquet(f"{base}/index")
    return spark.read.schema(written.schema).parquet(f"{base}/index")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "pages")).drop("file", "offset", "length")


SQL = r"""
WITH captures AS (
  SELECT page_id, c::INTEGER AS capture, url, 'sha256:' || sha256(html) AS digest, strlen(html) AS size,
         coalesce(CAST(page_id AS VARCHAR), 'null') || '|' || c AS key
  FROM pages, (VALUES (0), (1)) AS v(c)
  WHERE html IS NOT NULL AND (c = 0 OR page_id % 3 = 0)),
ids AS (
  SELECT *, md5(key) AS a, row_number() OVER (PARTITION BY digest ORDER BY capture, page_id NULLS FIRST, url NULLS FIRST) AS rn FROM captures),
named AS (
  SELECT *, md5('<urn:uuid:' || substr(a, 1, 8) || '-' || substr(a, 9, 4) || '-' || substr(a, 13, 4) || '-' || substr(a, 17, 4) || '-' || substr(a, 21) || '>|dedup') AS b FROM ids),
shown AS (
  SELECT *, '<urn:uuid:' || substr(b, 1, 8) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 4) || '-' || substr(b, 17, 4) || '-' || substr(b, 21) || '>' AS rid,
         strlen('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || size || chr(13) || chr(10) || chr(13) || chr(10)) AS head FROM named)
SELECT s.page_id, s.capture, s.url AS target_uri, s.digest AS payload_digest,
       CASE WHEN s.rn = 1 THEN 'original' ELSE 'revisit' END AS action,
       CASE WHEN s.rn = 1 THEN 'response' ELSE 'revisit' END AS warc_type, s.rid AS record_id,
       CASE WHEN s.rn > 1 THEN o.rid END AS refers_to,
       (s.head + CASE WHEN s.rn = 1 THEN s.size ELSE 0 END)::BIGINT AS content_length
FROM shown s JOIN shown o ON o.digest = s.digest AND o.rn = 1
"""
