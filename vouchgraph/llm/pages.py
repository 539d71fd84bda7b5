"""HTML extraction by consensus paths of a host.

Every page's containers are scored by their text outside links; a container's path is its ancestors' tags and
classes with digits generalised. Pages vote for all their paths by score, the votes are summed per host in Spark, and
every page is extracted again from the containers at its host's winning path.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Attributes of a tag: a quoted value may hold ">". Nothing in it is tried twice, so broken tags cost no more than others.
_ATTRIBUTES = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>|<[!?][^>]*>", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_BOX = frozenset("html body div article section main td th nav aside header footer ul ol dl table form blockquote figure details center".split())
_ASIDE = frozenset("nav aside footer form header".split())
_LINE = _BOX | frozenset("p h1 h2 h3 h4 h5 h6 li br tr hr pre dt dd title caption option head".split())
_FAVOUR = {"article": 1.25, "main": 1.25, "nav": 0.1, "aside": 0.1, "footer": 0.1, "header": 0.3, "form": 0.1, "ul": 0.5, "ol": 0.5}
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


class Page:
    """Containers and text pieces of a page, in one pass over its tags; tags that nothing closes do no harm.

    A container's path is a number: its parent's path and its own tag and class. So depth costs nothing; a path's
    digest names it in all pages, its text is only put together for a path that is shown.
    """

    def __init__(self, text: str) -> None:
        self.path, self.tag, self.parent, self.first, self.last = [0], [""], [-1], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.above, self.kind, self.depth, self.digest = [-1], [""], [0], [b""]  # by path
        self.pieces: list[str | None] = []  # None: a new line
        self.owner: list[int] = []
        self.linked: list[bool] = []
        stack: list[tuple[str, int]] = []
        opened: dict[str, int] = {}
        here, links, skip, at = 0, 0, 0, 0
        stop = text.rfind(">") + 1  # no tag ends after it
        m = None
        for m in _TOKEN.finditer(text, 0, stop):
            if m.start() > at and not skip:
                self._add(text[at : m.start()], here, links > 0)
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            if tag in _LINE:
                self._add(None, here, False)
            if tag in _VOID:
                continue
            if not m[2]:
                if tag in ("head", "title"):
                    skip += tag == "title"
                    continue
                if tag == "a":
                    links = 1
                elif tag in _BOX:
                    found = _CLASS.search(m[4])
                    name = (found[1] or found[2] or found[3] or "").split() if found else []
                    kind = tag + ("." + _DIGITS.sub("#", name[0].lower()) if name else "")
                    self.path.append(self._path(self.path[here], kind))
                    self.tag.append(tag)
                    self.parent.append(here)
                    self.first.append(len(self.pieces))
                    self.last.append(-1)
                    stack.append((tag, here))
                    opened[tag] = opened.get(tag, 0) + 1
                    here = len(self.path) - 1
            elif tag == "title":
                skip = max(0, skip - 1)
            elif tag == "a":
                links = 0
            elif tag in _BOX and opened.get(tag):
                while True:
                    t, outer = stack.pop()
                    opened[t] -= 1
                    self.last[here], here = len(self.pieces), outer
                    if t == tag:
                        break
                links = 0
        if m and at == stop and ((m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)) or (m[0].startswith("<!--") and not m[0].endswith("-->"))):
            at = len(text)  # a script or comment that nothing ends
        if at < len(text) and not skip:
            self._add(text[at:], here, links > 0)
        end = len(self.pieces)
        self.last = [end if x < 0 else x for x in self.last]
        self.last[0] = end

    def _path(self, above: int, kind: str) -> int:
        found = self.paths.get((above, kind))
        if found is None:
            found = self.paths[above, kind] = len(self.kind)
            self.above.append(above)
            self.kind.append(kind)
            self.depth.append(self.depth[above] + 1)
            self.digest.append(xxhash.xxh3_128_digest(self.digest[above] + kind.encode("utf-8", "surrogatepass")))
        return found

    def _add(self, piece: str | None, owner: int, linked: bool) -> None:
        self.pieces.append(piece)
        self.owner.append(owner)
        self.linked.append(linked)

    def name(self, path: int) -> str:
        """Tags and classes of the path, from the outermost in."""
        kinds = []
        while path:
            kinds.append(self.kind[path])
            path = self.above[path]
        return ">".join(reversed(kinds))

    def scores(self) -> dict[int, float]:
        """Score of each path: own text outside links, less for much linked text, and a part of what lies inside."""
        plain, link = [0] * len(self.path), [0] * len(self.path)
        for p, o, a in zip(self.pieces, self.owner, self.linked):
            if p and (n := len(p.strip())):
                if a:
                    link[o] += n
                else:
                    plain[o] += n
        total = [0.0] * len(self.path)
        for i in range(len(self.path) - 1, 0, -1):
            if plain[i]:
                total[i] += plain[i] * plain[i] / (plain[i] + link[i])
            total[i] *= _FAVOUR.get(self.tag[i], 1.0)
            total[self.parent[i]] += 0.6 * total[i]
        out: dict[int, float] = {}
        for i in range(1, len(self.path)):
            if total[i] > 0:
                out[self.path[i]] = out.get(self.path[i], 0.0) + total[i]
        return out

    def best(self) -> int | None:
        """The path of the highest score, the outermost in a tie, then that of the least digest."""
        s = self.scores()
        return min(s, key=lambda p: (-s[p], self.depth[p], self.digest[p])) if s else None

    def text(self, path: int | None) -> str:
        """Lines of the containers at ``path`` (of the whole page without one), without what stands aside in them."""
        spans = [(self.first[i], self.last[i]) for i in range(1, len(self.path)) if self.path[i] == path] if path else [(0, len(self.pieces))]
        shown = [True] * len(self.path)
        for i in range(1, len(self.path)):
            shown[i] = self.path[i] == path or (self.tag[i] not in _ASIDE and shown[self.parent[i]])
        lines: list[str] = []
        done = 0
        for low, high in spans:
            out: list[str] = []
            for k in range(max(low, done), high):
                if shown[self.owner[k]]:
                    p = self.pieces[k]
                    out.append("\n" if p is None else _html.unescape(p).replace("\n", " "))
            done = max(done, high)
            lines += [" ".join(x.split()) for x in "".join(out).split("\n")]
        return "\n".join(x for x in lines if x)


def host(url: str = "url") -> Column:
    """Host of a URL in lower case, without user, port and "www."; null without one."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return F.when(found != "", found)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            b = whole.slice(k, 500)
            sums: dict[tuple[str, bytes, int], int] = {}
            for h, x in zip(b.column("host").to_pylist(), b.column("html")):
                if x := x.as_py():
                    page = Page(x)
                    s = page.scores()
                    most = max(s.values(), default=1.0)
                    for p in s:  # every container, so that one common to all pages counts however low it ranks
                        key = h, page.digest[p], page.depth[p]
                        sums[key] = sums.get(key, 0) + round(1000 * s[p] / most)
            columns = list(zip(*sums)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["host", "path", "depth", "votes"])


def winners(named: DataFrame) -> DataFrame:
    """(host, path): digest of the path with the most votes of each host; the outermost in a tie, then the least digest."""
    votes = named.where("host is not null and html is not null").select("host", "html").mapInArrow(_vote, "host string, path binary, depth int, votes long")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.first("depth").alias("depth"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "depth", "path")).alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            b = whole.slice(k, 500)
            path, text, how = [], [], []
            for x, win in zip(b.column("html"), b.column("path").to_pylist()):
                if (x := x.as_py()) is None:
                    path.append(None), text.append(None), how.append("none")
                    continue
                page = Page(x)
                agreed = page.digest.index(win) if win in page.digest else None
                p = agreed or page.best()
                path.append(page.name(p) if p else None), text.append(page.text(p)), how.append("consensus" if agreed else "own" if p else "whole")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(path, pa.string()), pa.array(how, pa.string()), pa.array(text, pa.string())], ["page_id", "host", "path", "method", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, method, text) of every row.

    method: "consensus" (the host's path), "own" (a page without that path or without host: its own best),
    "whole" (no container at all), "none" (null html, null text). An empty page is "whole" with empty text. Ties go
    to the outermost path, then to that of the least digest. Repeated rows vote each and come out alike. Pages
    are read whole, in time linear in their length, however deep tags nest; broken and unclosed tags, scripts
    and comments are passed over. Empty input gives no rows; further columns are ignored.
    """
    named = pages.select("page_id", host().alias("host"), "html")
    won = common.checked(common.stage(winners(named), "page-paths").select(F.col("host").alias("__h"), "path"), 128)
    joined = named.join(won, F.col("host") == F.col("__h"), "left").select("page_id", "host", "path", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, host string, path string, method string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
