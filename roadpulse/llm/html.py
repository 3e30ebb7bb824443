"""Main text of web pages, by differencing each page with its nearest neighbour by URL.

Sorted by host and path, a page's neighbours are the pages with the nearest URLs. The text lines of a page
and of its nearer neighbour (of both, if they are equally near) are aligned by longest common subsequence, and
shared lines, the site's frame, are deleted. Differencing alone is wrong twice: links, adverts and footers that differ from page to page would
stay, and of two copies of an article nothing would be left. So elements that are never main text are
left out before, and a check puts back shared lines that lie inside an article or main element.
"""

import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.shared import free_name, stored
from roadpulse.llm.urls import host_and_path
from roadpulse.operators.lookup import grouped

_SILENT = {"script", "style", "head", "title", "template", "noscript", "iframe", "svg", "select", "textarea", "button"}
_FRAME = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
_MAIN = {"article", "main"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
}
_CLASSES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related",
    "reply", "share", "sidebar", "social", "sponsored", "subscribe",
}
#: Elements whose ends matter for what is inside them; others are not followed.
_FOLLOWED = _SILENT | _FRAME | _MAIN | {"div", "section", "span", "table", "ul", "ol", "dl"}
#: Elements followed only if they are framed, and the tags before which pages leave them open.
_SHORT = dict.fromkeys(["p", "h1", "h2", "h3", "h4", "h5", "h6", "summary", "figcaption", "caption"], _BLOCK) | {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "a": set(),
}
#: What a head holds; anything else ends one that is not closed.
_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template", "head"}
#: Classes that only frame a page, not a part of its article.
_OUTER = {"header", "footer", "banner", "menu", "nav", "navigation"}
NEAR_ROWS = 64


class _Lines(HTMLParser):
    """The page's blocks in order, each with whether it lies in the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.dropped = self.main = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.main > 0))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
            while self.open and tag in _SHORT.get(self.open[-1][0], ()):
                self._pop()
        elif tag == "br":
            self.parts.append(" ")
        if self.open and self.open[-1][0] == "head" and tag not in _HEAD:
            self._pop()
        if tag not in _FOLLOWED and not (attrs and tag in _SHORT):
            return
        names = {n for k, v in attrs if k in ("class", "id", "role") and v for n in v.lower().replace("_", "-").split()}
        framed = tag in _FRAME and not (tag == "header" and self.main) or bool(names & (_CLASSES - _OUTER if self.main else _CLASSES))
        if tag in _SHORT and not framed:
            return
        kind = "drop" if tag in _SILENT or framed else "main" if tag in _MAIN else ""
        self.open.append((tag, kind))
        self.dropped += kind == "drop"
        self.main += kind == "main"

    def _pop(self) -> str:
        name, kind = self.open.pop()
        self.dropped -= kind == "drop"
        self.main -= kind == "main"
        return name

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._flush()
        if tag in _SHORT:
            if self.open and self.open[-1][0] == tag:
                self._pop()
        elif any(t == tag for t, _ in self.open):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop()
        if not self.dropped:
            self.parts.append(data)

    def finish(self, html: str) -> list[tuple[str, bool]]:
        self.feed(html)
        self.close()
        self._flush()
        return self.lines


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    return _Lines().finish(html or "")


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    One big number per line of ``a`` holds a row of the usual table: bit j is 0 where the row's value rises at j.
    """
    if not a or not b:
        return set()
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for line in a:
        same = row & places.get(line, 0)
        row = ((row + same) | (row - same)) & full
        rows.append(row)
    i, j, found = len(a) - 1, len(b) - 1, set()
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.add(i)
            i, j = i - 1, j - 1
    return found


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _parsed(pages: DataFrame, own: list[str], names: list[str]) -> DataFrame:
    """``own`` columns with the lines of each page, and which of them lie in its article, under two ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                lines = [lines_of(page.as_py()) for page in batch.column("html")]
                texts = pa.array([[t for t, _ in x] for x in lines], pa.list_(pa.string()))
                main = pa.array([[m for _, m in x] for x in lines], pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), texts, main], [*own, *names])

    added = [T.StructField(names[0], T.ArrayType(T.StringType())), T.StructField(names[1], T.ArrayType(T.BooleanType()))]
    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in own), *added]))


def _packed(pages: DataFrame, own: list[str], name: str) -> DataFrame:
    """``own`` columns with the lines of each page, and whether they lie in its article, as compressed bytes: less to shuffle than html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                lines = ("\n".join("-+"[m] + t for t, m in lines_of(page.as_py())) for page in batch.column("html"))
                packed = pa.array([zlib.compress(x.encode(), 1) for x in lines], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), packed], [*own, name])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in own), T.StructField(name, T.BinaryType())]))


def _unpacked(packed: bytes) -> list[tuple[str, bool]]:
    return [(x[1:], x[0] == "+") for x in zlib.decompress(packed).decode().split("\n") if x]


def _nearest_before(keys: DataFrame, by: list[str], order: list[Column]) -> Column:
    """The last row before this one, in ``order`` within ``by``, that has another digest."""
    so_far = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.struct("path", "digest")).over(so_far)
    return F.last(F.when(before["digest"] != F.col("digest"), before), ignorenulls=True).over(so_far)


def _neighbours(keys: DataFrame) -> DataFrame:
    """(host, path, digest, near): the pages with the nearest URLs on both sides whose lines are others. ``keys`` are distinct.

    Keys are cut into ranges, so a busy host spreads over many tasks. Each range finds neighbours within
    itself; only the last two different pages of each range are looked at across ranges, so cuts change nothing.
    """
    cut = keys.repartitionByRange("host", "path", "digest").withColumn("part", F.spark_partition_id())
    cut = stored(cut, "page-keys")
    for side, forward in (("left", True), ("right", False)):
        order = [F.col("path"), F.col("digest")] if forward else [F.desc("path"), F.desc("digest")]
        cut = cut.withColumn(side, _nearest_before(cut, ["host", "part"], order))
        # The last page of a range and the last one before it with other lines, as rows in order.
        last = F.max_by(F.struct(F.struct("path", "digest").alias("one"), F.col(side).alias("two")), F.struct("path", "digest"))
        if not forward:
            last = F.min_by(F.struct(F.struct("path", "digest").alias("one"), F.col(side).alias("two")), F.struct("path", "digest"))
        ends = cut.groupBy("host", "part").agg(last.alias("end"))
        ends = ends.select("host", "part", F.posexplode(F.array("end.two", "end.one")).alias("at", "page"))
        ends = ends.where("page IS NOT NULL").select("host", "part", "at", "page.path", "page.digest")
        place = [F.col("part"), F.col("at")] if forward else [F.desc("part"), F.col("at")]
        ends = ends.withColumn("earlier", _nearest_before(ends, ["host"], place))
        ends = ends.where("at = 1").select("host", "part", F.struct("path", "digest").alias("one"), "earlier")
        before = Window.partitionBy("host").orderBy(F.col("part") if forward else F.desc("part"))
        ends = ends.select("host", "part", F.lag(F.struct("one", "earlier")).over(before).alias("entry"))
        cut = cut.join(ends, ["host", "part"])
        across = F.when(F.col("entry.one.digest") != F.col("digest"), F.col("entry.one")).otherwise(F.col("entry.earlier"))
        cut = cut.withColumn(side, F.coalesce(side, across)).drop("entry")
    near = F.explode(F.array_compact(F.array("left", "right"))).alias("near")
    return cut.select("host", "path", "digest", near)


def _partners(pages: DataFrame) -> DataFrame:
    """(host, path, digest, partners): of each different page the pages it is compared with, as path and lines."""
    first = grouped(pages, ["host", "path", "digest"], lines=F.first("lines"))
    near = _neighbours(first.select("host", "path", "digest"))
    asked = near.select("host", F.col("near.path").alias("p"), F.col("near.digest").alias("d"), "path", "digest")
    named = first.select("host", F.col("path").alias("p"), F.col("digest").alias("d"), F.struct("path", "lines").alias("page"))
    found = asked.join(named, ["host", "p", "d"])
    return grouped(found, ["host", "path", "digest"], partners=F.collect_list("page"))


def _shared_places(lines: list[int], path: str, partners: list[dict]) -> list[int]:
    """Places of the lines that a page shares with the partner whose path is nearest, or with all that are."""
    common = [_common(p["path"], path) for p in partners]
    shared: set[int] = set()
    for partner in (p for p, c in zip(partners, common, strict=True) if c == max(common)):
        shared |= shared_lines(lines, partner["lines"])
    return sorted(shared)


def _differenced(pages: DataFrame) -> DataFrame:
    """(host, path, page, shared): of each different page with a partner, the places of the lines that they share.

    ``pages`` has host, path, page (a digest of the html) and html. Lines are compared by 64 bits of hash, so no text is shuffled.
    """
    key = ["host", "path", "page"]
    seen = _parsed(pages, key, ["lines", "main"])
    hashes = F.transform("lines", lambda line: F.xxhash64(line))
    seen = seen.select(*key, F.xxhash64("lines").alias("digest"), hashes.alias("lines"))
    seen = stored(grouped(seen, key, digest=F.first("digest"), lines=F.first("lines")), "page-lines")
    asked = seen.join(_partners(seen.select("host", "path", "digest", "lines")), ["host", "path", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                columns = (batch.column(c).to_pylist() for c in ("lines", "path", "partners"))
                shared = [_shared_places(*row) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(shared, pa.list_(pa.int32()))], [*key, "shared"])

    return asked.select(*key, "lines", "partners").mapInArrow(run, "host string, path string, page long, shared array<int>")


def _text(lines: list[tuple[str, bool]], shared: list[int] | None) -> str:
    """The lines that are not shared and, as a check, those of the article; without a partner only those, if there are any."""
    if shared is None:
        return "\n".join([t for t, m in lines if m] or [t for t, _ in lines])
    gone = set(shared)
    return "\n".join(t for i, (t, m) in enumerate(lines) if m or i not in gone)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page, in place of html; empty where there is none.

    Null html has no lines. Every page with a host is differenced with the page of the nearest URL in it that has other lines (both, if
    two are equally near), so copies keep their text; shared lines go, but for those of an article or main element. Pages without a host,
    or alone in it, have nothing to be differenced with: they give the lines of their article, or all if they have none. The
    result depends on neither order nor partitions. A column text is replaced; rows that repeat are given each.
    """
    own = [c for c in pages.columns if c.lower() not in ("text", "html")]
    added = []
    for name in ("_host", "_path", "_page", "_shared", "_packed"):
        added.append(free_name(pages.select(*own, *(F.lit(0).alias(x) for x in added)), name))
    host, path, page, shared, packed = added
    url_host, url_path = host_and_path()
    keyed = pages.withColumns({host: url_host, path: url_path, page: F.xxhash64(F.coalesce("html", F.lit("")))})
    placed, unplaced = keyed.where(F.col(host) != ""), keyed.where(F.col(host) == "")
    names = ((host, "host"), (path, "path"), (page, "page"), ("html", "html"))
    found = _differenced(placed.select(*(F.col(c).alias(n) for c, n in names))).toDF(host, path, page, shared)
    rows = _packed(placed, [*own, host, path, page], packed).join(found.hint("shuffle_hash"), [host, path, page], "left")
    rest = _packed(unplaced, own, packed).withColumn(shared, F.lit(None).cast("array<int>"))
    rows = rows.select(*own, packed, shared).unionByName(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                pairs = zip(batch.column(packed), batch.column(shared), strict=True)
                texts = [_text(_unpacked(p.as_py()), s.as_py()) for p, s in pairs]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string())], [*own, "text"])

    return rows.mapInArrow(run, T.StructType([*(pages.schema[c] for c in own), T.StructField("text", T.StringType())]))
