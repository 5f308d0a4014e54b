"""Main text of web pages by differencing each with the page of the nearest URL."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import stash

GROUP_PAGES = 128  # neighbouring pages that are compared in one group
GUESTS = 8  # pages of the groups on either side that visit it
ALIKE = 0.5  # pages that share more of their text than this are versions of one page
COPIES = 0.9  # and those that share more than this tell nothing of each other
JURY = 4  # unlike pages on either side that a line within an article is held against, and that there must be at least
BITS_AT_ONCE = 1 << 26  # of an alignment's table; longer ones are cut in two

# Elements without text of their own for a reader.
HIDDEN = {"script", "style", "template", "svg", "iframe", "head", "title", "select", "button", "textarea"}
# Elements that are not part of an article.
FRAME = {"nav", "aside", "footer", "form", "menu", "dialog"}
# Words of class, id and role that name such parts.
FRAME_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo "
    "promoted related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
ARTICLE = {"article", "main"}
# What a head may hold; anything else ends one that is left open.
HEAD = {"html", "head", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that stand in the midst of a line; all others begin and end one.
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr ins del big".split())
# An element that is not closed ends where one of these begins.
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

ARTICLE_LINE, OPEN_LINE, FRAME_LINE = 0, 1, 2


# A comment, a tag with its attributes (quotes may hold anything), a declaration, or a tag with a quote left open.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
# What these hold is text up to their own end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "iframe")}
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
UNSEEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true)""", re.IGNORECASE)
SAME_LEVEL = {"li", "td", "th", "tr", "option", "dt", "dd"}


class Lines:
    """The text lines of a page and where each stands: in an article, in the frame around it, or neither.

    An element left open ends with the element around it, a head where the body or any text begins. A page header is
    frame, an article's own is not. Nor is what encloses a main element; and where else no article line is left, nor is
    what holds more than half of the page's text and either encloses an article or is a form or an element
    that only a part of a class, id or role names frame, like ``with-sidebar``.
    """

    def __init__(self):
        self.open: list[tuple[str, bool, bool]] = []  # tag, hidden, frame
        self.hidden = self.frame = self.article = 0
        self.found: list[tuple[int, str, tuple[int, ...]]] = []
        self.around: tuple[int, ...] = ()  # the frame elements that are open, by number
        self.frames: list[str] = []  # what each may be: kept, "main", "article" or "loose"
        self.parts: list[str] = []
        self.kind, self.held = OPEN_LINE, ()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((self.kind, text, self.held))
            self.parts = []

    def start(self, tag: str, attributes: str) -> None:
        if tag not in HEAD and self.open and self.open[-1][0] == "head":
            self.close("head")
        if tag not in INLINE:
            self.flush()
        if tag in ENDS_P and any(t == "p" for t, _, _ in self.open):
            self.close("p")
        if tag in SAME_LEVEL and self.open and self.open[-1][0] == tag:
            self.close(tag)
        if tag in VOID:
            return
        named = unseen = whole = False
        if "=" in attributes or "hidden" in attributes:
            if tag not in ARTICLE and tag not in ("html", "body"):
                names = " ".join(v for _, v in NAMES.findall(attributes)).lower()
                parted = [[p for p in re.split(r"[^a-z0-9]+", name) if p] for name in re.split(r"[\s\"']+", names)]
                whole = any(parts and FRAME_NAMES.issuperset(parts) for parts in parted)
                # Within an article a name like related-work or share-chart is that of a part of it; cookie-notice is not.
                named = whole or (not self.article and not FRAME_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", names)))
            unseen = UNSEEN.search(attributes) is not None
        unseen |= tag in HIDDEN
        frame = named or tag in FRAME or (tag == "header" and not self.article)
        self.open.append((tag, unseen, frame))
        self.hidden += unseen
        self.frame += frame
        self.article += tag in ARTICLE
        if frame:
            self.around += (len(self.frames),)
            loose = tag == "form" or (not whole and tag not in FRAME and tag != "header")
            self.frames.append("loose" if loose else "kept")
        if tag in ARTICLE and not self.hidden:
            for n in self.around:
                self.frames[n] = "main" if "main" in (tag, self.frames[n]) else "article"

    def close(self, tag: str) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                for t, unseen, frame in self.open[n:]:
                    self.hidden -= unseen
                    self.frame -= frame
                    self.around = self.around[: len(self.around) - 1] if frame else self.around
                    self.article -= t in ARTICLE
                del self.open[n:]
                return
            if (self.open[n][0] in ARTICLE or self.open[n][0] in FRAME) and (tag in INLINE or tag == "p"):
                return

    def text(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.close("head")
        if self.hidden or not data:
            return
        kind = ARTICLE_LINE if self.article else OPEN_LINE
        if (kind, self.around) != (self.kind, self.held):
            self.flush()
            self.kind, self.held = kind, self.around
        self.parts.append(unescape(data) if "&" in data else data)


    def lines(self) -> list[tuple[int, str]]:
        """Every line and where it stands, now that it is known what each frame element holds."""
        open_ = {n for n, k in enumerate(self.frames) if k == "main"}
        if not any(kind == ARTICLE_LINE and open_.issuperset(held) for kind, _, held in self.found):
            inside = np.zeros(len(self.frames), np.int64)
            for _, text, held in self.found:
                inside[list(held)] += len(text)
            most = sum(len(text) for _, text, _ in self.found) / 2
            open_ |= {n for n, k in enumerate(self.frames) if k != "kept" and inside[n] > most}
        return [(kind if open_.issuperset(held) else FRAME_LINE, text) for kind, text, held in self.found]


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """The text lines of a page in order, each with where it stands. A null page has none."""
    page, at, html = Lines(), 0, html or ""
    while token := TOKEN.search(html, at):
        page.text(html[at : token.start()])
        at = token.end()
        end, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag not in INLINE:
                page.flush()
            page.close(tag)
            continue
        page.start(tag, attributes)
        if attributes.endswith("/") and tag not in VOID and tag not in RAW:
            page.close(tag)
        elif tag in RAW:
            ends = RAW[tag].search(html, at)
            at = ends.start() if ends else len(html)
    page.text(html[at:])
    page.flush()
    return page.lines()


def shared(a: list[int], b: list[int]) -> np.ndarray:
    """Which items of ``a`` a longest common subsequence with ``b`` takes.

    Equal ends are taken off first. The rest is a table of bits, a row an item of ``a`` and a bit an item of
    ``b``, each row made from the one before by an addition and read back from the last. A table of more than
    ``BITS_AT_ONCE`` is cut in two where the sum of both halves' lengths is largest.
    """
    taken = np.zeros(len(a), bool)
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    taken[:low] = True
    taken[len(a) - high :] = True
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return taken
    if len(a) > 1 and len(a) * len(b) > BITS_AT_ONCE:
        half = len(a) // 2
        ahead, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int((ahead + back).argmax())
        taken[low : len(taken) - high] = np.concatenate([shared(a[:half], b[:cut]), shared(a[half:], b[cut:])])
        return taken
    rows = list(_rows(a, b))
    j = len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        before = rows[i - 1] if i else (1 << len(b)) - 1
        # A zero bit says that the best length rises here; where it rose already a row earlier, a[i] is not needed.
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if before >> j & 1:
            taken[low + i] = True
            j -= 1
    return taken


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Row by row the bits of the table of lengths: a zero where the length rises along ``b``."""
    full, where = (1 << len(b)) - 1, {}
    for j, item in enumerate(b):
        where[item] = where.get(item, 0) | 1 << j
    row = full
    for item in a:
        match = row & where.get(item, 0)
        row = (row + match | row - match) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each beginning of ``b``, the empty one first."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """The path of a URL, without host, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1), F.lit(""))


def _digest(lines: list[tuple[int, str]]) -> tuple[list[int], bytes]:
    """Hashes of the lines that markup does not give to the frame, and one of them all."""
    hashes = [xxhash.xxh3_64_intdigest(t) for k, t in lines if k != FRAME_LINE]
    return hashes, xxhash.xxh3_128_digest(np.array(hashes, np.uint64).tobytes())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What differencing needs of a page: the hashes and lengths of its lines, those of the frame left out."""
    for batch in batches:
        found = [lines_of(h) for h in batch.column("html").to_pylist()]
        digests = [_digest(f) for f in found]
        hashes = pa.array([h for h, _ in digests], pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False)
        sizes = pa.array([[len(t) for k, t in f if k != FRAME_LINE] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array([d for _, d in digests], pa.binary()), hashes, sizes], ["url", "digest", "hashes", "sizes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that may stay, one under the other and compressed."""
    for batch in batches:
        found = [lines_of(h) for h in batch.column("html").to_pylist()]
        digests = pa.array([_digest(f)[1] for f in found], pa.binary())
        kinds = pa.array([bytes(k for k, _ in f if k != FRAME_LINE) for f in found], pa.binary())
        texts = [zstandard.compress("\n".join(t for k, t in f if k != FRAME_LINE).encode()) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), digests, kinds, pa.array(texts, pa.binary())], ["page_id", "url", "digest", "kinds", "texts"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page: lines that differencing deletes go, within an article only those that every unlike page has."""
    for batch in batches:
        out = []
        for kinds, packed, near, common in zip(*(batch.column(c).to_pylist() for c in ("kinds", "texts", "near", "common"))):
            lines = list(zip(kinds, zstandard.decompress(packed).decode().split("\n"))) if kinds else []
            gone = {ARTICLE_LINE: set(common or ()), OPEN_LINE: set(near or ())}
            out.append(" ".join(t for n, (k, t) in enumerate(lines) if n not in gone[k]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


class Neighbours:
    """Pages of one host in order of path: their line hashes, the lengths of these lines, and what each shares with others.

    A page that shares more than ``ALIKE`` of its text, or of the other's if that is shorter, with the page before it
    is a version of the same page. Versions stand together as one; pages are held against those before and after them.
    """

    def __init__(self, paths: list[str], lines: list[list[int]], sizes: list[list[int]]):
        self.paths, self.lines, self.sizes = paths, lines, [np.array(s) for s in sizes]
        self.total = [max(1, int(s.sum())) for s in self.sizes]
        self.version = [0]
        for n in range(1, len(paths)):
            self.version.append(self.version[-1] + (self.likeness(n, n - 1)[0] <= ALIKE))
        self.first, self.last = {}, {}
        for n, v in enumerate(self.version):
            self.first.setdefault(v, n)
            self.last[v] = n

    def likeness(self, n: int, other: int) -> tuple[float, np.ndarray]:
        """The share of the shorter page's text that both have, and which lines of ``n`` that is."""
        taken = shared(self.lines[n], self.lines[other])
        return float(self.sizes[n][taken].sum()) / min(self.total[n], self.total[other]), taken

    def unlike(self, n: int, step: int) -> list[tuple[int, np.ndarray]]:
        """The nearest unlike pages before (``step`` -1) or after a page, the nearest first, and the lines it shares with each."""
        ends = self.first if step > 0 else self.last
        there = [ends[v] for v in range(self.version[n] + step, self.version[n] + step * (JURY + 1), step) if v in ends]
        return [(m, taken) for m, (share, taken) in ((m, self.likeness(n, m)) for m in there) if share <= ALIKE]

    def judged(self, n: int) -> tuple[list[int], list[int]]:
        """The lines a page shares with its nearest unlike page, and those it shares with all of at least ``JURY`` of them.

        Nearest is the page whose path has the longer part in common, of the first unlike one before and after; the
        one before, if equal. Where there are versions of the same page only, the one that shares least stands in,
        unless all share more than ``COPIES``.
        """
        before, after = self.unlike(n, -1), self.unlike(n, 1)
        near = max([*before[:1], *after[:1]], key=lambda m: _prefix(self.paths[m[0]], self.paths[n]), default=None)
        if near is None:
            v = self.version[n]
            versions = [self.likeness(n, m) for m in dict.fromkeys((n - 1, n + 1, self.first[v], self.last[v])) if m != n and 0 <= m < len(self.paths)]
            least = min(versions, key=lambda x: x[0], default=(1.0, None))
            near = (n, least[1]) if least[0] <= COPIES else None
        every = np.logical_and.reduce([taken for _, taken in [*before, *after]]) if len(before) + len(after) >= JURY else np.zeros(0, bool)
        return np.flatnonzero(near[1]).tolist() if near else [], np.flatnonzero(every).tolist()


def _differenced(group: pa.Table) -> pa.Table:
    """For the pages at home in a group the lines that differencing would delete."""
    group = group.sort_by("place")
    host, path, guest, lines, sizes = (group[c].to_pylist() for c in ("host", "path", "guest", "hashes", "sizes"))
    rows, near, common = [], [], []
    opens = [n for n in range(len(host)) if n == 0 or host[n] != host[n - 1]]
    for a, b in zip(opens, [*opens[1:], len(host)]):
        pages = Neighbours(path[a:b], lines[a:b], sizes[a:b])
        for n in range(b - a):
            if not guest[a + n]:
                one, two = pages.judged(n)
                rows.append(a + n)
                near.append(one)
                common.append(two)
    taken = group.select(["host", "digest"]).take(pa.array(rows, pa.int64()))
    return taken.append_column("near", pa.array(near, pa.list_(pa.int32()))).append_column("common", pa.array(common, pa.list_(pa.int32())))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: ``key``, ``url``, ``text`` and ``n_chars``.

    A page is parsed into text lines: character references decoded, white space made one space. Lines of menus, page headers,
    footers, sidebars, notices, adverts, forms and comments go, where markup names them. The rest is settled by differencing: pages of a host
    are put in order of URL path, and each is aligned with the nearest unlike page by a longest common subsequence of
    their lines. Pages with the same lines stand for one another, and neighbours that share most of their text are versions of
    one page, which tell nothing of each other. Lines shared with the nearest unlike page are deleted. Article markup breaks
    ties: as articles may quote the same passage, a line within an article or main element goes only if all of the
    nearest unlike pages have it, four or more of them. What is left is joined by one space.

    Only 64-bit hashes and lengths of lines are compared, one row for all pages of a host with the same lines, so a page's part in it is
    small. Such rows are numbered in order through a range partitioning, which is written to the shared scratch folder, and dealt to groups
    of ``GROUP_PAGES`` neighbours; the first and last ``GUESTS`` visit the group next to theirs. So a page in a run of versions
    longer than that is held against what its group has. A host with a
    third of all pages is spread like others. Texts are shuffled once, compressed, to meet what was found of their lines.

    A null or empty page has an empty text; a null URL has no host and an empty path. Rows alike in key, URL and
    page get equal texts. A page alone on its host shares nothing. Pages are taken whole, however long. No other column is read; an empty
    table gives an empty result.
    """
    given = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = f"page_id {given.schema['page_id'].dataType.simpleString()}, url string"
    narrow = given.select("url", "html").mapInArrow(_parsed, "url string, digest binary, hashes array<long>, sizes array<int>")
    narrow = narrow.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "digest", "hashes", "sizes").where(F.size("hashes") > 0)
    order = ["host", "path", "digest"]
    # One row for equal pages first: the sampling for the ranges then reads that shuffle and parses no page again.
    alone = narrow.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    ranged = alone.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = stash(ranged, "pages")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before)]
        before += sizes[part]
    start = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    place = start.cast("long") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    group = F.floor(F.col("place") / GROUP_PAGES)
    spot = F.col("place") % GROUP_PAGES
    visits = F.filter(
        F.array(
            F.struct(group.alias("group"), F.lit(False).alias("guest")),
            F.when(spot < GUESTS, F.struct((group - 1).alias("group"), F.lit(True).alias("guest"))),
            F.when(spot >= GROUP_PAGES - GUESTS, F.struct((group + 1).alias("group"), F.lit(True).alias("guest"))),
        ),
        lambda v: v.isNotNull(),
    )
    placed = ranged.withColumn("place", place).withColumn("visit", F.explode(visits)).select(*order, "hashes", "sizes", "place", "visit.*")
    marks = stash(placed.groupBy("group").applyInArrow(_differenced, "host string, digest binary, near array<int>, common array<int>"), "page-marks")
    texts = given.mapInArrow(_kept, f"{kind}, digest binary, kinds binary, texts binary").withColumn("host", host_of(F.col("url")))
    joined = texts.join(marks, ["host", "digest"], "left").select("page_id", "url", "kinds", "texts", "near", "common")
    found = joined.mapInArrow(_chosen, f"{kind}, text string")
    return found.select(F.col("page_id").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
