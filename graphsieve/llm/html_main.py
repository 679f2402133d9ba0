"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one for each block of text, in zones: *chrome* (menus, headers,
footers, sidebars, adverts, forms and the like, by element and by class, id or role),
*main* (inside ``article`` or ``main``) and *open* (neither).  Within each host the
distinct pages are ordered by URL path (equal lines are one page, at its smallest
path), so no page is ever held against its own copy.  A page's neighbours are the two
before and the two after it, the one first whose path shares more with its own.

The longest common subsequence of the lines of a page and its partner is what their
template prints, and the shared lines are deleted.  The partner is the first neighbour
that shares less than ``COPY`` of the page's characters outside chrome (a near copy of
the text says nothing about the template); without such a one, that which shares least.
A line in a main element is the author's own mark of the article, and two pages of a
host may well quote the same passage there: it goes only if all of two or more neighbours
have it in their main elements, of those that share less than half of the article.

What is left and not chrome by its markup is the text: of a page with a main element
the lines in it, of other pages the open ones.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, partitions, running, ship

CHROME, OPEN, MAIN = 0, 1, 2
COPY = 0.8  # of the characters outside chrome: a neighbour that shares as much is a near copy
QUOTED = 0.5  # of an article's characters: as above, for what is template inside articles
BLOCK = 2048  # ranked pages whose neighbours one run of rows holds
HOT_KEYS = 4096  # at most as many page contents are dealt out over several tasks

RAW = "script|style|noscript|template|iframe|svg|canvas|object|select|textarea|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!svg\b[^>]*/>)({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form button menu dialog label fieldset".split())
CHROME_NAMES = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary".split())
SECTIONS = frozenset("article main section footer header nav aside body".split())


#: Words that say whose or what kind of box, and words that turn a name into a property of its element.
PARTS = frozenset("post entry article page site story blog user reader wp area list section box wrapper container block bar buttons links icons form posts articles stories".split())
STATES = frozenset("no not has with without hide".split())


def _chrome(tag: str, attributes: str, inside_main: bool, strict: bool = False) -> bool:
    """Whether an element is chrome by tag or name; html, body, main and an outermost article never are by name.

    Outside main elements one word of a name decides.  Inside, and with ``strict``, all words of it
    but ``PARTS`` have to be names of chrome, so ``post-comments`` is chrome and ``share-price`` is not.
    """
    if tag in CHROME_TAGS and not (tag == "header" and inside_main):
        return True
    if tag in ("html", "body", "main") or tag == "article" and not inside_main:
        return False
    for m in _NAMED.finditer(attributes):
        if inside_main and m[1].lower() == "id" and re.fullmatch("h[1-6]", tag):
            continue  # headings are named after their text
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            hit = {w for w in words if w in CHROME_NAMES}
            if not hit or words[0] in STATES or inside_main and hit <= {"header", "banner"}:
                continue
            if not (inside_main or strict) or all(w in hit or w in PARTS for w in words):
                return True
    return False


def _ends(tokens: list[re.Match]) -> tuple[dict[int, int], list[int]]:
    """The end tag of each start tag that has one, and how many main elements begin before each token."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    mains = [0]
    for k, m in enumerate(tokens):
        tag = (m[3] or m[6] or "").lower()
        begins = 0
        if tag and tag not in VOID:
            if m[2] or m[5]:
                if opened.get(tag):
                    ends[opened[tag].pop()] = k
            elif not (m[4] or m[7] or "").endswith("/"):
                opened.setdefault(tag, []).append(k)
                begins = tag in ("article", "main")
        mains.append(mains[-1] + begins)
    return ends, mains


def lines_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order, without markup; white space is single, references are decoded."""
    tokens = list(_TOKEN.finditer(page))
    ends, mains = _ends(tokens)
    out: list[tuple[int, str]] = []
    text: list[str] = []
    main, skip_until, skip_tag = [], -1, ""
    at = 0

    def end_block() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((CHROME if skip_tag else MAIN if main else OPEN, line))
            text.clear()

    for k, m in enumerate(tokens):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] is None and m[0].startswith("<!") is False and m[0].startswith("<?") is False:
                text.append(m[0])
            continue
        closing = bool(m[2] or m[5])
        block = tag in BLOCKS
        if block or (tag in CHROME_TAGS):
            end_block()
        elif tag == "br":
            text.append("\n")
        if skip_tag:
            if skip_until >= 0:
                if k == skip_until:
                    skip_tag, skip_until = "", -1
                continue
            if skip_tag == "head":  # ends at its end tag or, without one, where the body or a block begins
                if closing and tag == "head":
                    end_block()
                    skip_tag = ""
                    continue
                if closing or not block:
                    continue
                skip_tag = ""
            # an element that is never closed ends where the next section begins
            elif not closing and tag in SECTIONS and tag != skip_tag:
                skip_tag = ""
            else:
                continue
        if closing:
            if tag in ("article", "main") and tag in main:
                while main.pop() != tag:
                    pass
            continue
        attributes = m[4] or m[7] or ""
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "head":
            end_block()
            skip_tag, skip_until = tag, -1
            continue
        if _chrome(tag, attributes, bool(main)):
            until = ends.get(k, -1)
            holds = mains[until if until >= 0 else len(tokens)] > mains[k + 1]
            # a box around an article is chrome only if its whole name says so
            if main or not holds or _chrome(tag, attributes, False, True):
                if not block:
                    end_block()
                skip_tag, skip_until = tag, until
            continue
        if tag in ("article", "main"):
            main.append(tag)
    tail = page[at:]
    cut = tail.rfind("<")
    if cut >= 0 and ">" not in tail[cut:] and re.match(r"</?[a-zA-Z!]", tail[cut:]):
        tail = tail[:cut]  # a tag that the page breaks off in
    text.append(tail)
    end_block()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """Whether each line of ``a`` is in the longest common subsequence of both.

    Rows of the table are big integers, one bit a line of ``b``; every K-th row is kept
    and the others are computed again on the way back, so memory is about (sqrt n) m bits.
    """
    n, m = len(a), len(b)
    out = [False] * n
    lo = 0
    while lo < n and lo < m and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    hi_a, hi_b = n, m
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a -= 1
        hi_b -= 1
        out[hi_a] = True
    a, b = a[lo:hi_a], b[lo:hi_b]
    if not a or not b:
        return out
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))
    kept, v = {}, full
    # a zero at bit j of row i: the LCS of a[:i] and b[:j+1] is longer than that with b[:j]
    for i, x in enumerate(a):
        if i % step == 0:
            kept[i] = v
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    i, j = len(a), len(b)
    rows: dict[int, int] = {i: v}
    while i and j:
        if i - 1 not in rows:
            base = (i - 1) // step * step
            rows, w = {i: rows[i], base: kept[base]}, kept[base]
            for k in range(base, i - 1):
                u = w & masks.get(a[k], 0)
                w = ((w + u) | (w - u)) & full
                rows[k + 1] = w
        above, here = rows[i - 1], rows[i]
        low = (1 << j) - 1
        if (~here & low).bit_count() == (~above & low).bit_count():
            i -= 1
        elif not here >> (j - 1) & 1 and a[i - 1] == b[j - 1]:
            out[lo + i - 1] = True
            i, j = i - 1, j - 1
        else:
            j -= 1
    return out


class Page:
    """What differencing needs of a page: a hash, a zone and a length for each line."""

    __slots__ = ("hashes", "zones", "sizes", "path", "tried")

    def __init__(self, hashes: np.ndarray, zones: np.ndarray, sizes: np.ndarray, path: str = ""):
        self.hashes, self.zones, self.sizes, self.path = hashes.tolist(), zones, sizes, path
        self.tried: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, lines: list[tuple[int, str]], path: str = "") -> Page:
        return cls(np.array([line_hash(t) for _, t in lines], np.int64), np.array([z for z, _ in lines], np.int8), np.array([len(t) for _, t in lines], np.int64), path)

    def pack(self) -> bytes:
        return np.array(self.hashes, "<i8").tobytes() + self.sizes.astype("<i8").tobytes() + self.zones.astype("i1").tobytes()

    @classmethod
    def unpack(cls, raw: bytes, path: str) -> Page:
        n = len(raw) // 17
        return cls(np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "i1", n, 16 * n), np.frombuffer(raw, "<i8", n, 8 * n), path)

    def candidates(self) -> np.ndarray:
        """Lines that markup leaves: those in main elements or, without any, the open ones."""
        main = self.zones == MAIN
        return main if main.any() else self.zones == OPEN

    def keys(self) -> list[tuple[int, bool]]:
        """A line of an article equals none outside."""
        return list(zip(self.hashes, (self.zones == MAIN).tolist()))

    def shared(self, other: Page) -> np.ndarray:
        """Which lines of this page the other one has too."""
        if id(other) not in self.tried:
            self.tried[id(other)] = np.array(common_lines(self.keys(), other.keys()), bool)
        return self.tried[id(other)]

    def share(self, other: Page, among: np.ndarray) -> float:
        total = int(self.sizes[among].sum())
        return int(self.sizes[among & self.shared(other)].sum()) / total if total else 0.0


def in_common(a: str, b: str) -> int:
    """Characters that two paths begin with alike."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def difference(page: Page, neighbours: list[tuple[int, Page]]) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are shared with the partner, and lines that stay; neighbours have their distance in the order, negative before the page."""
    n = len(page.hashes)
    if not neighbours or not n:
        return np.zeros(n, bool), np.ones(n, bool)
    near = [p for _, p in sorted(neighbours, key=lambda x: (-in_common(page.path, x[1].path), abs(x[0]), x[0]))]
    text = page.zones != CHROME
    partner = next((p for p in near if page.share(p, text) < COPY), None)
    if partner is None:
        partner = min(near, key=lambda p: page.share(p, text))
    shared = page.shared(partner)
    main = page.zones == MAIN
    gone = shared & ~main
    if (shared & main).any():
        others = [page.shared(p) for p in near if page.share(p, main) < QUOTED]
        if len(others) > 1:
            gone |= main & np.logical_and.reduce(others)
    return shared, ~gone


def main_text(lines: list[tuple[int, str]], neighbours: list[tuple[int, Page]] | None = None, path: str = "") -> str:
    """The text of one page, given its lines and its neighbours."""
    page = Page.of(lines, path)
    _, stays = difference(page, neighbours or [])
    return " ".join(lines[i][1] for i in np.flatnonzero(page.candidates() & stays).tolist())


def line_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case without ``www.`` and path without a slash or ``.html`` at its end; query and fragment go."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return "", url or ""
    return host, re.sub(r"(?:/|\.html?)+$", "", u.path)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page once: where it is, what it is (``page``, equal for equal lines of a host) and its candidate lines."""
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for url, html_text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            host, path = host_and_path(url)
            lines = lines_of(html_text or "")
            page = Page.of(lines)
            packed = page.pack()
            name = blake2b(host.encode("utf-8", "replace") + b"\0" + packed, digest_size=16).digest()
            texts = [lines[i][1] for i in np.flatnonzero(page.candidates()).tolist()]
            for column, value in zip(out, (host, path, name, packed, texts)):
                column.append(value)
        types = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out, types))], ["id", "url", "host", "path", "page", "lines", "texts"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block and rank: each page against the two before and the two after it, five pages held at a time."""
    held: list[tuple] = []  # the last five rows of the block
    out: list[tuple] = []

    def settle(at: int) -> None:
        name, host, home, block, _, page = held[at]
        if home != block:
            return
        near = [(i - at, held[i][5]) for i in range(max(0, at - 2), min(len(held), at + 3)) if i != at and held[i][1] == host]
        shared, stays = difference(page, near)
        keep = stays[page.candidates()]
        page.tried.clear()
        if shared.any():
            out.append((name, int(shared.sum()), None if keep.all() else keep.tolist()))

    def flush() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.list_(pa.bool_())))], ["page", "n_shared", "keep"])
        out.clear()

    def end() -> None:
        # the last two pages of a block have fewer after them
        for at in range(max(0, len(held) - 2), len(held)):
            settle(at)
        held.clear()

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(7))):
            name, host, path, lines, _, home, block = row
            if held and held[-1][3] != block:
                end()
            held.append((name, host, home, block, path, Page.unpack(lines, path)))
            if len(held) >= 3:
                settle(len(held) - 3)
            if len(held) > 4:
                held.pop(0)
        yield from flush()
    end()
    yield from flush()


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_lines, n_shared for each row of ``pages``.

    n_lines: lines that markup leaves, before differencing; n_shared: lines of the page,
    chrome too, that its partner has.

    Null or empty html gives an empty text; a null or broken URL is a host of its own
    with no path.  Rows with equal ids are pages of their own; repeated pages (equal lines
    on one host, under any URL) are one page to their neighbours and have equal texts.  A
    host's only page has no partner, so nothing of it is shared.  Pages with equal paths
    are ordered by their contents.  Broken markup is read as far as it goes, in time
    linear in the page.  Empty tables give no rows; other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pages")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = base.schema["id"].dataType.simpleString()
    seen = scratch.save(base.mapInArrow(lean(_survey), f"id {id_type}, url string, host string, path string, page binary, lines binary, texts array<string>"), "survey")
    distinct = seen.groupBy("page").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct.withColumn("one", F.lit(1).cast("long")), "distinct")
    ranked = running(distinct.select("host", "path", "page", "lines", "one"), scratch, "ranked", ["host", "path", "page"], {"rank": "one"})
    # a block's first and last pages have neighbours in the blocks beside it: those go there too
    block = F.explode(F.array_distinct(F.transform(F.array(F.col("rank") - 2, F.col("rank"), F.col("rank") + 2), lambda r: F.floor(r / BLOCK))))
    dealt = ranked.select("page", "host", "path", "lines", "rank", F.floor(F.col("rank") / BLOCK).alias("home"), block.alias("block")).where("block >= 0")
    dealt = dealt.repartition(partitions(spark), "block").sortWithinPartitions("block", "rank")
    found = scratch.save(dealt.mapInArrow(lean(_align), "page binary, n_shared long, keep array<boolean>"), "found")
    # contents with so many copies that one task would hold too many: HOT_KEYS of them at most
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    bound = max(BLOCK, -(-total // HOT_KEYS))
    hot = distinct.where(F.col("copies") > bound).select("page", F.ceil(F.col("copies") / bound).alias("parts"))
    rows = seen.join(F.broadcast(hot), "page", "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)))
    found = found.join(F.broadcast(hot), "page", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    joined = rows.select("id", "url", "texts", "page", "part").join(found.select("page", "part", "n_shared", "keep"), ["page", "part"], "left")
    kept = F.when(F.col("keep").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda x, i: F.get(F.col("keep"), i)))
    out = joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, " ").alias("text"), F.size("texts").cast("long").alias("n_lines"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    return out.select(id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
