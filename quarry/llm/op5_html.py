"""Main text of HTML pages by differencing against the nearest URLs of the host."""

from __future__ import annotations

import html as htmllib
import re
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import NO_ID, Stage, from_key, table
from .vectext import tidy

# Elements by what they do to text.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "head", "title", "object", "canvas"}
DROPPED = {"nav", "footer", "aside", "button", "select", "textarea", "dialog", "menu"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
SCOPES = DROPPED | {"table", "caption", "td", "th", "object", "template", "marquee"}  # a p before one does not end within it
# Class, id and role tokens that mark what is no main text; a token may also join
# several of them, or one of them and words of place, with hyphens or underscores.
COMMENTS = {"comment", "comments", "disqus", "commentlist"}
BOILERPLATE = COMMENTS | {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "related", "newsletter", "subscribe", "popup", "modal", "footer", "header", "masthead", "pagination", "contentinfo", "complementary", "search"}
PLACES = {"site", "page", "main", "top", "bottom", "left", "right", "list", "box", "bar", "links", "area", "section", "container", "wrapper", "widget", "block", "global", "primary", "secondary", "form", "buttons", "items"}

# An attribute; a quote opens a value only right after the equals sign, and only where it closes.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
_TAG = r"(?:[\s/]++|" + re.sub(r"\((?=[\[\(])(?!\?)", "(?:", _ATTRIBUTE) + r")*+"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)(" + _TAG + r")(?:>|\Z)", re.S)
PARTS = re.compile(r"[-_]+")

OTHER, INSIDE, GONE = 0, 1, 2  # what the structure says of a line: nothing, in the article, no main text


def marks(name: str, attributes: str) -> set[str]:
    """Boilerplate words among the whole class, id and role tokens of a tag; the id of a heading names its section."""
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind not in ("class", "id", "role") or (name in HEADINGS and kind == "id"):
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [p for p in PARTS.split(token) if p]
            if parts and all(p in BOILERPLATE or p in PLACES for p in parts):
                found |= BOILERPLATE.intersection(parts)
    return found


def blocks(source: str) -> list[tuple[str, int]]:
    """(text, OTHER, INSIDE or GONE) of each text line of a page, a line being a block.

    End tags close the nearest open element of their name; unclosed elements
    end with their parent.  A ``p`` ends at the next block, but not at one in an
    element of SCOPES that began later.  Scripts, styles
    and the head are no lines.  An article or main element is INSIDE whatever
    class an element around it has, unless that marks reader comments, and also
    in a form around it, as of servers that put a page in one; a form in it goes.
    Open elements are counted by name, so the work is linear in the page.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    aside: list[str] = []  # text of dropped elements within the block
    stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = []
    top = (False, False, False, False)  # silent, dropped, dropped by class, in the article
    state = top

    def flush(end: bool = False):
        out_of_text = (state[0] or state[1] or state[2]) and not end  # blocks in dropped elements don't cut the block around them
        for kept, held in ((True, parts), (False, aside)):
            if held and not (kept and out_of_text):
                text = " ".join(htmllib.unescape("".join(held)).split())
                if text:
                    out.append((text, (INSIDE if state[3] else OTHER) if kept else GONE))
                held.clear()

    places: dict[str, list[int]] = {}  # of the open elements of each name, and of SCOPES under ""

    def open_(name: str) -> None:
        for key in (name, "") if name in SCOPES else (name,):
            places.setdefault(key, []).append(len(stack))
        stack.append((name, state))

    def close(name: str) -> None:
        nonlocal state
        if not places.get(name):
            return
        for other, _ in reversed(stack[places[name][-1] :]):
            places[other].pop()
            if other in SCOPES:
                places[""].pop()
            stack.pop()
        state = stack[-1][1] if stack else top

    def add(text: str) -> None:
        if not state[0]:
            (aside if state[1] or state[2] else parts).append(text)

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in BLOCK:
                flush()
            close(name)
        elif m[2]:
            name, attributes = m[2].lower(), m[3] or ""
            if name == "br":
                add(" ")
                continue
            if name in BLOCK:
                flush()
                if places.get("p") and (not places.get("") or places[""][-1] < places["p"][-1]):
                    close("p")
            if name in VOID or attributes.endswith("/"):
                continue
            silent, dropped, classed, main = state
            found = marks(name, attributes) if attributes and name not in ("html", "body") else set()
            silent = silent or name in SILENT
            dropped = dropped or name in DROPPED or (name == "header" and not main) or not COMMENTS.isdisjoint(found)
            if name in MAIN:
                classed = classed and main
                main = main or not dropped
            else:
                classed = classed or bool(found) or name == "form"
            state = (silent, dropped, classed, main)
            open_(name)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
                close(name)
    flush(True)
    return out


CELLS = 1 << 20  # cells of one table of common subsequences; larger ones are halved


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of x and each prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for a in x:
        best = np.maximum(row[1:], np.where(y == a, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(best)
    return row


def _aligned(x: np.ndarray, y: np.ndarray, at: int, keep: np.ndarray) -> None:
    """Mark in ``keep``, from ``at`` on, the places of x on a longest common subsequence with y."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    keep[at : at + head] = True
    x, y, at = x[head:], y[head:], at + head
    tail = 0
    while tail < min(len(x), len(y)) and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    if tail:
        keep[at + len(x) - tail : at + len(x)] = True
        x, y = x[:-tail], y[:-tail]
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        keep[at] = keep[at] or bool((y == x[0]).any())
    elif len(x) * len(y) > CELLS:  # Hirschberg's halving: memory stays linear
        half = len(x) // 2
        total = _row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]
        cut = int(total.argmax())
        _aligned(x[:half], y[:cut], at, keep)
        _aligned(x[half:], y[cut:], at + half, keep)
    else:
        grid = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(len(x) - 1, -1, -1):
            best = np.maximum(grid[i + 1, :-1], np.where(y == x[i], grid[i + 1, 1:] + 1, 0))
            grid[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                keep[at + i] = True
                i, j = i + 1, j + 1
            elif grid[i + 1, j] >= grid[i, j + 1]:
                i += 1
            else:
                j += 1


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of ``a`` lie on a longest common subsequence with ``b``; lines as numbers."""
    a, b = np.asarray(a), np.asarray(b)
    keep = np.zeros(len(a), bool)
    ia = np.flatnonzero(np.isin(a, b))
    if len(ia):
        common = np.zeros(len(ia), bool)
        _aligned(a[ia], b[np.isin(b, a)], 0, common)
        keep[ia] = common
    return keep


def place(url: str | None) -> tuple[str, str]:
    """(host, path and query) of a URL; one that can't be parsed is a path of the empty host."""
    try:
        u = urlsplit(url or "")
        return u.netloc.lower(), f"{u.path}?{u.query}"
    except ValueError:
        return "", url or ""


def _digest(lines: list[tuple[str, int]]) -> tuple[bytes, list[int]]:
    each = [blake2b(t.encode(errors="surrogatepass"), digest_size=8).digest() for t, _ in lines]
    return blake2b(b"".join(each) + bytes(f for _, f in lines), digest_size=16).digest(), [int.from_bytes(x, "little", signed=True) for x in each]


def _line_batches(batches):
    """Of each page its place and the numbers of its lines, without the texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            hosts, paths, digests, lines, flags = [], [], [], [], []
            for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                host, path = place(url)
                found = blocks(source or "")
                digest, numbers = _digest(found)
                hosts.append(host)
                paths.append(path)
                digests.append(digest)
                lines.append(numbers)
                flags.append(bytes(f for _, f in found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), part.column("k"), pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.int64())), pa.array(flags, pa.binary())],
                ["host", "path", "k", "digest", "lines", "flags"],
            )


def _difference_batches(batches):
    """Lines shared with the page before or after within the host; context rows only serve as neighbours."""
    before = here = None

    def done(page, neighbours):
        part, context, host, digest, lines, flags = page
        if context:
            return None
        gone = np.zeros(len(lines), bool)
        for other in neighbours:
            if other is not None and other[0] == part and other[2] == host:
                gone |= shared(lines, other[4])
        if not gone.any():
            return None
        free = INSIDE not in flags
        return host, digest, int(gone.sum()), [int(i) for i in np.flatnonzero(gone) if free and flags[i] == OTHER]

    def pack(rows):
        host, digest, n, gone = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["host", "digest", "n_shared", "gone"])

    rows = []
    for batch in batches:
        for page in zip(*(batch.column(x).to_pylist() for x in ("part", "context", "host", "digest", "lines", "flags")), strict=True):
            if here is not None:
                rows.append(done(here, (before, page)))
            before, here = here, page
            if len(rows) >= 200:
                rows = [r for r in rows if r]
                if rows:
                    yield pack(rows)
                rows = []
    if here is not None:
        rows.append(done(here, (before,)))
    rows = [r for r in rows if r]
    if rows:
        yield pack(rows)


def _text_batches(batches):
    """Of each page its place and its lines: those of the article, or else all that the structure leaves."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            hosts, digests, lines, places = [], [], [], []
            for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = blocks(source or "")
                hosts.append(place(url)[0])
                digests.append(_digest(found)[0])
                wanted = INSIDE if any(f == INSIDE for _, f in found) else OTHER
                lines.append([t for t, f in found if f == wanted])
                places.append([i for i, (_, f) in enumerate(found) if f == wanted])
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("url"), pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))],
                ["k", "url", "host", "digest", "lines", "places"],
            )


def shared_lines(stage: Stage, keyed: DataFrame) -> DataFrame:
    """host, digest, n_shared and gone: the lines of each page content that its nearest URLs have too.

    Equal contents of one host are one page, at the least of their paths, so a
    copy is never its own neighbour.  Pages are dealt by ranges of host and
    path; the first and last page of each range, a few rows a task, are also
    given to the ranges beside it, so neighbours do not depend on the ranges.
    """
    pages = keyed.mapInArrow(tidy(_line_batches), "host string, path string, k bigint, digest binary, lines array<bigint>, flags binary")
    one = pages.groupBy("host", "digest").agg(F.min(F.struct("path", "k")).alias("p"), F.first("lines").alias("lines"), F.first("flags").alias("flags"))
    one = one.select("host", "p.path", "p.k", "digest", "lines", "flags")
    order = ["host", "path", "k", "digest"]
    ranged = stage.cut(one.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    row = F.struct(*order, "lines", "flags")
    edges = ranged.groupBy("part").agg(F.min_by(row, F.struct(*order)).alias("head"), F.max_by(row, F.struct(*order)).alias("tail"))
    # one row a range, however many pages there are
    beside = Window.orderBy("part")
    edges = edges.select("part", F.lag("tail").over(beside).alias("before"), F.lead("head").over(beside).alias("after"))
    context = edges.select("part", F.explode(F.array("before", "after")).alias("x")).filter("x is not null").select("part", "x.*", F.lit(True).alias("context"))
    dealt = ranged.withColumn("context", F.lit(False)).unionByName(context).repartition("part").sortWithinPartitions("part", *order)
    out = stage.cut(dealt.select("part", "context", "host", "digest", "lines", "flags").mapInArrow(tidy(_difference_batches), "host string, digest binary, n_shared bigint, gone array<int>"), "shared")
    stage.keep(out)
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_shared: the main text, lines in page order joined by newline.

    Takes page_id, url, html; other columns are ignored.  The text lines of
    every page are aligned by longest common subsequence with those of the
    pages before and after it by URL path within the host, and the shared
    lines are deleted (n_shared of them lie on the page).  Two things decide
    before that, as differencing can't: elements and whole class tokens that
    name menus, headers, footers, sidebars, notices, adverts, forms and reader
    comments go, shared or not; and where a page marks its article, the lines
    in it stay, shared or not, for articles repeat on a host, whole or in part.

    A null or empty html gives an empty text; an unparsable or null url belongs
    to the empty host; a repeated row is a page with the same content, which
    takes its neighbours from other contents and so keeps its text; a page
    alone on its host has no neighbour; an empty table gives an empty result.
    Only numbers of lines are sorted and compared; texts do not move unless
    the table of shared lines is too large to broadcast.  Alignment takes
    memory in proportion to the lines of a page.
    """
    keyed = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("k"), "url", "html")
    gone = shared_lines(Stage(pages.sparkSession, "maintext"), keyed)
    texts = keyed.mapInArrow(tidy(_text_batches), "k bigint, url string, host string, digest binary, lines array<string>, places array<int>")
    out = texts.join(gone, ["host", "digest"], "left")
    nothing = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains(nothing, F.get("places", i)))
    text = F.array_join(F.when(F.size(nothing) == 0, F.col("lines")).otherwise(kept), "\n")
    return out.select(from_key().alias("page_id"), "url", text.alias("text"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
