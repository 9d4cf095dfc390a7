"""Main text of web pages by nearest-URL page differencing.

A page is read into lines: its blocks of text in page order, without markup,
scripts and styles. Pages of a host are ordered by URL path, and each is paired
with the neighbour whose path shares the longer beginning. The lines of a pair
are aligned by their longest common subsequence, and shared lines go: they are
the host's template.

Differencing alone cannot tell a menu that differs from page to page from
text, nor a paragraph that two articles share from a template. So the markup
has a say: lines in elements made for menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go, and lines inside an
``article`` or ``main`` element are never taken for template. An element that only
its class, id or role names so (or a form) is kept after all if it holds the page's
only ``article`` or ``main``, and a form if it holds most of the page's text: such
names are given to layouts too. Names count as whole words, or as
compounds of such words and words of place (``cookie-banner``, not ``has-sidebar``
or ``toc-entry``). Differencing decides about all other lines. A copy of the page is no partner, as it says
nothing about the template.

Pages are range-partitioned by (host, path, id), so a host of any size spreads
over many tasks; a task holds three pages at a time. The first and last page of
each partition may have their nearest neighbour in the next partition; these
few are paired in a second, small step.

Defined results: a null page is empty and gives an empty text; a null or
relative URL has no host and no partner; rows that repeat keep one result each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width

# What HTML element names mean.
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|object|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.IGNORECASE | re.DOTALL)
CLOSED = re.compile(r"-->\Z|</[a-z]+\s*>\Z", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset(
    "article aside body button details dialog div fieldset figure footer form head header html main menu nav ol search "
    "section select table td th tr ul".split())
DROPPED = frozenset("aside button dialog fieldset footer form head menu nav search select".split())
MAIN = frozenset(["article", "main"])
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
DEEP = 256  # dropped elements around a line that are told apart; those deeper go with the ones around them
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
# Words in class, id or role that name something other than the main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline-share "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disqus footer form "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toc toolbar widget".split())


# Words of place and kind that may stand beside a name in a compound.
BESIDE = frozenset(
    "area bar block bottom box container global inner left link links list main mobile outer page primary right secondary section "
    "site sticky sub top widget wrap wrapper zone".split())
SOFT_TAGS = frozenset(["form"])


def _names(word: str) -> bool:
    """Whether a class, id or role names something other than the main text."""
    if word in NAMES:
        return True
    parts = re.split("[-_]+", word)
    return len(parts) > 1 and not NAMES.isdisjoint(parts) and all(x in NAMES or x in BESIDE for x in parts)


def _dropped_as(tag: str, attributes: str, in_main: bool) -> str | None:
    """None for an element that stays, "hard" for one that goes, "soft" for one that goes unless the main text is in it."""
    if tag in SOFT_TAGS:
        return "soft"
    if tag in DROPPED or tag == "header" and not in_main:
        return "hard"
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    if HIDDEN.search(attributes):
        return "hard"
    for m in ATTRIBUTE.finditer(attributes):
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            if _names(word) and not (in_main and word in ("header", "byline")):
                return "soft"
    return None


class _Element:
    """An element that is dropped: how, whether the main text opens in it, and the characters in it."""

    def __init__(self, tag: str, soft: bool) -> None:
        self.tag, self.soft, self.holds_main, self.chars = tag, soft, False, 0


def _tokens(html: str) -> Iterator[tuple[re.Match | None, str]]:
    """(tag or None, text before it). No tag begins behind the last ``>``: a reader that looks for
    its end from every open ``<`` would take quadratic time."""
    end, at, last = html.rfind(">") + 1, 0, None
    for m in TOKEN.finditer(html, 0, end):
        yield m, html[at:m.start()]
        at, last = m.end(), m
    unclosed = last is not None and at == end and (last[1] or last[0].startswith("<!--")) and not CLOSED.search(last[0])
    yield None, "" if unclosed else html[at:]


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Lines of a page and what the markup says of each: 0 nothing, 1 main text, 2 not main text."""
    lines: list[str] = []
    seen: list[tuple[tuple[_Element, ...], bool]] = []  # of each line: the dropped elements around it, whether in the main text
    text: list[str] = []
    stack: list[tuple[str, tuple[_Element, ...], int]] = []  # element, what was around it
    places: dict[str, list[int]] = {}  # of each element's open tags in the stack
    containers: list[int] = []
    around: tuple[_Element, ...] = ()
    main = 0

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(line)
            seen.append((around, main > 0))
            for e in around:
                e.chars += len(line)

    for m, before in _tokens(html):
        if before:
            text.append(before)
        if m is None:
            break
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "title", "iframe", "object", "video", "audio"):
                flush()
            continue
        if tag in BLOCK:
            flush()
        attributes = (m[4] if m[3] else m[7]) or ""
        if m[2] or m[5]:
            held = places.get(tag)
            # a closing tag of a small element does not reach beyond the innermost container
            if held and (tag in CONTAINER or not containers or held[-1] > containers[-1]):
                flush()
                i = held[-1]
                around, main = stack[i][1], stack[i][2]
                while len(stack) > i:
                    name = stack.pop()[0]
                    places[name].pop()
                    if name in CONTAINER:
                        containers.pop()
        elif tag not in VOID and not attributes.endswith("/"):
            drop, inner = _dropped_as(tag, attributes, main > 0), tag in MAIN
            if drop or inner or tag in CONTAINER or around:
                if drop or inner:
                    flush()
                places.setdefault(tag, []).append(len(stack))
                if tag in CONTAINER:
                    containers.append(len(stack))
                stack.append((tag, around, main))
                if drop and len(around) < DEEP:  # deeper ones are dropped with what is around them
                    around = (*around, _Element(tag, drop == "soft"))
                if inner and not main:
                    for e in around:
                        e.holds_main = True
                main += inner
    flush()
    outside = any(in_main and not drops for drops, in_main in seen)
    rest = sum(len(line) for line, (drops, _) in zip(lines, seen, strict=True) if all(e.soft for e in drops))
    kinds = []
    for drops, in_main in seen:
        gone = any(not (e.soft and (e.holds_main and not outside or e.tag in SOFT_TAGS and 2 * e.chars > rest)) for e in drops)
        kinds.append(2 if gone else 1 if in_main else 0)
    return lines, kinds


def _row(eq: np.ndarray, old: np.ndarray) -> np.ndarray:
    new = np.maximum(old[1:], np.where(eq, old[:-1] + 1, 0))
    return np.concatenate([[0], np.maximum.accumulate(new)])


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``, in memory linear in their lengths."""
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    return _common(np.array([a[i] for i in places], dtype=np.int64), np.array(places, dtype=np.int64),
                   np.array([x for x in b if x in both], dtype=np.int64))


def _common(a: np.ndarray, places: np.ndarray, b: np.ndarray) -> list[int]:
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [int(places[0])] if (b == a[0]).any() else []
    half = len(a) // 2
    top = bottom = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a[:half]:
        top = _row(b == x, top)
    for x in a[half:][::-1]:
        bottom = _row(b[::-1] == x, bottom)
    cut = int(np.argmax(top + bottom[::-1]))
    return _common(a[:half], places[:half], b[:cut]) + _common(a[half:], places[half:], b[cut:])


def _nearness(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path, other, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Page:
    def __init__(self, row: dict) -> None:
        self.row, self.lines, self.kinds = row, row["lines"], row["kinds"]
        self.open = [i for i, k in enumerate(self.kinds) if k != 1]
        self.prints = [hash_line(self.lines[i]) for i in self.open]

    def partner(self) -> dict:
        return {"host": self.row["host"], "path": self.row["path"], "prints": self.prints, "whole": self.row["whole"]}

    def text(self, partners: list[dict | None]) -> str:
        """The page's text, differenced from the nearest of its neighbours."""
        near = [p for p in partners if p and self.row["host"] and p["host"] == self.row["host"]
                and p["whole"] != self.row["whole"]]
        template = set()
        if near:
            best = max(near, key=lambda p: _nearness(self.row["path"], p["path"]))
            template = {self.open[i] for i in shared(self.prints, best["prints"])}
        return " ".join(x for i, (x, k) in enumerate(zip(self.lines, self.kinds, strict=True))
                        if k == 1 or k == 0 and i not in template)


def hash_line(line: str) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


_PARTNER = pa.struct([("host", pa.string()), ("path", pa.string()), ("prints", pa.list_(pa.int64())), ("whole", pa.int64())])
_PAGE = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()),
         ("lines", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("whole", pa.int64())]
PARTNER = "struct<host: string, path: string, prints: array<bigint>, whole: bigint>"
PAGE = "page_id long, url string, host string, path string, lines array<string>, kinds array<int>, whole long"


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for row in _pages(batches):
            lines, kinds = page_lines(row.pop("html"))
            yield row | {"lines": lines, "kinds": kinds, "whole": hash_line("\n".join(lines))}
    yield from _batched(rows(), pa.schema(_PAGE))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict | None, dict | None, bool, bool]]:
    """Runs of pages with the same lines: pages, the page before and after, whether first and last of the partition."""
    before, run, first = None, [], True
    for row in _pages(batches):
        if run and (row["host"], row["whole"]) != (run[0]["host"], run[0]["whole"]):
            yield run, before, row, first, False
            before, run, first = run[-1], [], False
        if run:  # a run holds its lines once
            row["lines"] = run[0]["lines"]
            if row["kinds"] == run[0]["kinds"]:
                row["kinds"] = run[0]["kinds"]
        run.append(row)
    if run:
        yield run, before, None, first, True


def _partner(row: dict | None) -> dict | None:
    return _Page(row).partner() if row else None


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of all pages of a partition but those of its first and last run."""
    def rows():
        for run, before, after, first, last in _runs(batches):
            if not (first or last):
                sides = [_partner(before), _partner(after)]
                for row in run:
                    yield _text(row, sides)
    yield from _batched(rows(), _TEXT, 256)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _text(row: dict, partners: list[dict | None]) -> dict:
    return {"page_id": row["page_id"], "url": row["url"], "text": _Page(row).text(partners)}


SUMMARY = f"edge string, page_id long, head {PARTNER}, second {PARTNER}, penult {PARTNER}, tail {PARTNER}"
EDGE = f"edge string, first boolean, last boolean, near {PARTNER}, {PAGE}"
SIDES = f"side string, before {PARTNER}, after {PARTNER}"


def _name(row: dict) -> str:
    """Names a partition by its first page: rows with equal sort keys share a partition."""
    return repr((row["host"], row["path"], row["page_id"]))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its first and last page, and the pages next to its first and last run."""
    def rows():
        out: dict = {}
        for run, before, after, first, last in _runs(batches):
            if first:
                out |= {"edge": _name(run[0]), "page_id": run[0]["page_id"], "head": _partner(run[0]), "second": _partner(after)}
            if last:
                yield out | {"penult": _partner(before), "tail": _partner(run[-1])}
    yield from _batched(rows(), pa.schema([("edge", pa.string()), ("page_id", pa.int64()),
                                           *((c, _PARTNER) for c in ("head", "second", "penult", "tail"))]))


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition, the last page before its first run and the first after its last run; a row a partition."""
    parts = sorted(_pages(batches), key=lambda p: (p["head"]["host"], p["head"]["path"], p["page_id"] is not None, p["page_id"] or 0))

    def other(own: dict, rest: list[dict], near: str, beyond: str) -> dict | None:
        for p in rest:
            if p[near]["host"] != own["host"]:
                return None
            if p[near]["whole"] != own["whole"]:
                return p[near]
            if p[beyond]:
                return p[beyond]
        return None

    yield from _batched(({"side": p["edge"], "before": other(p["head"], parts[:i][::-1], "tail", "penult"),
                          "after": other(p["tail"], parts[i + 1:], "head", "second")} for i, p in enumerate(parts)),
                        pa.schema([("side", pa.string()), ("before", _PARTNER), ("after", _PARTNER)]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a partition's first and last run, with the page next to the run in it."""
    def rows():
        name = None
        for run, before, after, first, last in _runs(batches):
            name = name or _name(run[0])
            if first or last:
                near = _partner(after if first else before)
                for row in run:
                    yield {"edge": name, "first": first, "last": last, "near": near} | row
    yield from _batched(rows(), pa.schema([("edge", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()),
                                           ("near", _PARTNER), *_PAGE]))


def _edge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched((_text(row, [row["before"] if row["first"] else row["near"], row["after"] if row["last"] else row["near"]])
                         for row in _pages(batches)), _TEXT, 256)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """The path without file ending and closing slashes."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(\.[A-Za-z]{2,5})?/*$", "")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html)."""
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        host_of(url).alias("host"), path_of(url).alias("path"),
                        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.mapInArrow(_parsed, PAGE).repartitionByRange(
        width(pages.sparkSession), "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    texts = "page_id long, url string, text string"
    # a row a partition
    sides = rows.mapInArrow(_summary, SUMMARY).repartition(1).mapInArrow(_sides, SIDES)
    edges = rows.mapInArrow(_edges, EDGE).join(F.broadcast(sides), F.col("edge") == F.col("side"))
    return rows.mapInArrow(_inner, texts).union(edges.mapInArrow(_edge_texts, texts))


def report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


