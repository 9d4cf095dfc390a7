"""Substring deduplication on bytes by suffix arrays and longest previous factors.

A window is ``window`` consecutive bytes of a document's UTF-8 text. With
``keep="first"`` a byte goes if a window covers it that also starts earlier (a
smaller id, or earlier in the document); with ``keep="none"``, the registered
query's rule, if the window also starts anywhere else. Windows are judged on the
input.

1. Pieces. Each window picks an anchor, the leftmost of the smallest hashes of
   its ``gram``-byte strings; windows that follow each other and share the
   anchor's hash make a piece, and the hash is its key. The choice depends on the
   window's bytes only, so equal windows lie in pieces of equal key.
2. Keys that occur once are done with, as nothing in them repeats (pieces of
   periodic text, which may repeat themselves, go on). Equal pieces of a
   key are settled by their 128-bit content: all their windows repeat. A task
   resolves the equal pieces of a flush before the exchange, so that a very
   common piece travels once per flush.
3. Unequal pieces of a key form a shard, in document order. Its suffix array
   (prefix doubling) and the neighbouring common prefixes give, by the previous
   and next smaller positions in suffix order, the longest earlier factor of every
   position, and by the greater positions the longest later one. Positions
   whose factor has ``window`` bytes or more start a removed window.
4. A key with more than ``OFTEN`` unequal pieces (a passage whose surroundings
   differ, a large family of near copies) is split instead of being gathered: its
   windows make smaller pieces by ``CLASSES`` classes of the anchor's place, each
   keyed by all bytes that its windows share, and steps 2 and 3 repeat; what is
   still too large then goes on window by window, where equal keys are equal
   windows. Keys that hold over a 4096th of all pieces, 4096 at most, are known
   from the counts and are split without being gathered at all.

Memory of a task: a chunk of text, a flush, and a shard of at most ``OFTEN``
pieces of ``RUN`` windows; documents over ``SEGMENT`` bytes are read in
overlapping segments.

Defined results: a null text is empty; a null id sorts first; rows with equal id
and other text are ordered by the text's hash. Rows that repeat an id and its
text count as one document where the first is kept, and as documents of their
own, all of whose windows repeat, where none is; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .common import key_id, row_key, width, written

WINDOW, GRAM = 400, 64
RUN = 1 << 10  # windows of a piece
CLASSES = 8
OFTEN = 1 << 9  # unequal pieces that a shard takes of one key
MOST_HOT = 1 << 12  # keys that are broadcast as hot, by the bar that their counts must pass
FLUSH = 1 << 17  # pieces
SEGMENT = 1 << 20  # bytes; a place in a segment with its windows takes PLACE bits
PLACE = np.uint64((1 << 22) - 1)
SHARD = 1 << 20  # bytes of pieces that one suffix array takes together

ROW = ["did", "k1", "k2"]
SLOTS = 1 << 25


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive entries: block-wise minima from both ends."""
    n = len(x)
    held = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    held[:n] = x
    blocks = held.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def pieces(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int, step: int | None,
           wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """(key, content, content, row, start, bytes, own) of the pieces of the documents between ``offsets``.

    ``own``: the piece has several anchors, as periodic text has, and may repeat itself.

    ``step``: None for pieces by the anchor's hash; else windows whose anchors lie
    in the same ``step`` places make a piece. ``wanted``: places of the windows to take.
    """
    empty = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    n = len(raw)
    if n < window:
        return empty
    at = np.arange(n, dtype=np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = at[:n - window + 1]
    ok = owner[start] == owner[start + window - 1]
    if wanted is not None:
        ok &= wanted[:len(ok)]
    if not ok.any():
        return empty
    sums = A.prefix_sums(raw.astype(np.uint64) + np.uint64(1), "byte")
    more = A.prefix_sums(raw.astype(np.uint64) + np.uint64(1), "word")
    grams = A.span_hash(sums, "byte", at[:n - gram + 1], at[:n - gram + 1] + gram)
    low = sliding_min((grams & ~PLACE) | at[:n - gram + 1].astype(np.uint64), window - gram + 1)
    start = start[ok]
    anchor = (low[ok] & PLACE).astype(np.int64)
    if step is None:
        key = grams[anchor]
        new = A.run_starts(key, start - np.arange(len(start)), owner[start])
    else:
        place = (anchor - start) // step
        core = anchor - place * step
        key = A.mix(A.span_hash(sums, "byte", core, core + window - step + 1) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    + np.uint64(step))
        new = A.run_starts(anchor, place, start - np.arange(len(start)), owner[start])
    heads = np.flatnonzero(new)
    nth = np.arange(len(start)) - np.repeat(heads, np.diff(np.append(heads, len(start))))
    heads = np.flatnonzero(nth % RUN == 0)
    last = np.append(heads[1:], len(start)) - 1
    a, b = start[heads], start[last] + window
    return [key[heads], A.span_hash(sums, "byte", a, b), A.span_hash(more, "word", a, b), owner[a], a - offsets[owner[a]], b - a,
            anchor[heads] != anchor[last]]


def _segments(raw: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The chunk itself, or, if it is one long document, overlapping parts with their places."""
    if len(raw) <= SEGMENT + window or len(offsets) > 2:
        yield raw, offsets, 0
        return
    for at in range(0, len(raw) - window + 1, SEGMENT):
        part = raw[at:at + SEGMENT + window - 1]
        yield part, np.array([0, len(part)]), at


PIECE = "key long, c1 long, c2 long, did long, k1 long, k2 long, start int, size int, own boolean, n int"


def _emit(window: int, gram: int, step: int | None):
    """Flushes of pieces: the first of each content with its count in the flush, copies of it with count 0."""
    def parts(batches):
        for chunk in A.chunks(batches, "text", SEGMENT):
            raw, offsets = A.text_bytes(chunk.column("text"))
            rows = [chunk.column(c).to_numpy(zero_copy_only=False) for c in ROW]
            wanted = None
            if "ranges" in chunk.schema.names:
                wanted = np.zeros(len(raw) + 1, dtype=np.int32)
                ranges = chunk.column("ranges")
                base = np.repeat(offsets[:-1], ranges.value_lengths().to_numpy(zero_copy_only=False))
                flat = ranges.flatten()
                first = base + flat.field("start").to_numpy(zero_copy_only=False)
                np.add.at(wanted, first, 1)
                np.add.at(wanted, first + flat.field("size").to_numpy(zero_copy_only=False) - window + 1, -1)
                wanted = np.cumsum(wanted) > 0
            for part, bounds, at in _segments(raw, offsets, window):
                here = None if wanted is None else wanted[at:]
                key, c1, c2, row, start, size, own = pieces(part, bounds, window, gram, step, here)
                yield [key.view(np.int64), c1.view(np.int64), c2.view(np.int64), *(r[row] for r in rows), start + at, size, own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in A.flushes(parts(batches), FLUSH):
            order = np.lexsort((flush[6], flush[5], flush[4], flush[3], flush[2], flush[1], flush[0]))
            key, c1, c2, did, k1, k2, start, size, own = (a[order] for a in flush)
            new = A.run_starts(key, c1, c2)
            heads = np.flatnonzero(new)
            head = heads[np.cumsum(new) - 1] if len(heads) else heads
            n = np.zeros(len(key), dtype=np.int64)
            n[heads] = np.diff(np.append(heads, len(key)))
            # a row that repeats adds to its first one's count only
            stay = new | (did != did[head]) | (k1 != k1[head]) | (k2 != k2[head]) | (start != start[head])
            out = [a[stay] for a in (key, c1, c2, did, k1, k2)] + [a[stay].astype(np.int32) for a in (start, size)]
            out += [own[stay], n[stay].astype(np.int32)]
            for i in range(0, len(out[0]), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(a[i:i + 65_536]) for a in out],
                                                 names=["key", "c1", "c2", *ROW, "start", "size", "own", "n"])
    return run


def _settle(found: DataFrame, keep: str, final: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked pieces, pieces for the shards, pieces to be split) of written pieces.

    ``final``: pieces are single windows; a key has one a flush at most, and none is hot.
    """
    refs = found.where("n > 0")
    keys = written(refs.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.max("own").alias("own"))
                   .where("total > 1 or own").select("key", "m"), "keys")
    bar = max(OFTEN, refs.count() // MOST_HOT) if not final else (1 << 62)
    hot = keys.where(F.col("m") > bar).select("key")  # MOST_HOT rows at most
    cool = (refs.join(F.broadcast(hot), "key", "left_anti")
            .join(keys.where(F.col("m") <= bar).select("key"), "key", "left_semi"))
    content = Window.partitionBy("key", "c1", "c2")
    ordered = content.orderBy(*ROW, "start")
    repeats = F.sum("n").over(content) > 1 if keep == "none" else F.dense_rank().over(ordered) > 1
    settled = cool.select("key", *ROW, "start", "size", "own", "c1", "c2", repeats.alias("gone"),
                          (F.row_number().over(ordered) == 1).alias("lead"))
    kinds = F.sum(F.col("lead").cast("long")).over(Window.partitionBy("key"))
    settled = written(settled.withColumn("kinds", kinds).drop("c1", "c2"), "settled")
    place = ["key", *ROW, "start", "size"]
    marked = found.where("n = 0").select(*place).union(settled.where("gone").select(*place))
    burning = refs.join(F.broadcast(hot), "key")
    if keep == "none":  # only the first of its copies in a flush goes on
        marked = marked.union(burning.where("n > 1").select(*place))
    lead = settled.where("lead")
    sharded = lead.where((F.col("kinds") <= OFTEN) & ((F.col("kinds") > 1) | F.col("own"))).select(*place)
    split = lead.where(F.col("kinds") > OFTEN).select(*place).union(burning.select(*place))
    return marked, sharded, split


def _with_text(base: DataFrame, places: DataFrame, fields: list[str]) -> DataFrame:
    """Texts of the rows that have ``places``, with these as ``ranges``."""
    held = places.groupBy(*ROW).agg(F.collect_list(F.struct(*fields)).alias("ranges"))
    return base.join(held, ROW).select(*ROW, "text", "ranges")


def _only(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows that have ``places``, and a few others, without a shuffle of the texts: a bitmap
    of ``SLOTS`` hashed rows, 4 MB whatever their number, is broadcast and looked up."""
    slot = F.pmod("k2", F.lit(SLOTS)) + 1
    number, position = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    bits = places.groupBy(number.alias("slots")).agg(F.bitmap_construct_agg(position).alias("bits"))
    met = rows.withColumns({"slots": number, "at": position.cast("int")}).join(F.broadcast(bits), "slots")
    octet = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(octet, F.col("at") % 8) == 1).select(*rows.columns)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted piece."""
    for chunk in A.chunks(batches, "text"):
        raw, offsets = A.text_bytes(chunk.column("text"))
        ranges = chunk.column("ranges")
        owner = np.repeat(np.arange(chunk.num_rows), ranges.value_lengths().to_numpy(zero_copy_only=False))
        flat = ranges.flatten()
        start, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "size"))
        whole = raw.tobytes()
        for i in range(0, len(owner), 2_048):
            o = owner[i:i + 2_048]
            first = offsets[o] + start[i:i + 2_048]
            yield pa.RecordBatch.from_arrays(
                [flat.field("key")[i:i + 2_048], *(chunk.column(c).take(pa.array(o)) for c in ROW), flat.field("start")[i:i + 2_048],
                 pa.array([whole[a:a + n] for a, n in zip(first, size[i:i + 2_048], strict=True)], pa.binary())],
                names=["key", *ROW, "start", "bytes"])


def suffix_order(raw: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of pieces laid end to end, and the ranks of every power-of-two prefix.

    ``left``: bytes from each place to the end of its piece, where its suffix
    ends; equal suffixes stand in the order of their places.
    """
    n, longest = len(raw), int(left.max(initial=0))
    at = np.arange(n)

    def ahead(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        inside = left > k
        out[inside] = values[at[inside] + k] + 1
        return out

    levels = [raw.astype(np.int64)]
    base = 258
    for k in (1, 2):  # prefixes of two and four bytes need no order of their own
        levels.append(levels[-1] * base + ahead(levels[-1], k))
        base = base * base
    k, rank, order = 2, levels.pop(), None
    while True:
        order = np.argsort(rank)
        new = A.run_starts(rank[order])
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.cumsum(new) - 1
        k *= 2
        levels.append(ranks.astype(np.int32))
        if k >= longest or bool(new.all()):
            break
        rank = ranks * (n + 1) + ahead(ranks, k)
    return np.argsort(levels[-1], kind="stable"), levels


def common_prefix(a: np.ndarray, b: np.ndarray, left: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each pair of suffixes."""
    have, most = np.zeros(len(a), dtype=np.int64), np.minimum(left[a], left[b])
    last = len(left) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + have, last), np.minimum(b + have, last)
        have += np.where((have < most) & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return np.minimum(have, most)


def _smaller(place: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the previous suffix, in suffix order, of smaller place; 0 if under ``least``.

    ``prefix[r]`` is the common prefix of suffixes r - 1 and r. All suffixes step
    to the candidate of their candidate until it is smaller: everything skipped is larger.
    """
    back, low = np.arange(len(place)) - 1, prefix.copy()
    active = np.flatnonzero((back >= 0) & (low >= least))
    active = active[place[back[active]] > place[active]]
    while len(active):
        via = back[active]
        low[active] = np.minimum(low[active], low[via])
        back[active] = back[via]
        active = active[(back[active] >= 0) & (low[active] >= least)]
        active = active[place[back[active]] > place[active]]
    return np.where((back >= 0) & (low >= least), low, 0)


def longest_factors(raw: np.ndarray, left: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest following factor) of each place; those under ``least`` count as 0.

    The longest factor starting at a place that also starts at an earlier (later)
    place is its common prefix with the nearest suffixes, on either side in suffix
    order, of smaller (greater) place.
    """
    previous, following = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
    order, levels = suffix_order(raw, left)
    order = order[left[order] >= least]  # shorter suffixes have no factor of that length
    if len(order) < 2:
        return previous, following
    prefix = np.concatenate([[0], common_prefix(order[:-1], order[1:], left, levels)])
    turned = np.concatenate([[0], prefix[:0:-1]])
    for out, place in ((previous, order), (following, -order)):
        out[order] = np.maximum(_smaller(place, prefix, least), _smaller(place[::-1], turned, least)[::-1])
    return previous, following


def _factor_spans(window: int, keep: str):
    """Per shard: the byte ranges of its documents that repeated windows cover."""
    names = ["key", *ROW, "start", "bytes"]

    def gathered(batches):
        held, n = [], 0
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if n >= SHARD and held[-1].column("key")[-1].as_py() != int(key[a]):
                    yield held
                    held, n = [], 0
                held.append(batch.slice(a, b - a))
                n += held[-1].column("bytes").nbytes
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batch for batch in batches if batch.num_rows):
            cols = [pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in names]
            key, did, k1, k2, start = (c.to_numpy(zero_copy_only=False) for c in cols[:5])
            use = np.flatnonzero(A.run_starts(key, did, k1, k2, start))  # rows that repeat are one document
            texts = cols[5].take(pa.array(use)).to_pylist()
            did, k1, k2, start = did[use], k1[use], k2[use], start[use]
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            left = np.repeat(ends, sizes) - np.arange(len(raw))
            previous, following = longest_factors(raw, left, window)
            hit = np.flatnonzero((previous if keep == "first" else np.maximum(previous, following)) >= window)
            owner = np.searchsorted(ends, hit, side="right")
            new = np.flatnonzero(A.run_starts(hit - np.arange(len(hit)), owner))
            last = np.append(new[1:], len(hit)) - 1 if len(new) else new
            o = owner[new]
            shift = start[o] - (ends[o] - sizes[o])
            a, b = hit[new] + shift, hit[last] + window + shift
            yield pa.RecordBatch.from_arrays([pa.array(did[o]), pa.array(k1[o]), pa.array(k2[o]), pa.array(a.astype(np.int32)),
                                              pa.array(b.astype(np.int32))], names=[*ROW, "start", "stop"])
    return run


def repeated_spans(rows: DataFrame, base: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = "first") -> DataFrame:
    """(did, k1, k2, start, stop): byte ranges that repeated windows cover; ranges may overlap.

    ``base`` is ``rows`` (did, k1, k2, text), partitioned by the row; it serves the caller too.
    """
    n = width(base.sparkSession)
    steps = [None, -(-(window - gram + 1) // CLASSES), 1]
    texts, marks, shards = rows, [], []
    for step in steps:
        found = written(texts.mapInArrow(_emit(window, gram, step), PIECE), "pieces")
        marked, sharded, split = _settle(found, keep, step == 1)
        marks.append(marked.select(*ROW, "start", (F.col("start") + F.col("size")).alias("stop")))
        shards.append(sharded)
        if step == 1 or split.isEmpty():
            break
        # only the texts in question are exchanged
        split = written(split, "split")
        texts = _with_text(_only(rows, split).repartition(n, *ROW), split, ["start", "size"])
    sharded = shards[0]
    for other in shards[1:]:
        sharded = sharded.union(other)
    cut = _with_text(base, sharded, ["key", "start", "size"]).mapInArrow(
        _cut, "key long, did long, k1 long, k2 long, start int, bytes binary")
    ordered = cut.repartition(n, "key").sortWithinPartitions("key", *ROW, "start")
    spans = ordered.mapInArrow(_factor_spans(window, keep), "did long, k1 long, k2 long, start int, stop int")
    for more in marks:
        spans = spans.union(more)
    return spans


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = "first",
                     id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) per row: ``kept`` is the
    bytes that stay (``with_bytes``), ``spans`` the removed [start, stop) byte ranges."""
    if keep not in ("first", "none"):
        raise ValueError("keep must be 'first' or 'none'")
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    n = width(docs.sparkSession)
    rows = docs.select(*row_key(docs, id_col, text_col))
    base = rows.repartition(n, *ROW)
    spans = repeated_spans(rows, base, window, gram, keep).groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = base.join(spans, ROW, "left").select("did", "k1", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            n_bytes, n_removed, kept, sums, ranges = [], [], [], [], []
            for text, marks in zip(chunk.column("text").to_pylist(), chunk.column("spans").to_pylist(), strict=True):
                raw, runs = text.encode(), []
                for a, b in sorted((x["start"], x["stop"]) for x in marks or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                bounds = [0, *(x for r in runs for x in r), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                sums.append(hashlib.sha256(left).hexdigest())
                ranges.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(left if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("did"), chunk.column("k1"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array([len(r) for r in ranges], pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.binary()),
                 pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["did", "k1", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    out = joined.mapInArrow(cut, "did long, k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                 "kept binary, spans array<struct<start: int, stop: int>>")
    return out.select(key_id().alias(id_col), *out.columns[2:])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document: no copy of a repeated window is kept."""
    return dedup_substrings(docs, keep="none", with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def oracle() -> str:
    return """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
wins as (select doc_id, p, md5(substr(h, 2 * p + 1, 800)) as d from docs, lateral unnest(range(0, len(h) // 2 - 399)) u(p)),
again as (select d from wins group by d having count(*) > 1),
starts as (select doc_id, p from wins join again using (d)),
edges as (select doc_id, p, case when p <= 400 + lag(p) over (partition by doc_id order by p) then 0 else 1 end as head from starts),
runs as (select doc_id, p, sum(head) over (partition by doc_id order by p) as run from edges),
spans as (select doc_id, run, min(p) as a, max(p) + 400 as b from runs group by doc_id, run),
gaps as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from spans),
kept as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as front
  from gaps join docs using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_spans is null then h else front || substr(h, 2 * last + 1) end)) as kept_sha256
from docs left join kept using (doc_id)"""
