"""Substring deduplication by suffix automata of reference shards.

A window is ``window`` consecutive words of a document. A word goes if a
window covers it whose word sequence also starts earlier: in a smaller doc_id,
or earlier in the same document. Windows are judged on the input.

1. Each window picks an anchor, the smallest hash of the short word n-grams in
   it. Equal windows pick equal anchors at the same place, so only windows
   whose anchor occurs again can repeat. Anchors occur once every eight words.
2. The anchor's hash names the reference shard of its windows: the passage of
   these windows (about 27 words) goes there. So equal windows meet in one
   shard, and each document streams through the few shards that matter instead
   of through all of them, as broadcast automata would have it.
3. A shard takes its passages in document order. A passage streams through the
   suffix automaton of the earlier ones; its matching statistics tell, for
   each place, the longest word sequence ending there that occurred before.
   Maximal spans of at least ``window`` words are marked, and the automaton is
   extended with the passage.
4. A document's marked spans are removed.

Before each shuffle a task resolves passages that repeat within it against its
earliest copy, so a very common passage reaches its shard once per flush.
Anchors that occur very often send each window to a shard of its own, named by
the window's hash: no shard holds more than the windows that are equal plus a
bounded number of others.

Shards compare words by 64-bit hashes; a false match needs two windows that
agree but for words with equal hashes.

Defined results: a null text has no words; a null id sorts first; rows with
equal id and text count as one document and get equal results, rows with equal
id and other text are ordered by the text's hash; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import doc_key, key_id, keyed, plain_text, width, written

WINDOW, ANCHOR = 20, 6
FLUSH = 1 << 19
OFTEN = 1 << 10  # an anchor that occurs so often counts as frequent
MOST_FREQUENT = 1 << 18  # so many frequent anchors are broadcast at most; the bar rises until they are


class Automaton:
    """Suffix automaton over integer sequences, extended one sequence at a time."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]

    def longest(self, word_ids: list[int]) -> list[int]:
        """For each place, the length of the longest sequence ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        out = []
        for c in word_ids:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            out.append(have)
        return out

    def extend(self, word_ids: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in word_ids:
            if c in nxt[last]:
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


def _anchors(column: pa.Array, window: int):
    """Word hashes, row of each word, first word of each row, and for each window
    its first word, its anchor's word and the anchor's hash."""
    raw, offsets = A.text_bytes(column)
    starts, stops, rows = A.spans(raw, offsets, A.SPACES)
    words = A.word_hashes(raw, starts, stops)
    sums = A.prefix_sums(words, "word")
    first = np.searchsorted(rows, np.arange(len(offsets)))
    m = len(words)
    if m < window:
        none = np.zeros(0, dtype=np.int64)
        return words, sums, rows, first, none, none, np.zeros(0, np.uint64)
    at = np.arange(m - ANCHOR + 1)
    grams = A.span_hash(sums, "word", at, at + ANCHOR)
    heads = np.arange(m - window + 1)
    span = window - ANCHOR + 1
    best, where = grams[:len(heads)].copy(), np.zeros(len(heads), dtype=np.int64)
    for j in range(1, span):
        other = grams[j:j + len(heads)]
        less = other < best
        best[less] = other[less]
        where[less] = j
    ok = rows[heads] == rows[heads + window - 1]
    heads = heads[ok]
    return words, sums, rows, first, heads, heads + where[ok], best[ok]


OCCURRENCE = (np.uint64, np.int64, np.int32, np.int32)


def _occurrences(n_buckets: int, window: int):
    """Flushes of (anchor hash, did, place, count): the first of each hash with its
    count in the flush; the others with count 0, already known to repeat."""
    def parts(batches):
        for chunk in A.chunks(batches, "text"):
            _, _, rows, first, _, anchor, h = _anchors(chunk.column("text"), window)
            new = A.run_starts(anchor)
            anchor, h = anchor[new], h[new]
            row = rows[anchor]
            yield [h, chunk.column("did").to_numpy(zero_copy_only=False)[row], (anchor - first[row]).astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, did, place in A.flushes(parts(batches), FLUSH):
            order = np.argsort(h, kind="stable")
            h, did, place = h[order], did[order], place[order]
            new = A.run_starts(h)
            heads = np.flatnonzero(new)
            count = np.zeros(len(h), dtype=np.int32)
            count[heads] = np.diff(np.append(heads, len(h)))
            bucket = np.where(new, h, A.mix(did.view(np.uint64) + h)) % np.uint64(n_buckets)
            yield from A.bucket_rows(bucket.astype(np.int64), n_buckets, [h, did, place, count])
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: (did, place) of anchors that occur again, and (hash, count) of frequent ones with place -1."""
    h, did, place, count = A.unpack_all(batches, *OCCURRENCE)
    order = np.argsort(h, kind="stable")
    order = order[count[order] > 0]
    heads = np.flatnonzero(A.run_starts(h[order]))
    size = np.diff(np.append(heads, len(order)))
    total = np.add.reduceat(count[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    again = np.concatenate([order[np.repeat(total > 1, size)], np.flatnonzero(count == 0)])
    often = total >= OFTEN
    a = np.concatenate([did[again], h[order[heads[often]]].view(np.int64)])
    b = np.concatenate([place[again].astype(np.int64), -total[often]])
    for i in range(0, max(1, len(a)), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(a[i:i + 65_536]), pa.array(b[i:i + 65_536])], names=["did", "place"])


ROW = ["did", "k1", "k2"]
PASSAGE = (np.uint64, np.int64, np.int64, np.int64, np.int32, np.int32, np.uint8, np.uint64)


def _passages(n_buckets: int, window: int, frequent):
    """Flushes of (group, did, k1, k2, first word, words, known) and the words' hashes."""
    def parts(batches):
        often = frequent.value
        for chunk in A.chunks(batches, "text"):
            words, sums, rows, first, heads, anchor, h = _anchors(chunk.column("text"), window)
            places = chunk.column("places")
            counts = places.value_lengths().to_numpy(zero_copy_only=False)
            place = places.flatten().to_numpy(zero_copy_only=False)
            own = place < np.repeat(np.diff(first), counts)  # rows with equal id and other text share their places
            again = np.zeros(len(words) + 1, dtype=bool)
            again[np.repeat(first[:-1], counts)[own] + place[own]] = True
            use = again[anchor] if len(anchor) else np.zeros(0, bool)
            heads, anchor, h = heads[use], anchor[use], h[use]
            alone = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
            new = A.run_starts(anchor) | alone
            lead = np.flatnonzero(new)
            start = heads[lead]
            stop = heads[np.append(lead[1:], len(heads)) - 1] + window if len(lead) else start
            content = A.span_hash(sums, "word", start, stop)
            group = np.where(alone[lead], content, h[lead])
            row = rows[start]
            n = stop - start
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield [group, *(chunk.column(c).to_numpy(zero_copy_only=False)[row] for c in ROW),
                   (start - first[row]).astype(np.int32), n.astype(np.int32), content, words[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, did, k1, k2, start, n, content, ids in A.flushes(parts(batches), FLUSH // 16):
            ends = np.cumsum(n)
            order = np.lexsort((start, k2, k1, did, content, group))
            new = A.run_starts(group[order], content[order])
            known = np.zeros(len(order), dtype=bool)
            known[order] = ~new
            head = np.empty(len(order), dtype=np.int64)
            head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            place = [did, k1, k2, start]
            same = known & ~A.differ(place, [x[head] for x in place])  # a row that repeats
            bucket = (np.where(known, A.mix(did.view(np.uint64) + group), group) % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            by = by[~same[by]]
            cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            names, blobs = [], []
            for b in range(n_buckets):
                i = by[cuts[b]:cuts[b + 1]]
                if len(i):
                    fresh = i[~known[i]]
                    size = n[fresh].astype(np.int64)
                    at = np.repeat(ends[fresh] - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    names.append(b)
                    blobs.append(A.pack(group[i], did[i], k1[i], k2[i], start[i], n[i], known[i].astype(np.uint8), ids[at]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["bucket", "blob"])
    return run


def _shard(window: int):
    """Per shard: streams the passages of each group, in order, through the automaton of the earlier ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, did, k1, k2, start, n, known, ids = A.unpack_all(batches, *PASSAGE)
        known = known.astype(bool)
        out = [[x[known]] for x in (did, k1, k2, start, start + n)]
        # every blob lists its words in the order of its unknown passages
        new = np.flatnonzero(~known)
        ends = np.cumsum(n[new].astype(np.int64))
        order = np.lexsort((start[new], k2[new], k1[new], did[new], group[new]))
        by = new[order]
        order = order[A.run_starts(group[by], did[by], k1[by], k2[by], start[by])]  # a row that repeats in another flush
        heads = np.flatnonzero(A.run_starts(group[new][order]))
        found = []
        for a, b in zip(heads, np.append(heads[1:], len(order))[:len(heads)], strict=True):
            if b - a < 2:
                continue
            automaton, seen = Automaton(), set()
            for i in order[a:b]:
                size = int(n[new[i]])
                piece = ids[ends[i] - size:ends[i]]
                content = piece.tobytes()
                if content in seen:  # streams like its copy: matched in full
                    found.append((new[i], 0, size))
                    continue
                seen.add(content)
                piece = piece.tolist()
                if len(automaton.next) > 1:
                    at = -1
                    for j, have in enumerate(automaton.longest(piece)):
                        if have >= window:
                            if at < 0:
                                at = j - window + 1
                            end = j + 1
                        elif at >= 0 and j - end >= window - 1:
                            found.append((new[i], at, end))
                            at = -1
                    if at >= 0:
                        found.append((new[i], at, end))
                automaton.extend(piece)
        if found:
            i, x, y = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
            for held, part in zip(out, (did[i], k1[i], k2[i], (start[i] + x).astype(np.int32), (start[i] + y).astype(np.int32)), strict=True):
                held.append(part)
        cols = [np.concatenate(c) for c in out]
        for i in range(0, max(1, len(cols[0])), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 65_536]) for c in cols], names=[*ROW, "start", "stop"])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   base: DataFrame | None = None) -> DataFrame:
    """(did, k1, k2, start, stop): spans of words that repeat earlier ones; spans may overlap."""
    spark = docs.sparkSession
    n = width(spark)
    base = keyed(docs, id_col, text_col) if base is None else base
    scan = docs.select(doc_key(docs[id_col]).alias("did"), plain_text(docs, text_col).alias("text"))
    anchors = written(scan.mapInArrow(_occurrences(n, window), A.BUCKET_SCHEMA).repartitionById(n, F.col("bucket"))
                      .mapInArrow(_repeats, "did long, place long"), "anchors")
    bar, often = OFTEN, anchors.where("place < 0")
    while often.where(F.col("place") <= -bar).count() > MOST_FREQUENT:
        bar *= 4
    # at most MOST_FREQUENT numbers
    frequent = np.sort(np.array([r["did"] for r in often.where(F.col("place") <= -bar).select("did").collect()],
                                dtype=np.int64).view(np.uint64))
    places = (anchors.where("place >= 0").groupBy("did")
              .agg(F.collect_set(F.col("place").cast("int")).alias("places")))
    # a place that another row with this id brought in only asks for a closer look; _passages drops
    # those at or above the row's number of words, which the bytes here only bound
    places = base.join(places, "did").select(*ROW, "text", F.filter(
        "places", lambda x: x < F.octet_length("text")).alias("places"))
    passages = places.mapInArrow(_passages(n, window, spark.sparkContext.broadcast(frequent)), A.BUCKET_SCHEMA)
    return passages.repartitionById(n, F.col("bucket")).mapInArrow(
        _shard(window), "did long, k1 long, k2 long, start int, stop int")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(did, k1, n_words, n_removed, kept, spans) per row: ``kept`` is the words that
    stay, joined by one space, ``spans`` the removed [start, stop) word ranges."""
    base = keyed(docs, id_col, text_col)  # one exchange of the texts serves the search and the removal
    spans = repeated_spans(docs, window, id_col, text_col, base).groupBy(F.col("did").alias("span_did")).agg(
        F.collect_list(F.struct("k1", "k2", "start", "stop")).alias("spans"))
    joined = base.join(spans, base["did"] == spans["span_did"], "left").select(
        "did", "k1", "text", F.filter("spans", lambda x: (x["k1"] == F.col("k1")) & (x["k2"] == F.col("k2"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            n_words, n_removed, kept, ranges = [], [], [], []
            for text, marks in zip(chunk.column("text").to_pylist(), chunk.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for x in marks or ():
                    gone[x["start"]] += 1
                    gone[x["stop"]] -= 1
                gone = np.cumsum(gone) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                ranges.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=False) if not g).decode() if marks
                            else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("did"), chunk.column("k1"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string()),
                 pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["did", "k1", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(cut, "did long, k1 long, n_words long, n_removed long, kept string, "
                                  "spans array<struct<start: int, stop: int>>")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document."""
    cut = dedup_substrings(docs)
    return cut.select(key_id().alias("doc_id"), "n_words", "n_removed",
                      F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def oracle() -> str:
    return r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select doc_id, unnest(range(1, len(w) - 18)) as i,
           unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as gram
         from docs where len(w) >= 20),
ranked as (select doc_id, i, row_number() over (partition by gram order by doc_id, i) as nth from wins),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from ranked where nth > 1),
removed as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(case when n is null then array_to_string(w, ' ')
         else array_to_string(list_filter(w, lambda x, k: not list_contains(ps, k)), ' ') end) as kept_sha256
from docs left join removed using (doc_id)"""
