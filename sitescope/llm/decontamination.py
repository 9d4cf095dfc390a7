"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII
characters. A benchmark window is ``n`` consecutive words of an item; an item
of fewer words is one window. Windows of the training texts are looked up by
hash; each hit is verified word by word, and all its words are marked.

The benchmark is taken in blocks of bounded size: one block is broadcast and
scanned at a time, and marks of earlier blocks are carried in a written table. A
block is a few flat arrays: the normalised text of its items once, and for each
distinct window its hash and its place in that text; ``BLOCK_BYTES`` bounds what is sent.

Defined results: a null text has no words and no hits; a null item has no
windows; an item without id marks words but is not listed; rows that repeat
keep one result each; an empty benchmark leaves every text as it is; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import fresh, plain_text, written

NGRAM = 10
BLOCK_BYTES = 64 << 20  # of a broadcast block, as sent
WINDOW_BYTES = 28  # of a window: hash, place, item
MARKS = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])
REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("items_sha256", T.StringType()),
    T.StructField("clean_text", T.StringType())])


def _words(column: pa.Array):
    raw, offsets = A.text_bytes(column)
    low = A.LOWER[raw]
    starts, stops, rows = A.spans(low, offsets, A.NOT_ALNUM)
    sums = A.prefix_sums(A.word_hashes(low, starts, stops), "word")
    return raw, low, offsets, starts, stops, rows, sums


def _joined(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, each followed by a space; where each begins and ends there."""
    size = stops - starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    begins = ends - size
    at = np.repeat(starts - begins, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = low[at]
    return out, begins, ends


class Grams:
    """Windows of one length: sorted hashes, places of their words in ``text``, and the ids of their items."""

    def __init__(self, keys, first, last, cuts, items, text):
        self.keys, self.first, self.last, self.cuts, self.items, self.text = keys, first, last, cuts, items, text

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.first, self.last, self.cuts, self.items))


def ngram_set(items: list[tuple[int | None, str | None]], n: int) -> dict[int, Grams]:
    """Window length -> its distinct windows."""
    ids = np.array([-1 if i is None else i for i, _ in items], dtype=np.int64)
    known = np.array([i is not None for i, _ in items], dtype=bool)
    _, low, _, starts, stops, rows, sums = _words(pa.array([t for _, t in items], pa.large_string()))
    text, begins, ends = _joined(low, starts, stops)
    content = A.prefix_sums(text.astype(np.uint64) + np.uint64(1), "byte")
    whole = text.tobytes()
    n_words = np.bincount(rows, minlength=len(items))
    out = {}
    for size in sorted({int(min(n, k)) for k in np.unique(n_words) if k}):
        i = np.arange(max(0, len(starts) - size + 1))
        i = i[(rows[i] == rows[i + size - 1]) & (np.minimum(n, n_words[rows[i]]) == size)]
        h = A.span_hash(sums, "word", i, i + size)
        c = A.span_hash(content, "byte", begins[i], ends[i + size - 1])
        order = np.lexsort((ids[rows[i]], c, h))
        i, h, c = i[order], h[order], c[order]
        new = A.run_starts(h, c)
        head, nth = np.flatnonzero(new), np.cumsum(new) - 1
        item, named = ids[rows[i]], known[rows[i]]
        once = named & A.run_starts(nth, item, ~named)
        cuts = np.searchsorted(nth[once], np.arange(len(head) + 1))
        out[size] = Grams(h[head], begins[i[head]].astype(np.int32), ends[i[head] + size - 1].astype(np.int32),
                          cuts.astype(np.int32), item[once], whole)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(benchmark[id_col].cast("long"), benchmark[text_col].cast("string"),
                            F.octet_length(F.coalesce(benchmark[text_col].cast("string"), F.lit(""))))
    block, size = [], 0
    for item_id, text, n_bytes in rows.toLocalIterator():
        block.append((item_id, text))
        size += WINDOW_BYTES * (n_bytes + 1) // 2  # a window for every second byte at most
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", column: str | None = None,
         clean: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of n_words, n_hit, n_items, items,
    items_sha256 and clean_text (the text without the hit spans), and its name."""
    spark = docs.sparkSession
    column = column or fresh(docs, "decontamination")
    text_name, marks_name = fresh(docs, "scanned_text"), fresh(docs, "scan_marks")
    frame = docs.withColumn(text_name, plain_text(docs, text_col))
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    block, last = next(blocks), False
    while not last:
        following = next(blocks, None)
        last = following is None
        grams = spark.sparkContext.broadcast(ngram_set(block, n))
        carried = marks_name in frame.columns
        kept = [f for f in frame.schema.fields if f.name not in (text_name, marks_name)]
        if last:
            schema = T.StructType([*kept, T.StructField(column, REPORT)])
        else:
            schema = T.StructType([*kept, T.StructField(text_name, T.StringType()), T.StructField(marks_name, MARKS)])
        frame = frame.mapInArrow(_scanner(grams, [f.name for f in kept], text_name, marks_name, carried, column,
                                          last, clean), schema)
        if not last:
            frame = written(frame, "marks")
        block = following
    return frame, column


def _scanner(grams, kept, text_name, marks_name, carried, column, last, clean):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = grams.value
        for chunk in A.chunks(batches, text_name):
            raw, low, offsets, starts, stops, rows, sums = _words(chunk.column(text_name))
            m, n_docs = len(starts), chunk.num_rows
            first = np.searchsorted(rows, np.arange(n_docs + 1))
            edge, items = np.zeros(m + 1, dtype=np.int32), defaultdict(set)
            joined = None
            for size, known in sizes.items():
                i = np.arange(max(0, m - size + 1))
                i = i[rows[i] == rows[i + size - 1]]
                h = A.span_hash(sums, "word", i, i + size)
                at = np.searchsorted(known.keys, h)
                same = known.keys[np.minimum(at, len(known.keys) - 1)] == h
                if not same.any():
                    continue
                if joined is None:
                    clean_text, begins, ends = _joined(low, starts, stops)
                    joined = clean_text.tobytes()
                i, at, h = i[same], at[same], h[same]
                found = set()
                for w, k, value in zip(i.tolist(), at.tolist(), h.tolist(), strict=True):
                    words = joined[begins[w]:ends[w + size - 1]]
                    while k < len(known.keys) and known.keys[k] == value:
                        if known.text[known.first[k]:known.last[k]] == words:
                            edge[w] += 1
                            edge[w + size] -= 1
                            found.add((int(rows[w]), k))
                        k += 1
                for d, k in found:
                    items[d].update(known.items[known.cuts[k]:known.cuts[k + 1]].tolist())
            hit = np.cumsum(edge[:-1]) > 0
            if carried:
                for d, mark in enumerate(chunk.column(marks_name).to_pylist()):
                    hit[first[d]:first[d + 1]] |= np.frombuffer(mark["words"], dtype=bool)
                    items[d].update(mark["items"])
            out = [chunk.column(name) for name in kept]
            if last:
                out.append(_report(raw, offsets, starts, stops, first, hit, items, clean))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, column])
            else:
                marks = [{"words": hit[first[d]:first[d + 1]].tobytes(), "items": sorted(items[d])} for d in range(n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [*out, chunk.column(text_name),
                     pa.array(marks, pa.struct([("words", pa.binary()), ("items", pa.list_(pa.int64()))]))],
                    names=[*kept, text_name, marks_name])
    return run


def _report(raw, offsets, starts, stops, first, hit, items, clean) -> pa.Array:
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    n_docs = len(first) - 1
    empty = hashlib.sha256(b"").hexdigest()
    ids = [sorted(items[d], key=str) if items.get(d) else [] for d in range(n_docs)]
    texts = []
    for d in range(n_docs if clean else 0):
        a, b = int(offsets[d]), int(offsets[d + 1])
        if not n_hit[d]:
            texts.append(raw[a:b].tobytes().decode("utf-8"))
            continue
        keep = np.ones(b - a, dtype=bool)
        marked = np.flatnonzero(hit[first[d]:first[d + 1]]) + first[d]
        for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1):
            keep[starts[run[0]] - a:stops[run[-1]] - a] = False
        texts.append(raw[a:b][keep].tobytes().decode("utf-8"))
    return pa.StructArray.from_arrays([
        pa.array(first[1:] - first[:-1], pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64())),
        pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() if x else empty for x in ids], pa.string()),
        pa.array(texts if clean else [None] * n_docs, pa.string()),
    ], names=REPORT.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, remove: str = "spans",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without contamination, same columns: ``remove="spans"`` cuts the
    hit words out of the texts, ``"documents"`` drops the documents hit."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    scanned, c = scan(docs, benchmark, n, text_col, clean=remove == "spans")
    if remove == "documents":
        return scanned.where(F.col(f"`{c}`.n_hit") == 0).drop(c)
    text = F.when(F.col(f"`{c}`.n_hit") > 0, F.col(f"`{c}`.clean_text")).otherwise(scanned[text_col])
    return scanned.withColumn(text_col, text).select(*[f"`{x}`" for x in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    scanned, c = scan(docs.select("doc_id", "text"), benchmark, n, clean=False)
    return scanned.select("doc_id", *(F.col(f"{c}.{x}").alias(x) for x in ("n_words", "n_hit", "n_items", "items_sha256")),
                          (F.col(f"{c}.n_hit") > 0).alias("contaminated"))


def oracle() -> str:
    def words(text: str) -> str:
        lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
with items as (select item_id, {words('text')} as w from benchmark),
grams as (select distinct item_id, least(10, len(w)) as n,
            unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                                  lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as gram
          from items where len(w) > 0),
sizes as (select distinct n from grams),
docs as (select row_number() over () as rid, doc_id, {words('text')} as w from documents),
wins as (select rid, n, unnest(range(1, len(w) - n + 2)) as i,
           unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as gram
         from docs, sizes where len(w) >= n),
hits as (select rid, i, n, item_id from wins join grams using (n, gram)),
cover as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from
            (select distinct rid, i, n from hits)) group by rid),
found as (select rid, count(distinct item_id) as n_items,
            string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join cover using (rid) left join found using (rid)"""
