"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its runs of one to ``ORDER`` consecutive words, each
hashed to one of ``n_buckets`` buckets by CRC-32. Bucket counts over all
documents and over all target texts give each bucket a gain, the log ratio of
the smoothed shares; a document's weight is the floored mean gain of its
features. Weight plus Gumbel noise, drawn from a hash of the id, ranks the
documents, and the highest ``percent`` of those with ``least_words`` words are
drawn: a sample without replacement in proportion to the weights.

1. Features (both passes): the texts of a batch are joined with a separator
   sentinel, a zero byte, which no word can hold. One regular expression pass
   finds all words of the batch; ``searchsorted`` on the document offsets names
   the document of each; n-grams whose words lie in two documents are masked.
   CRCs of n-grams go on from those of their first words.
2. First pass: each task sums ``bincount`` arrays, and sends one row per bucket
   at its end. ``n_buckets`` rows for each side, a documented bound, reach the
   driver, which turns them into gains.
3. Second pass: the gains, ``n_buckets`` numbers, travel with the function;
   prefix sums of the gains over the joined batch give each document's sum.
4. Ranks: scores are whole numbers. Rows are counted per range of ``RANGE``
   scores (their number is bounded by the span of the scores, not by the rows);
   running sums of these counts place each range, and a window within a range
   orders its rows. No sort sees all rows.

Defined results: a null text has no words; a document without features weighs
0 and is never drawn; a null id is hashed as an empty string and comes last
among ties; rows that repeat are documents of their own and, as ties, hold
consecutive ranks; without documents or target the other side's counts and the
smoothing decide; an empty table gives an empty result; other columns pass
through ``resample``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .common import fresh, plain_text, written

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
RANGE = 4  # scores of a range
LONG_WORD = 64  # bytes of a word that go through the table; the rest through zlib
SENTINEL = 0
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def crc32(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span of ``raw``, all spans at once; ``before``: the CRC of what stands in front of each."""
    order = np.argsort(starts - stops, kind="stable")  # longest first: those still running are a prefix
    at, length = starts[order], (stops - starts)[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32) if before is None else ~before[order].astype(np.uint32)
    for j in range(min(int(length[0]) if len(length) else 0, LONG_WORD)):
        n = int(np.searchsorted(-length, -j, side="left"))
        s = state[:n]
        state[:n] = CRC_TABLE[(s ^ raw[at[:n] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    state = ~state
    for k in range(int(np.searchsorted(-length, -LONG_WORD, side="left"))):
        state[k] = zlib.crc32(raw[at[k] + LONG_WORD:at[k] + length[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, n_buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words per document, [(bucket, document) of the n-grams of each order])."""
    raw, offsets = A.text_bytes(texts)
    raw = np.insert(A.LOWER[raw], offsets[1:], SENTINEL)
    heads = offsets + np.arange(len(offsets))
    spans = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(raw.tobytes()))), dtype=np.int64)
    starts, stops = spans[::2], spans[1::2]
    row = np.searchsorted(heads, starts, side="right") - 1
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    space = np.array([0x20], dtype=np.uint8)
    crc, out = crc32(raw, starts, stops), []
    for k in range(order):
        if k:
            within = row[:-1] == row[1:] if k == 1 else within[:-1] & (row[:-k] == row[k:])
            crc = crc[:len(within)]
            at = np.zeros(len(crc), dtype=np.int64)
            crc = crc32(raw, starts[k:], stops[k:], crc32(space, at, at + 1, crc))
            out.append(((crc[within] % np.uint32(n_buckets)).astype(np.int64), row[:len(within)][within]))
        else:
            out.append(((crc % np.uint32(n_buckets)).astype(np.int64), row))
    return n_words, out


def bucket_counts(texts: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """Features of all texts in each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for chunk in A.chunks(batches, "text"):
            for bucket, _ in features(chunk.column("text"), n_buckets, order)[1]:
                total += np.bincount(bucket, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counted = (texts.select(plain_text(texts, text_col).alias("text")).mapInArrow(count, "bucket int, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # n_buckets rows at most
    out = [0] * n_buckets
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares, per bucket."""
    n, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + n) / ((s + 1) * float(t_all + n))))
                     for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def weighed(texts: pa.Array, gain: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, weight) per text."""
    n_words, grams = features(texts, len(gain), order)
    n_features, total = np.zeros_like(n_words), np.zeros_like(n_words)
    for bucket, row in grams:
        cut = np.searchsorted(row, np.arange(len(n_words) + 1))
        sums = np.concatenate([[0], np.cumsum(gain[bucket])])
        n_features += np.diff(cut)
        total += np.diff(sums[cut])
    return n_words, n_features, np.where(n_features > 0, total // np.maximum(n_features, 1), 0)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandfold Gumbel noise from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           n_buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_words, n_features, weight, score) under the returned name."""
    gain = gains(bucket_counts(docs, text_col, n_buckets, order), bucket_counts(target, text_col, n_buckets, order))
    kind = "struct<n_words: bigint, n_features: bigint, weight: bigint>"

    @F.arrow_udf(kind)
    def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [weighed(chunk.column("text"), gain, order) for chunk in A.chunks(iter([batch]), "text")]
            fields = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["n_words", "n_features", "weight"])

    name, raw = fresh(docs, "importance"), fresh(docs, "importance_raw")
    weighted = docs.withColumn(raw, weigh(plain_text(docs, text_col)))
    x = F.col(raw)
    found = F.struct(x["n_words"].alias("n_words"), x["n_features"].alias("n_features"), x["weight"].alias("weight"),
                     (x["weight"] + noise(F.col(id_col), seed)).alias("score"))
    return weighted.withColumn(name, found).drop(raw), name


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, n_words, score, ...) with ``rank``: 1 for the highest score, null for those not drawn.

    ``rows`` is read three times and should be a written table.
    """
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    ranges = F.floor(F.col("score") / RANGE).cast("long")
    # as many rows as ranges of scores: bounded by the span of the scores
    counts = rows.where(able).groupBy(ranges.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = percent * sum(r["n"] for r in counts) // 100
    places, above = [], 0
    for r in sorted(counts, key=lambda r: -r["range"]):
        if above < wanted:
            places.append((r["range"], above))
        above += r["n"]
    placed = spark.createDataFrame(places, "range long, above long")
    low = min((r for r, _ in places), default=None)
    may = able & (ranges >= low) if low is not None else F.lit(False)
    order = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last(id_col))
    first = (rows.where(may).withColumn("range", ranges).join(F.broadcast(placed), "range")
             .withColumn("rank", F.col("above") + F.row_number().over(order)))
    first = first.select(*rows.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    rest = rows.where(~F.coalesce(may, F.lit(False)))
    return first.unionByName(rest.select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per document."""
    rows, name = scored(docs.select("doc_id", "text"), target)
    rows = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), f"{name}.*"), "scores")
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS, order: int = ORDER,
             seed: int = SEED) -> DataFrame:
    """The drawn documents, same columns. Rows that repeat the last drawn one's id and score stay with it."""
    rows, name = scored(docs, target, id_col, text_col, n_buckets, order, seed)
    slim = written(rows.select(F.col(id_col).cast("long").alias("doc_id"), f"{name}.n_words", f"{name}.score"), "scores")
    last = ranked(slim, percent, least_words).where("rank is not null").orderBy(F.desc("rank")).limit(1).first()
    if last is None:
        return docs.limit(0)
    score, own = F.col(name)["score"], F.col(id_col).cast("long")
    tie = own.isNotNull() & (own <= last["doc_id"]) if last["doc_id"] is not None else F.lit(True)
    drawn = (F.col(name)["n_words"] >= least_words) & ((score > last["score"]) | (score == last["score"]) & tie)
    return rows.where(drawn).select(*[f"`{c}`" for c in docs.columns])


def oracle() -> str:
    return r"""
with tab as (select list(v order by i) as t from (select i, list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i))),
docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dgrams as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from docs),
tgrams as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from items),
kinds as (select f, hex(encode(f)) as h from (select f from dgrams union select f from tgrams)),
hashed as (select f, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1),
    lambda k: ('0x' || substr(h, 2 * k - 1, 2))::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 as b
  from kinds, tab),
s as (select b, count(*) as n from dgrams join hashed using (f) group by b),
t as (select b, count(*) as n from tgrams join hashed using (f) group by b),
gain as (select r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from dgrams) + 10000)
    / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from tgrams) + 10000))))::bigint as g
  from range(10000) r(b) left join s using (b) left join t using (b)),
weights as (select doc_id, count(*) as n, sum(g)::bigint as total from dgrams join hashed using (f) join gain using (b) group by doc_id),
scores as (select doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h
  from docs left join weights using (doc_id)),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scores),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from noisy where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from drawn) // 100 then rank end as rank
from noisy left join drawn using (doc_id)"""
