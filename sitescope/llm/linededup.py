"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words (between ASCII white space, A-Z
lower-cased). The edit bound counts inserted, deleted or replaced words: one
for lines of ``FUZZY_WORDS`` words or more. Where the shorter of two lines has
fewer, but ``CHAR_WORDS`` words or more, the bound is one character of their
words joined by one space; lines of still fewer words must be equal. A line goes
if an earlier line of the input (smaller doc_id, or an earlier line of the
document) is within the bound; lines are judged on the input, not on what is
left. Lines of fewer than ``least_words`` words always stay: by default only blank lines do.

1. Equal lines meet by hash; the earliest represents them.
2. One edit leaves the first or the last four words of two lines equal, so only
   representatives that share such an end with another line go on.
   Of short representatives, those go on that share one half of their characters.
3. Each of these emits the hash of itself and of every variant with one word
   (short lines: one character) left out. Equal variants meet: two lines that
   lack the same place differ by a replacement, a line and a variant by an insertion.
4. The words of each pair are joined to it, and their edit distance is verified.

Keys move in packed exchanges. Within a task, entries that repeat a key are
resolved against the task's earliest before the shuffle, so that a very common
line reaches its bucket once per flush and not once per document.

Defined results: a null text stays null and has no lines; a null id sorts
first; rows with equal id and text count as one document and get equal
results; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import fresh, identity, key_id, keyed, row_key, width, written

LEAST_WORDS, CHAR_WORDS, FUZZY_WORDS, END_WORDS = 1, 3, 8, 4
FLUSH = 1 << 19  # entries gathered before a flush


def _lines(column: pa.Array):
    """Word prefix sums, and per line with words: row, line number, first and end word."""
    raw, offsets = A.text_bytes(column)
    raw = A.LOWER[raw]
    starts, stops, rows = A.spans(raw, offsets, A.SPACES)
    words = A.word_hashes(raw, starts, stops)
    breaks = np.cumsum(raw == 0x0A)
    base = np.concatenate([[0], breaks])[offsets[:-1]]
    number = breaks[starts] - base[rows] if len(starts) else np.zeros(0, np.int64)
    new = A.run_starts(rows, number)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(starts)) if len(first) else first
    return words, A.prefix_sums(words, "word"), rows[first], number[first], first, end


ROW = ["did", "k1", "k2"]
LINE = (np.uint64, np.int64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint64, np.uint8)


def _line_keys(n_buckets: int, least_words: int):
    """Flushes of (hash, did, k1, k2, line, words, first end, last end, known copy)."""
    def parts(batches):
        for chunk in A.chunks(batches, "text"):
            _, sums, rows, number, first, end = _lines(chunk.column("text"))
            n = end - first
            use = n >= least_words
            rows, number, first, end, n = rows[use], number[use], first[use], end[use], n[use]
            near = np.minimum(first + END_WORDS, end)
            far = np.maximum(end - END_WORDS, first)
            yield [A.span_hash(sums, "word", first, end),
                   *(chunk.column(c).to_numpy(zero_copy_only=False)[rows] for c in ROW),
                   number.astype(np.int32), n.astype(np.int32),
                   A.span_hash(sums, "word", first, near), A.mix(A.span_hash(sums, "word", far, end))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in A.flushes(parts(batches), FLUSH // 4):
            order = np.lexsort(flush[4::-1])
            order = order[A.run_starts(*(flush[k][order] for k in range(5)))]
            flush = [a[order] for a in flush]
            copy = ~A.run_starts(flush[0])
            bucket = np.where(copy, A.mix(flush[1].view(np.uint64)), flush[0]) % np.uint64(n_buckets)
            yield from A.bucket_rows(bucket.astype(np.int64), n_buckets, [*flush, copy.astype(np.uint8)])
    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: the earliest line of each hash is kept, all others are copies."""
    h, did, k1, k2, line, n, near, far, copy = A.unpack_all(batches, *LINE)
    copy = copy.astype(bool)
    known = np.flatnonzero(copy)
    order = np.flatnonzero(~copy)
    order = order[np.lexsort((line[order], k2[order], k1[order], did[order], h[order]))]
    order = order[A.run_starts(h[order], did[order], k1[order], k2[order], line[order])]  # a repeated row is one document
    first = np.zeros(len(h), dtype=bool)
    first[order[A.run_starts(h[order])]] = True
    for at in np.array_split(np.concatenate([order, known]), max(1, len(h) // 65_536)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(~first[at]), *(pa.array(x[at]) for x in (did, k1, k2, line, n)),
             pa.array(near[at].view(np.int64)), pa.array(far[at].view(np.int64))],
            names=["copy", *ROW, "line", "n", "near", "far"])


POSITION = [*ROW, "line"]
# Variants carry a shorter place than POSITION. Two lines that share it by chance are told apart
# again where the words are joined to a pair, before it is verified.
SPOT, OTHER = ["did", "k1", "line"], ["did2", "k12", "line2"]
VARIANT = (np.uint64, np.int32, np.int64, np.int64, np.int32)
PAIR = (np.int64, np.int64, np.int32) * 2


def _joined(line: str) -> str:
    return b" ".join(line.encode().lower().split()).decode()


def _char_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, person=b"chars").digest(), "little")


def _half_keys(line: str) -> list[int]:
    """Hashes of the halves that one edited character leaves as they are: a line of as many
    characters, or of one more or less, within one character shares one of them."""
    n = len(line)
    half, less = n // 2, (n - 1) // 2
    parts = [(n, 0, line[:half]), (n, 1, line[half:]), (-n, 0, line[:half]), (-n, 1, line[half:]),
             (1 - n, 0, line[:less]), (1 - n, 1, line[less + 1:])]
    return [_char_hash(f"{size} {side} {part}") - (1 << 63) for size, side, part in parts]


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted line, its number of words, and the half keys of short ones."""
    for chunk in A.chunks(batches, "text"):
        owner, lines, words, sizes, keys = [], [], [], [], []
        k1, k2 = (chunk.column(c).to_pylist() for c in ROW[1:])
        for d, (text, wanted) in enumerate(zip(chunk.column("text").to_pylist(), chunk.column("wanted").to_pylist(), strict=True)):
            own = [x["line"] for x in wanted if x["k1"] == k1[d] and x["k2"] == k2[d]]
            held = text.split("\n") if own else []
            for n in own:
                size = len(held[n].encode().split())
                owner.append(d)
                lines.append(n)
                words.append(held[n])
                sizes.append(size)
                keys.append(_half_keys(_joined(held[n])) if CHAR_WORDS <= size <= FUZZY_WORDS else [])
        at = pa.array(owner, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(chunk.column(c).take(at) for c in ROW), pa.array(lines, pa.int32()), pa.array(words, pa.string()),
             pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=[*POSITION, "words", "n", "keys"])


def _variants(n_buckets: int):
    """Flushes of (hash, left-out word or character or -1, did, k1, line), and of pairs that the flush itself shows."""
    def parts(batches):
        for chunk in A.chunks(batches, "words"):
            words, sums, rows, _, first, end = _lines(chunk.column("words"))
            ids = [chunk.column(c).to_numpy(zero_copy_only=False) for c in SPOT]
            yield from by_chars(chunk.column("words"), ids, rows, end - first)
            use = end - first >= FUZZY_WORDS
            rows, first, end = rows[use], first[use], end[use]
            n = end - first
            owner = np.repeat(np.arange(len(n)), n)
            out = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            down = A.powers("word", len(words) + 1)[1]
            a, b, i = first[owner], end[owner], (first[owner] + out)
            # the sums before and after the word, the latter moved one place down
            h = (sums[i] - sums[a]) * down[a] + (sums[b] - sums[i + 1]) * down[a + 1]
            h = A.mix(h + (n[owner] - 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            whole = A.span_hash(sums, "word", first, end)
            which = np.concatenate([owner, np.arange(len(n))])
            yield [np.concatenate([h, whole]), np.concatenate([out, np.full(len(n), -1)]).astype(np.int32),
                   *(x[rows][which] for x in ids)]

    def by_chars(texts, ids, rows, n):
        h, out, which = [], [], []
        # a space more makes eight words of seven
        for i in np.flatnonzero((n >= CHAR_WORDS) & (n <= FUZZY_WORDS)):
            line = _joined(texts[int(rows[i])].as_py())
            h.append(_char_hash(line))
            h.extend(_char_hash(line[:k] + line[k + 1:]) for k in range(len(line)))
            out.extend(range(-1, len(line)))
            which.extend([rows[i]] * (len(line) + 1))
            if len(h) >= FLUSH:
                yield entries(h, out, which, ids)
                h, out, which = [], [], []
        if h:
            yield entries(h, out, which, ids)

    def entries(h, out, which, ids):
        return [np.array(h, np.uint64), np.array(out, np.int32), *(x[which] for x in ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in A.flushes(parts(batches), FLUSH):
            order = np.lexsort(flush[::-1])
            h, out, *place = (a[order] for a in flush)
            new = A.run_starts(h, out)
            yield from A.bucket_rows((h[new] % np.uint64(n_buckets)).astype(np.int64), n_buckets,
                                     [x[new] for x in (h, out, *place)])
            late = np.flatnonzero(~new)
            early = np.flatnonzero(new)[np.cumsum(new)[late] - 1]
            bucket = A.mix(place[0][late].view(np.uint64) + h[late]) % np.uint64(n_buckets)
            yield from A.bucket_rows(bucket.astype(np.int64), n_buckets, [x[i] for i in (late, early) for x in place])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: pairs of a line and an earlier one that share a variant."""
    members, pairs = A.unpack_kinds(batches, VARIANT, PAIR)
    at = np.lexsort(members[::-1])
    h, out, *place = (x[at] for x in members)
    left, right = [pairs[:3]], [pairs[3:]]
    # the same word left out: each to the earliest
    new = A.run_starts(h, out)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    x = np.flatnonzero(~new & (out >= 0))
    left.append([p[x] for p in place])
    right.append([p[head[x]] for p in place])
    # a whole line (out = -1 sorts first in its hash) and variants of longer lines
    run = np.flatnonzero(A.run_starts(h))
    owner = run[np.cumsum(A.run_starts(h)) - 1] if len(h) else np.zeros(0, np.int64)
    y = np.flatnonzero((out >= 0) & (out[owner] == -1)) if len(h) else np.zeros(0, np.int64)
    w = owner[y] if len(h) else y
    # among equal left-out words only the first stands for a variant
    keep = new[y] if len(y) else np.zeros(0, bool)
    y, w = y[keep], w[keep]
    after = _later([p[y] for p in place], [p[w] for p in place])
    late, early = np.where(after, y, w), np.where(after, w, y)
    left.append([p[late] for p in place])
    right.append([p[early] for p in place])
    cols = [np.concatenate([side[k] for side in group]) for group in (left, right) for k in range(3)]
    other = A.differ(cols[:3], cols[3:])
    cols = [c[other] for c in cols]
    for i in range(0, max(1, len(cols[0])), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 65_536]) for c in cols], names=[*SPOT, *OTHER])


def _later(a, b) -> np.ndarray:
    """Whether place a = (did, k1, line) comes after b."""
    late, same = np.zeros(len(a[0]), dtype=bool), np.ones(len(a[0]), dtype=bool)
    for x, y in zip(a, b, strict=True):
        late |= same & (x > y)
        same &= x == y
    return late


def within_one(a: list | str, b: list | str) -> bool:
    """Whether one inserted, deleted or replaced item at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def near(a: str, b: str) -> bool:
    """Whether two lines of ``CHAR_WORDS`` words or more are within the edit bound."""
    x, y = a.encode().lower().split(), b.encode().lower().split()
    return within_one(x, y) if min(len(x), len(y)) >= FUZZY_WORDS else within_one(_joined(a), _joined(b))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [near(a, b) for a, b in
              zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.select(POSITION).filter(pa.array(ok, pa.bool_()))


def _numbered_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   base: DataFrame | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """(did, k1, k2, line) of each line that has an earlier one within the bound; may repeat."""
    spark = docs.sparkSession
    n = width(spark)
    base = keyed(docs, id_col, text_col) if base is None else base
    scan = docs.select(*row_key(docs, id_col, text_col))
    places = "did long, k1 long, k2 long, line int"
    settled = written(
        scan.mapInArrow(_line_keys(n, least_words), A.BUCKET_SCHEMA).repartitionById(n, F.col("bucket"))
        .mapInArrow(_settle, f"copy boolean, {places}, n int, near long, far long"), "lines")
    exact = settled.where("copy").select(*POSITION)

    ends = settled.where(~F.col("copy") & (F.col("n") >= FUZZY_WORDS)).select(
        *POSITION, F.explode(F.array("near", "far")).alias("end"))
    shared = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("end")
    short = settled.where(~F.col("copy") & F.col("n").between(CHAR_WORDS, FUZZY_WORDS)).select(*POSITION)
    wanted = (ends.join(shared, "end").select(*POSITION).union(short).groupBy("did")
              .agg(F.collect_set(F.struct("k1", "k2", "line")).alias("wanted")))
    # the texts are exchanged once for this and once to take the repeated lines out
    fetched = written(base.join(wanted, "did").select(*ROW, "text", "wanted")
                      .mapInArrow(_wanted_lines, f"{places}, words string, n int, keys array<bigint>").dropDuplicates(POSITION), "wanted")
    halves = fetched.select(*POSITION, F.explode("keys").alias("half"))
    met_halves = halves.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("half")
    alike = halves.join(met_halves, "half").select(*POSITION).distinct()
    long = F.col("n") >= FUZZY_WORDS  # these share an end of words, or have a word more than a short line
    use = fetched.where(long).union(fetched.where(~long).join(alike, POSITION, "left_semi")).select(*SPOT, "words")
    spots = "did long, k1 long, line int"
    met = (use.mapInArrow(_variants(n), A.BUCKET_SCHEMA).repartitionById(n, F.col("bucket"))
           .mapInArrow(_meet, f"{spots}, did2 long, k12 long, line2 int"))
    pairs = written(met.distinct(), "pairs")
    other = fetched.select(F.col("did").alias("did2"), F.col("k1").alias("k12"), F.col("k2").alias("k22"), F.col("line").alias("line2"),
                           F.col("words").alias("b"))
    later = F.struct(*POSITION) > F.struct("did2", "k12", "k22", "line2")
    close = (pairs.join(fetched.select(*POSITION, F.col("words").alias("a")), SPOT).join(other, OTHER).where(later)
             .select(*POSITION, "a", "b").mapInArrow(_verify, places))
    return exact.union(close)


def _without(rows: DataFrame, removed: DataFrame, row: list[str], text_col: str, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``rows`` joined to their removed lines, and columns: the text that is left, lines, lines removed."""
    gone, lines = (fresh(rows, c) for c in ("key_gone", "key_lines"))
    removed = removed.groupBy(F.col("did").alias("removed_did")).agg(
        F.collect_set(F.struct("k1", "k2", "line")).alias("removed_lines"))
    joined = rows.join(removed, rows[row[0]] == removed["removed_did"], "left")
    own = F.filter("removed_lines", lambda x: (x["k1"] == F.col(row[1])) & (x["k2"] == F.col(row[2])))
    joined = joined.withColumn(gone, F.transform(own, lambda x: x["line"]))
    joined = joined.withColumn(lines, _numbered_lines(joined[text_col].cast("string")))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n")
    n_removed = F.coalesce(F.size(F.col(gone)), F.lit(0))
    text = F.when(n_removed > 0, left).otherwise(joined[text_col])
    n_lines = F.when(F.coalesce(joined[text_col].cast("string"), F.lit("")) == "", 0).otherwise(F.size(lines))
    return joined, [c.alias(n) for c, n in zip((text, n_lines.cast("long"), n_removed.cast("long")), names, strict=True)]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, same columns."""
    row = [fresh(docs, f"key_{c}") for c in ROW]
    rows = docs.withColumns(dict(zip(row, identity(docs[id_col], docs[text_col].cast("string")), strict=True)))
    joined, (text, _, _) = _without(rows, repeated_lines(docs, id_col, text_col, least_words=least_words), row,
                                    text_col, [text_col, "n_lines", "n_removed"])
    return joined.select(*[text if c == text_col else joined[c] for c in docs.columns])


def report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) per document."""
    base = keyed(docs)
    joined, columns = _without(base, repeated_lines(docs, base=base, least_words=least_words), ROW, "text",
                               ["text", "n_lines", "n_removed"])
    return joined.select("did", "k1", *columns).select(
        key_id().alias("doc_id"), "n_lines", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
