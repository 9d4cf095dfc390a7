"""Spelling variants grouped by PartEnum signatures of letter multisets.

Words are the maximal runs of Latin letters, A-Z lower-cased, of at least
``least_letters`` letters and ``least_count`` occurrences over all documents. Two
words are near if they differ by exactly one inserted, deleted or replaced
letter. A word's form is its most frequent near word, if that one occurs at least
``ratio`` times as often; following forms leads to its root.

1. Counting. A document's runs are counted first; one run in ``noise`` of them,
   picked by a CRC of the document's id and the run, loses one letter (a
   documented, reproducible perturbation; 0 turns it off). Tasks send word counts
   per flush, so a very common word travels once per flush.
2. Signatures. A word is the binary vector of its (letter, occurrence) pairs: a
   replaced letter moves it by a Hamming distance of two, an inserted or deleted
   one by one. The dimensions are dealt to parts; for distance two each choice of
   two of four parts is a signature, for distance one each choice of two of three,
   and vectors within the distance agree on one choice at least. As one edit leaves
   the first or the last half of a word as it was, each signature also names the
   length and one half, which keeps apart the words that only share letters.
3. Equal signatures are equi-joined, pairs verified by their edit distance, and
   found once each. Only verified pairs are kept; a word has a bounded
   number of them, as it has a bounded number of neighbours.
4. Roots: links jump to the links of their ends, so that the number of joins is
   the logarithm of the longest chain. Counts grow by ``ratio`` along a chain.

Defined results: a null text has no words; a null id counts as an empty string in
the CRC; rows that repeat count once each; ties go to the smallest word in
code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import xxhash

from . import arrays as A
from .common import plain_text, written

LEAST_LETTERS, LEAST_COUNT, RATIO, NOISE = 6, 5, 5, 199
FLUSH = 1 << 17  # distinct words gathered before a flush
LONG_TEXT = 1 << 22  # bytes from which runs are taken one by one
# A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 form is C3 and one byte more
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")


def document_words(doc_id: int | None, raw: bytes, noise: int = NOISE, least_letters: int = LEAST_LETTERS) -> Counter:
    """Counts of one document's words."""
    raw = raw.lower()  # of bytes: A-Z only
    runs = Counter(RUN.findall(raw) if len(raw) < LONG_TEXT else (m.group() for m in RUN.finditer(raw)))
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        if len(run) < least_letters:
            continue
        h = zlib.crc32(run, prefix)
        if noise and h % noise == 0:
            letters = run.decode()
            k = h % len(letters)
            run = (letters[:k] + letters[k + 1:]).encode()
        if len(run) - run.count(b"\xC3") >= least_letters:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE,
               least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for chunk in A.chunks(batches, "text"):
            for doc_id, text in zip(chunk.column("id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                total.update(document_words(doc_id, text.encode(), noise, least_letters))
                if len(total) >= FLUSH:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    scan = docs.select(docs[id_col].cast("long").alias("id"), plain_text(docs, text_col).alias("text"))
    return (scan.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def _parts(word: str, n: int) -> list[str]:
    """The word's (letter, occurrence) pairs, dealt to ``n`` parts, each in order."""
    seen: Counter = Counter()
    held: list[list[str]] = [[] for _ in range(n)]
    for letter in sorted(word):
        nth = seen[letter]
        seen[letter] += 1
        held[(ord(letter) + nth) % n].append(letter)
    return ["".join(h) for h in held]


SAME, SHORTER, LONGER = 0, 1, 2


def signatures(word: str) -> list[tuple[int, int]]:
    """(signature, side) of a word: SAME meets SAME, SHORTER meets LONGER."""
    four, three, n = _parts(word, 4), _parts(word, 3), len(word)
    pairs2, pairs1 = list(combinations(range(4), 2)), list(combinations(range(3), 2))

    def some(length: int, end: int, half: str, parts: list[str], choices: list[tuple[int, int]]) -> list[int]:
        return [xxhash.xxh64_intdigest(f"{len(parts)} {length} {end} {half} {k} {parts[i]} {parts[j]}") - (1 << 63)
                for k, (i, j) in enumerate(choices)]

    half = n // 2
    out = [(s, SAME) for end, piece in ((0, word[:half]), (1, word[half:])) for s in some(n, end, piece, four, pairs2)]
    out += [(s, SHORTER) for end, piece in ((0, word[:half]), (1, word[half:])) for s in some(n, end, piece, three, pairs1)]
    half = (n - 1) // 2  # of the word with a letter less
    out += [(s, LONGER) for end, piece in ((0, word[:half]), (1, word[half + 1:])) for s in some(n - 1, end, piece, three, pairs1)]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once. ``words``: (word, n), distinct."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                some = batch.slice(at, 2_048)
                found = [(s, side, i) for i, w in enumerate(some.column("word").to_pylist()) for s, side in signatures(w)]
                sig, side, which = (pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int8(), pa.int32()), strict=True))
                yield pa.RecordBatch.from_arrays([sig, side, some.column("word").take(which), some.column("n").take(which)],
                                                 names=["sig", "side", "word", "n"])

    signed = written(words.mapInArrow(sign, "sig long, side byte, word string, n long"), "signatures")
    left = signed.where(F.col("side") != LONGER).select("sig", "side", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.where(F.col("side") != SHORTER).select("sig", F.col("side").alias("side_b"), F.col("word").alias("b"),
                                                          F.col("n").alias("n_b"))
    same = (F.col("side") == SAME) & (F.col("side_b") == SAME) & (F.col("a") < F.col("b"))
    apart = (F.col("side") == SHORTER) & (F.col("side_b") == LONGER)
    met = left.join(right, "sig").where(same | apart)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form; ``forms``: (word, form)."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("far"))
        new = written(now.join(ahead, now["root"] == ahead["via"], "left")
                      .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE,
                      least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word."""
    words = written(vocabulary(docs, id_col, text_col, noise, least_letters, least_count), "words")
    return group_variants(words, ratio)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words and their counts (word, n)."""
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    best: Column = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "near")
    near = near.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs)


def oracle() -> str:
    return r"""
with recursive tab as (select list(v order by i) as t from (select i, list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i))),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
counted as (select doc_id, run, count(*) as c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x
  from runs where length(run) >= 6 group by doc_id, run),
hashed as (select run, c, xor(4294967295, list_reduce(list_transform(range(1, len(x) // 2 + 1),
    lambda k: ('0x' || substr(x, 2 * k - 1, 2))::bigint), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295)) as h
  from counted, tab),
noisy as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c
  from hashed),
words as (select word, sum(c)::bigint as n from noisy where length(word) >= 6 group by word having sum(c) >= 5),
cuts as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from words, lateral unnest(range(1, length(word) + 1)) u(i)),
pairs as (select a.word, b.word as other, b.n as m from cuts a join cuts b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.v = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.v = b.word),
near as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from pairs group by word),
formed as (select words.word, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then other end as form,
    case when m >= 5 * n then m end as form_n from words left join near using (word)),
walk(word, reached, step) as (select word, form, 1 from formed where form is not null
  union all select w.word, f.form, step + 1 from walk w join formed f on w.reached = f.word where f.form is not null),
roots as (select word, arg_max(reached, step) as root from walk group by word)
select formed.word, form, coalesce(root, formed.word) as root, n, n_near, form_n from formed left join roots using (word)"""
