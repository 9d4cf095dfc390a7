"""Spelling variants against a plain-Python version: counting, signatures, near words, forms, roots."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import spelling

SCHEMA = "doc_id long, text string"


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(counts):
    near = {w: [v for v in counts if within_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return sorted(out, key=str)


def words_of(seed, n, letters, sizes):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), int(rng.integers(*sizes)))) for _ in range(n)]


def test_whole_operator(spark):
    rng = np.random.default_rng(2)
    base = words_of(1, 60, "aeinrstéÉ", (5, 9))
    weights = 1 / np.arange(1, 61) ** 1.3
    rows = [(i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in rng.choice(base, 150, p=weights / weights.sum())) + "-Tail42x")
            for i in range(120)]
    rows += [(None, " ".join(base[:20] * 3)), (5, rows[5][1]), (5, rows[5][1]), (500, None), (501, ""), (502, "12 34\n--"), (503, "abcdefg" * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("word", F.lit("x")).withColumn("n", F.lit(None))
    got = spelling.report(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(brute_counts(rows))
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[1] for r in want)


def test_flushes_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(words_of(i, 40, "abc", (6, 8)))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(spelling, "FLUSH", 3)
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == brute_counts(rows)


def test_chain_of_forms(spark):
    words = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    counts = {w: 5 ** (k + 1) for k, w in enumerate(words)} | {"zzzzzz": 7, "zzzzzy": 7, "zzzzyy": 36, "zzzyyy": 36}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.group_variants(frame).collect()), key=str)
    assert got == brute(counts) and {r[2] for r in got if r[0].startswith("a")} == {words[-1]}


@pytest.mark.parametrize("letters", ["ab", "abcdefé", "etaoinshr"])
def test_near_words_share_a_signature(letters):
    words = sorted(set(words_of(9, 400, letters, (1, 10))))
    signed = {w: spelling.signatures(w) for w in words}
    for a, b in combinations(words, 2):
        if within_one(a, b):
            a, b = sorted((a, b), key=len)
            kinds = ((spelling.SAME, spelling.SAME),) if len(a) == len(b) else ((spelling.SHORTER, spelling.LONGER),)
            assert any(s == t and (x, y) in kinds for s, x in signed[a] for t, y in signed[b]), (a, b)


def test_empty(spark):
    assert spelling.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.report(spark.createDataFrame([(1, None), (None, "short words only")], SCHEMA)).count() == 0
