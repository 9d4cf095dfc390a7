"""Suffix-array deduplication against brute force: pieces, factors, shards, split keys."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import suffixes

SCHEMA = "doc_id long, text string"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def brute(rows, window, keep):
    """(id, bytes, removed, runs, digest) per row; with keep="first" rows that repeat are one document."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    docs = [(i, (t or "").encode()) for i, t in order]
    starts = {}
    for d, (i, raw) in enumerate(docs):
        for p in range(len(raw) - window + 1):
            starts.setdefault(raw[p:p + window], []).append((d, p))
    out = []
    for d, (i, raw) in enumerate(docs):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - window + 1):
            where = starts[raw[p:p + window]]
            if keep == "none" and len(where) > 1 or keep == "first" and any(
                    q < (d, p) and not (q[1] == p and docs[q[0]] == docs[d]) for q in where):
                gone[p:p + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return sorted(out, key=str)


def rows_of(seed, n=40, letters="ab"):
    rng = np.random.default_rng(seed)
    shared = ["".join(rng.choice(list(letters), 60)) for _ in range(3)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 50))))
        text += shared[int(rng.integers(3))][:int(rng.integers(10, 60))] + "".join(rng.choice(list("cdefgh"), 20))
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, "z" * 100), (n + 3, "zy" * 40), (n + 4, "Ünï cödé " * 5), (n + 5, "short")]


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, keep, small):
    if small:  # every way of splitting: short pieces, flushes and segments, hot keys, shards of their own
        for name, value in (("RUN", 5), ("FLUSH", 7), ("SEGMENT", 40), ("OFTEN", 2), ("SHARD", 50)):
            monkeypatch.setattr(suffixes, name, value)
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("did", F.lit("x")).withColumn("k1", F.lit(None))
    docs = docs.withColumn("spans", F.lit(1)).withColumn("key", F.lit(2.0))
    got = suffixes.dedup_substrings(docs, 16, 5, keep).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows, 16, keep)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got)
    assert all(sum(x["stop"] - x["start"] for x in r["spans"]) == r["n_removed"] for r in got)


def test_hot_key(spark, monkeypatch):
    """A passage with other surroundings in every document, and near copies."""
    monkeypatch.setattr(suffixes, "OFTEN", 4)
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefghij"), 80))
    rows = [(i, f"own{i * 7919}head{i}{passage}tail{i * 104729}end") for i in range(60)]
    for i in range(60, 100):
        k = int(rng.integers(0, 79))
        rows.append((i, passage[:k] + "#" + passage[k + 1:] + str(i)))
    for keep in ("first", "none"):
        got = suffixes.dedup_substrings(spark.createDataFrame(rows, SCHEMA), 24, 8, keep).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows, 24, keep)


def test_repeated_rows_and_null_ids(spark):
    body = "".join(np.random.default_rng(5).choice(list("abcdefgh"), 900))
    rows = [(1, body), (1, body), (2, body[:500] + "x" * 30), (None, "q" + body[100:600]), (None, "other " * 3), (-2**63, "own text")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for keep in ("first", "none"):
        got = suffixes.dedup_substrings(docs, keep=keep).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows, 400, keep)
    assert suffixes.report(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in suffixes.report(docs).collect()} == {1, 2, None, -2**63}


def test_factors():
    rng = np.random.default_rng(7)
    for trial in range(30):
        sizes = rng.integers(1, 25, int(rng.integers(1, 7)))
        raw = rng.integers(0, 2 + trial % 3, int(sizes.sum())).astype(np.uint8)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(raw))

        def lcp(i, j):
            n = 0
            while n < min(left[i], left[j]) and raw[i + n] == raw[j + n]:
                n += 1
            return n

        previous, following = suffixes.longest_factors(raw, left)
        assert previous.tolist() == [max((lcp(i, j) for j in range(i)), default=0) for i in range(len(raw))]
        assert following.tolist() == [max((lcp(i, j) for j in range(i + 1, len(raw))), default=0) for i in range(len(raw))]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 2**60, 1000).astype(np.uint64)
    for w in (1, 7, 337, 1000):
        assert suffixes.sliding_min(x, w).tolist() == [min(x[i:i + w]) for i in range(1000 - w + 1)]
