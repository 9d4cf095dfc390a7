"""Importance resampling against a plain-Python version, on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitescope.llm import importance

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))
TEXTS = ["Alpha beta GAMMA delta " * 8, "alpha", "", None, " \x00 - ", "Ünï cödé\x00zwei" * 9, LONG, "x" * 500 + " yy",
         "one two three four five " * 5, "one two three four five " * 5]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8]), (None, TEXTS[8]), (None, TEXTS[0])]
ROWS += [(100 + i, " ".join(f"t{(i * j) % 17}" for j in range(15 + i % 20))) for i in range(60)]
ITEMS = [(1, "one two three"), (2, None), (3, "ALPHA BETA"), (4, "t1 t2 t3 t4")]


def grams(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(rows, items):
    corpus = Counter(bucket(f) for _, t in rows for f in grams(t)[1])
    target = Counter(bucket(f) for _, t in items for f in grams(t)[1])
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in corpus}
    out = []
    for i, t in rows:
        n, fs = grams(t)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = able[:25 * len(able) // 100]
    return out, drawn


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("items", [ITEMS, []])
def test_report(spark, items):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("importance", F.lit("x")).withColumn("rank", F.lit(None))
    got = importance.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want, drawn = brute(ROWS, items)
    assert key(r[:4] for r in got) == key([(i, f, w, s) for i, _, f, w, s in want])
    have = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert have == [(k + 1, r[4], r[0]) for k, r in enumerate(drawn)]


def test_resample_keeps_columns_and_draw(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("importance", F.lit("x")).withColumn("n_words", F.lit(1))
    target = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = importance.resample(docs, target)
    assert got.columns == docs.columns
    assert key((r["doc_id"], r["text"]) for r in got.collect()) == key((r[0], dict(ROWS)[r[0]]) for r in brute(ROWS, ITEMS)[1])


def test_empty(spark):
    empty, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert importance.report(empty, target).count() == 0
    assert importance.resample(empty, target).count() == 0
    assert importance.report(spark.createDataFrame([(1, None)], SCHEMA), target).first()["rank"] is None


def test_crc_of_spans():
    raw = np.frombuffer(np.random.default_rng(4).bytes(3000), np.uint8)
    starts = np.arange(0, 300)
    stops = starts + np.arange(300) % 150
    got = importance.crc32(raw, starts, stops)
    assert [int(x) for x in got] == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, stops)]
    more = importance.crc32(raw, starts, stops, got)
    assert [int(x) for x in more] == [zlib.crc32(raw[a:b].tobytes(), zlib.crc32(raw[a:b].tobytes())) for a, b in zip(starts, stops)]


def test_no_gram_crosses_documents():
    n, out = importance.features(pa.array(["a b", "c", None, "", "d e f"]))
    assert n.tolist() == [2, 1, 0, 0, 3] and [r.tolist() for _, r in out] == [[0, 0, 1, 4, 4, 4], [0, 4, 4]]
    assert out[1][0].tolist() == [bucket(g) for g in ("a b", "d e", "e f")]
    assert importance.features(pa.array(["a b c", "d e"]), order=3)[1][2][0].tolist() == [bucket("a b c")]
