"""The pipeline's stages, the quality score and the shards against plain-Python versions."""

import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sitescope.llm import linededup, quality, sharding  # noqa: E402
from sitescope.llm.queries import TOKENIZER  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTER = re.compile(r"[^\W\d_]")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def blank_split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def statistics(text):
    words, n = blank_split(text), len(text)
    size = max(1, len(words))

    def share(characters):
        return sum(c in characters for c in text) / max(1, n)

    return [math.log1p(len(words)), n / size, len(set(words)) / size, sum(a == b for a, b in zip(words, words[1:])) / size,
            sum(not LETTER.search(w) for w in words) / size, size / (text.count("\n") + 1), share(quality.SYMBOLS), share("!"),
            share(quality.CAPITALS), share("0123456789")]


def score(model, text):
    if model.prior is not None:
        return model.prior
    stats, total = statistics(text), model.intercept
    for weight, rule in model.rules:
        total += weight * all(stats[s] <= t if below else stats[s] > t for s, below, t in rule)
    return 1 / (1 + math.exp(-total))


def documents():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeiorstn"), int(rng.integers(2, 9)))) for _ in range(400)]

    def prose(n):
        return " ".join(str(w) for w in rng.choice(words, n)).capitalize() + "."

    passage = prose(40)
    items = [(1, prose(30)), (2, prose(4)), (3, None), (4, prose(12))]
    rows = [(i, "\n".join(prose(int(rng.integers(9, 30))) for _ in range(4))) for i in range(80)]
    rows += [(80 + i, rows[i][1]) for i in range(10)]                                        # exact copies
    rows += [(100 + i, rows[20][1].replace(" ", "  ", i)) for i in range(3)]                 # copies but for blanks
    rows += [(110 + i, f"{prose(15)}\n{passage}\n{prose(15)}\nMenu") for i in range(6)]      # a shared line, a short line
    rows += [(120 + i, f"{prose(20)} {items[i % 4][1] or 'none'} {prose(20)}") for i in range(8)]  # benchmark passages
    rows += [(200 + i, "$$$ ### !!! 000 *** " * int(rng.integers(5, 20)) + str(i)) for i in range(40)]  # junk
    rows += [(300, None), (301, ""), (302, " \n\t"), (5, rows[5][1]), (5, "another text with the same id here"), (None, prose(25)), (None, prose(60))]
    rows.append((303, " ".join(str(w) for w in rng.choice(words, 6_000))))                  # a very long text
    labels = [(i, 0 if 200 <= i < 300 else 1, 0) for i, _ in rows if i is not None] + [(None, 1, 0), (9_999, 0, 1), (7, None, 0)]
    return rows, items, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items, labels = documents()
    path = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA).repartition(3)
    frame.withColumn("did", F.lit("x")).withColumn("k1", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near_lines(rows):
    """(id, kept text) by the edit bounds, earlier lines first; rows that repeat are one document."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    seen, done, out = [], {}, [None] * len(rows)
    for r in order:
        i, text = rows[r]
        if (i, text) not in done:
            kept = []
            for line in (text or "").split("\n"):
                words = lower(line).encode().split()
                if not words:
                    kept.append(line)
                    continue
                if not any(words == w or linededup.near(line, x) for w, x in seen
                           if words == w or min(len(words), len(w)) >= 3 and abs(len(words) - len(w)) <= 1):
                    kept.append(line)
                seen.append((words, line))
            done[i, text] = text if text is None or len(kept) == len(text.split("\n")) else "\n".join(kept)
        out[r] = (i, done[i, text])
    return out


def fingerprint(text):
    words = blank_split(lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each_group(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        for x in range(len(rows)):
            near = [y for y in range(len(rows)) if (prints[x] ^ prints[y]).bit_count() <= 3]
            low = min(group[y] for y in near)
            for y in near:
                group[y] = low
    return group


def without_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lower(text or "")
    spans = [(m.start(), m.end()) for m in pattern.finditer(low)]
    words = [low[a:b] for a, b in spans]
    hit = [False] * len(words)
    for _, item in items:
        known = pattern.findall(lower(item or ""))
        size = min(10, len(known))
        for k in range(len(known) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == known[k:k + size]:
                    hit[j:j + size] = [True] * size
    keep, j = [True] * len(text or ""), 0
    while j < len(words):
        if hit[j]:
            k = j
            while k + 1 < len(words) and hit[k + 1]:
                k += 1
            keep[spans[j][0]:spans[k][1]] = [False] * (spans[k][1] - spans[j][0])
            j = k
        j += 1
    return text if text is None else "".join(c for c, x in zip(text, keep) if x)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_stages(spark, tables):
    rows, items, _ = documents()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns

    model = quality.fit(docs, labels)
    good = [(i, t) for i, t in rows if score(model, t or "") >= quality.THRESHOLD]
    now = corpus_pipeline.written(stages["quality"](spark, docs, tables))
    assert now.columns == columns and pairs(now) == sorted(good, key=str)
    assert not any(i is not None and 200 <= i < 300 for i, _ in good) and {i for i, _ in good} >= set(range(80))

    kept = near_lines(good)
    now = corpus_pipeline.written(stages["line_dedup"](spark, now, tables))
    assert now.columns == columns and pairs(now) == sorted(kept, key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in now.collect())

    group = one_of_each_group(kept)
    now = corpus_pipeline.written(stages["near_dedup"](spark, now, tables))
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert now.columns == columns and sorted(group[kept.index(x)] for x in left) == sorted(set(group))
    for x in left:  # the smallest id of its group
        ids = [i for (i, _), g in zip(kept, group) if g == group[kept.index(x)] and i is not None]
        assert x[0] == min(ids, default=None)

    clean = [(i, without_hits(t, items)) for i, t in left]
    now = corpus_pipeline.written(stages["decontamination"](spark, now, tables))
    assert now.columns == columns and pairs(now) == sorted(clean, key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in now.collect())

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    out = stages["packing"](spark, now, tables).collect()
    ids = {}
    for r in out:
        ids.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    packed = sorted(sum((x["tokens"] for x in sorted(rs, key=lambda x: x["start"])), []) for rs in ids.values())
    assert packed == sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in clean)

    whole = corpus_pipeline.run(spark, tables)
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in whole.collect()) == sorted(
        (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in out)


def test_quality_scores(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    want = sorted(((i, round(score(model, t or ""), 9)) for i, t in documents()[0]), key=str)
    got = quality.report(docs, labels).collect()
    assert sorted(((r["doc_id"], round(r["score"], 9)) for r in got), key=str) == want and model.rules


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_heaviest_shard_is_the_smallest_possible(spark, tables, n_shards):
    rows = documents()[0]
    units = {}
    for _, t in rows:
        unit = int(hashlib.md5((t or "").encode()).hexdigest()[:4], 16)
        units[unit] = units.get(unit, 0) + len((t or "").encode()) + 1
    sizes = [units[u] for u in sorted(units)]

    def shards_needed(capacity):
        n, filled = 1, 0
        for s in sizes:
            n, filled = (n + 1, s) if filled + s > capacity else (n, filled + s)
        return n

    best = min(c for c in {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
               if c >= max(sizes) and shards_needed(c) <= n_shards)
    got = sharding.shard_documents(spark.read.parquet(f"{tables}/documents.parquet"), n_shards).collect()
    weight = {}
    for r in got:
        weight[r["shard"]] = weight.get(r["shard"], 0) + r["size"]
    assert max(weight.values()) == best and len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in got) == sorted((str(i), zlib.crc32((t or "").encode())) for i, t in rows)


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), tables)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
