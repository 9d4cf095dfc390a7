"""The training-data operators on small tables with awkward rows, against brute force."""

import hashlib
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
from sitescope.llm import (decontamination, html, licenses, linededup, packing, quality, sharding, simhash,  # noqa: E402
                           substrings, topk)
from sitescope.llm.queries import QUERIES, TOKENIZER  # noqa: E402

P = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))
ROWS = [
    (1, f"Alpha beta gamma delta.\n{P}\nshort", "en", "a", 1),
    (2, f"Other start here\n{P.replace('passage30', 'changed')}\nshort", "en", "a", 2),
    (3, f"Unique words before {P} and unique words after", None, None, None),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t \n", "en", "a", 5),
    (7, f"Alpha beta gamma delta.\n{P}\nshort", "en", "a", 1),
    (7, f"Alpha beta gamma delta.\n{P}\nshort", "en", "a", 1),
    (None, "a text without id that is long enough to count as a line", "en", "b", 9),
    (8, LONG, "en", "a", len(LONG)),
    (9, "Ünï cödé $$$ ### !!! Released under the MIT License.\nReleased under the MIT License.", "de", "a", 3),
    (10, " ".join(["again"] * 50), "en", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns that share the operators' working names
    return (spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("did", F.lit("x")).withColumn("th", F.lit(None).cast("int"))
            .withColumn("lines", F.lit(1)).withColumn("score", F.lit(2.0)).withColumn("fp", F.lit(3)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered():
    return sorted(((i if i is not None else -2**63, t or "", n) for n, (i, t, *_) in enumerate(ROWS)), key=lambda r: r[0])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_line_dedup(docs, empty):
    seen, want = [], []
    done = {}
    for i, text, _ in ordered():
        if (i, text) not in done:
            kept, lines = [], text.split("\n") if text else []
            for line in lines:
                words = line.encode().lower().split()
                if len(words) < 3:
                    kept.append(line)
                    continue
                bound = [w for w in seen if w == words or min(len(w), len(words)) >= 8 and linededup.within_one(w, words)]
                seen.append(words)
                if not bound:
                    kept.append(line)
            done[i, text] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
        want.append((i if i != -2**63 else None, *done[i, text]))
    assert key(linededup.report(docs, least_words=3).collect()) == key(want)
    cleaned = linededup.dedup_lines(docs, least_words=3)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    assert cleaned.where("doc_id = 4").first()["text"] is None
    assert linededup.report(empty).count() == 0


def test_short_lines(spark, tmp_path):
    texts = ["les.\nand ornd.\nLes. \n\n \t\nles", "AND  ornd.\n\u884c\u884c\u884c\nonly here", "\u884c\u884c\u884c\n\nles.\nand ornd", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), []
    for i, text in enumerate(texts):
        kept, lines = [], text.split("\n") if text else []
        for line in lines:
            words = tuple(line.encode().lower().split())
            if not words or words not in seen:
                kept.append(line)
            seen.add(words)
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    assert key(linededup.report(docs).collect()) == key(got)  # only blank lines stay by default
    assert key(got) == key([(i, n, gone, sha(t)) for i, n, gone, t in want])
    stage = corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] or "" for r in stage} == {i: t for i, _, _, t in want}


def test_short_lines_within_a_character(spark):
    rng = np.random.default_rng(6)
    lines = ["are is anwh reenen.", "are, is anwh reenen.", "Data base of sites", "database of sites", "d\u00fcne am meer heute",
             "dune am meer  heute", "a b c d e f gh", "a b c d e f g h", "two words", "two word", "a b c d e f g h i", "a b c d e f g h x",
             "data base x", "database x", "ab cd ef", "ba cd ef", "aab cd ef", "abb cd ef"]
    lines += [" ".join("".join(rng.choice(list("ab"), 2)) for _ in range(int(rng.integers(1, 9)))) for _ in range(120)]
    texts = ["\n".join(lines[i:i + 3]) for i in range(0, len(lines), 3)]
    seen, want = [], []
    for i, text in enumerate(texts):
        n = 0
        for line in text.split("\n"):
            words = line.lower().split()
            bounds = {id(w): min(len(w), len(words)) for w in seen}
            n += any(w == words or bounds[id(w)] >= 8 and linededup.within_one(w, words)
                     or 3 <= bounds[id(w)] < 8 and linededup.within_one(" ".join(w), " ".join(words)) for w in seen)
            seen.append(words)
        want.append((i, 3, n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert key((r["doc_id"], r["n_lines"], r["n_removed"]) for r in linededup.report(docs, least_words=1).collect()) == key(want)


def test_within_one():
    assert linededup.within_one(list("abcd"), list("abd")) and linededup.within_one(list("abc"), list("axc"))
    assert not linededup.within_one(list("abcd"), list("bcda")) and not linededup.within_one(list("ab"), list("abcd"))


def test_substring_dedup(docs, empty):
    seen, done, want = set(), {}, []
    for i, text, _ in ordered():
        if (i, text) not in done:
            words = text.encode().split()
            gone = [False] * len(words)
            for a in range(len(words) - 19):
                window = tuple(words[a:a + 20])
                if window in seen:
                    gone[a:a + 20] = [True] * 20
                seen.add(window)
            kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
            done[i, text] = (len(words), sum(gone), sha(kept))
        want.append((i if i != -2**63 else None, *done[i, text]))
    got = substrings.report(docs)
    assert key(got.collect()) == key(want)
    assert got.where("doc_id = 3").first()["n_removed"] == 60
    assert substrings.report(empty).count() == 0


def test_substrings_of_repeated_rows_in_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 16)
    rows = [(1, f"start {P} end"), (2, f"other {P} close"), (2, f"other {P} close"), (3, LONG[:4000]), (3, LONG[:4000])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a flush a row
    try:
        got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 60), (2, 60), (3, 0), (3, 0)]


def test_substrings_of_null_ids(spark):
    far = " ".join(f"far{i}" for i in range(900))
    short = " ".join(f"short{i}" for i in range(200))
    rows = [(None, f"{far} {P}"), (None, short), (5, f"five {P} end"), (6, f"six {short}")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # each row ends its chunk
    try:
        got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert key((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == key(
        [(None, 960, 0), (None, 200, 0), (5, 62, 60), (6, 201, 200)])


def test_automaton():
    a = substrings.Automaton()
    for s in ("abcbc", "xbcb", "abab"):
        a.extend([ord(c) for c in s])
    texts = ("abcbc", "xbcb", "abab")
    probe = "zabcbabbcbcx"
    got = a.longest([ord(c) for c in probe])
    for j in range(len(probe)):
        best = max(n for n in range(j + 2) if any(probe[j + 1 - n:j + 1] in t for t in texts))
        assert got[j] == best


def test_frequent_anchors(spark, monkeypatch):
    rows = [(i, f"own{i} head{i} {P} tail{i} end{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = key(substrings.report(frame).collect())
    monkeypatch.setattr(substrings, "OFTEN", 4)
    assert key(substrings.report(frame).collect()) == want
    assert {r["n_removed"] for r in substrings.report(frame).collect()} == {0, 60}


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(f"passage{i}" for i in range(20, 32))), (2, "cödé"), (3, None), (None, "after"), (4, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.report(docs, bench).collect()}
    assert got[1]["n_hit"] == 12 and got[1]["items_sha256"] == sha("1") and got[1]["contaminated"]
    assert got[2]["n_hit"] == 10 and got[9]["items_sha256"] == sha("2")
    assert got[3]["n_hit"] == 13 and got[3]["n_items"] == 1
    assert got[4]["n_words"] == 0 and not got[5]["contaminated"]
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert decontamination.report(clean, bench).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs, bench, remove="documents").count() == len(ROWS) - 6
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"passage{j}" for j in range(i, i + 11))) for i in range(0, 40, 9)],
                                  "item_id long, text string")
    want = key(decontamination.report(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 50)
    assert key(decontamination.report(docs, bench).collect()) == want


def test_ngram_arrays_are_compact():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(3_000)]
    items = [(i, " ".join(rng.choice(words, 400))) for i in range(400)] + [(None, "a b"), (7, None), (8, "a b"), (9, "A  b!")]
    grams = decontamination.ngram_set(items, 10)
    size = sum(len(t or "") for _, t in items)
    assert sum(g.nbytes for g in grams.values()) + len(grams[10].text) <= 6 * size
    assert sum(g.nbytes for g in grams.values()) <= sum(decontamination.WINDOW_BYTES * (len(t or "") + 1) // 2 for _, t in items)
    assert len(grams[10].keys) == 400 * 391 and grams[2].items.tolist() == [8, 9]
    k = 1234
    start = items[0][1].split()[:10]
    assert any(grams[10].text[a:b] == " ".join(start).encode() for a, b in zip(grams[10].first, grams[10].last))
    assert (grams[10].keys[:-1] <= grams[10].keys[1:]).all() and len(grams[10].items) == grams[10].cuts[-1] >= k


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 1200)]
    rows += [(100, [0.5] * 6), (None, [1.0] * 6), (2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2100, [9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "GROUP_ROWS", 100)
    ok = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
          if i is not None and v is not None and not any(x is None or x != x for x in v)]
    want = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        mine = {tuple(v) for i, v in ok if i == q}
        if len(mine) > 1:
            continue  # an id with two vectors is two queries
        found = sorted(((-int(np.dot(v, next(iter(mine)))), i) for i, v in ok if i != q and len(v) == len(next(iter(mine)))))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    got = [tuple(r) for r in topk.top_k(frame).where("query_id <> 100").collect()]
    assert key(got) == key(want)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_queries_of_all_lanes_are_not_broadcast(spark, monkeypatch):
    """However few the queries, their copies for all groups of blocks do not pass through the driver."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 20)
    frame = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(1000)], "vec_id long, embedding array<float>")
    found = topk.top_k(frame)
    assert len(found.collect()) == 100
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join [" in line and "lane#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_blocks_are_skipped():
    rng = np.random.default_rng(9)
    centres = rng.integers(-300, 300, (20, 32)) * 10
    matrix = np.repeat(centres, 300, axis=0) + rng.integers(-40, 40, (6000, 32))  # ids in runs of like vectors
    ids = np.arange(6000)
    asked = np.arange(0, 6000, 20)
    queries, scored = (asked, matrix[asked]), []
    floor = topk.known_bounds(queries, 10)
    got = {i: (a.tolist(), b.tolist()) for i, a, b in topk.search(queries, (ids, matrix), 10, floor, scored)}
    for i, q in enumerate(asked):
        s = matrix @ matrix[q]
        want = sorted((-int(x), int(j)) for j, x in enumerate(s) if j != q)[:10]
        assert got[i] == ([j for _, j in want], [-x for x, _ in want]) and floor[i] <= -want[-1][0]
    assert scored[0][0] < scored[0][1] / 2


def test_quality(spark, docs, empty):
    texts = [(i, "good plain words in a sentence " * 3 + str(i), 1) if i % 2 else (i, "### $$$ !!! *** junk&&& " * 3, 0) for i in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts] + [(1, None, 0), (None, 1, 0), (99_999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.report(frame, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 200
    assert quality.report(docs, labels).count() == len(ROWS)
    assert quality.report(empty, labels).count() == 0
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 3).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(got) == len(ROWS) and all(len(s) == 1 for s in by_text.values())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert sharding.shard_documents(empty).count() == 0


def test_smallest_capacity():
    from functools import lru_cache
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, k = rng.integers(1, 30, int(rng.integers(1, 14))), int(rng.integers(1, 5))

        @lru_cache(None)
        def best(i, parts):
            if parts == 1:
                return int(sizes[i:].sum())
            return min(max(int(sizes[i:j].sum()), best(j, parts - 1)) for j in range(i, len(sizes) + 1))

        capacity = sharding.smallest_capacity(sizes, k)
        assert capacity == best(0, k)
        assert len(sharding.greedy_cuts(np.cumsum(sizes), capacity, k)) < k


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(docs, TOKENIZER).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    whole = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in ROWS}
    by_doc = {i: ids for (i, _), ids in whole.items()}
    for r in got:
        ids = by_doc[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["tokens"] == ids and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["length"] == 1 << r["bucket"] <= 2048 and r["doc_tokens"] == len(by_doc[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(whole[i, t]) for i, t, *_ in ROWS)
    assert packing.pack_documents(empty, TOKENIZER).count() == 0
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", " \n" * 500_000, "a" + "\t" * 20_000 + "b <|endoftext|>"])
def test_packing_long_blanks(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    assert packing.token_ids(TOKENIZER, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_blanks_below_the_bound(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for n in (1, 2, 100, packing.LONG_BLANK - 1, packing.LONG_BLANK, packing.LONG_BLANK + 1):
        for text in (" " * n + "x", "x" + "\n" * n, "x" + " " * n + "\n y"):
            assert packing.token_ids(TOKENIZER, text) == tokenizer.encode(text, add_special_tokens=False).ids
    rows = [(1, " " * 1_000_000), (2, "a b"), (3, "x" + "\n" * 300_000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, with_tokens=False)
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3}


# 32-bit text hashes of these two are equal: rows without an id that only the text tells apart
TWINS = [f"unique text number {n} of the table" for n in (52435, 277545)]


def test_twins_without_id(spark):
    shared = " ".join(f"shared{i}" for i in range(33))
    frame = spark.createDataFrame([(None, t) for t in TWINS], "doc_id long, text string")
    assert frame.select(F.countDistinct(F.hash("text"))).first()[0] == 1
    assert {r["text"] for r in simhash.keep_one(frame).collect()} == set(TWINS)
    rows = [(None, f"unique text number {n} of the table\n{shared}") for n in (75352, 120805)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert frame.select(F.countDistinct(F.hash("text"))).first()[0] == 1
    assert sorted(r["n_removed"] for r in substrings.report(frame).collect()) == [0, 36]  # "of the table" too
    assert sorted(r["n_removed"] for r in linededup.report(frame).collect()) == [0, 1]
    assert sorted(len(r["text"].split("\n")) for r in linededup.dedup_lines(frame).collect()) == [1, 2]


def test_smallest_id_is_no_null(spark):
    rows = [(-2**63, "line one of the text\nline two of it"), (None, "line one of the text\nanother line here"), (1, "line one of the text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for got in (linededup.report(frame), substrings.report(frame), simhash.report(frame)):
        assert {r["doc_id"] for r in got.collect()} == {-2**63, None, 1}


def test_page_lines():
    lines, kinds = html.page_lines(
        "<title>t</title><div class='site nav'>menu</div><p>a&nbsp;b<b>c</b><!-- x --><script>var s='</p>'</script>"
        "<form>f<input></form><article><header>head</header>in<p>side<aside>no</aside>end</article>"
        "<div id=comments><p>c1<p>c2</div>tail &lt;p&gt;<footer>z")
    assert list(zip(lines, kinds)) == [("menu", 2), ("a bc", 0), ("f", 2), ("head", 1), ("in", 1), ("side", 1), ("no", 2),
                                       ("end", 1), ("c1", 2), ("c2", 2), ("tail <p>", 0), ("z", 2)]


STORY = "<p>Main story that goes on for a while.</p><p>And a second part.</p>"


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{STORY}</article></div>", f"<div id='page' class='ad-free'>{STORY}</div>",
    f"<div class='search-results'><article>{STORY}</article></div>", f"<form id='aspnetForm'><nav>menu</nav><div>{STORY}</div></form>",
    f"<div class='sidebar'><main>{STORY}</main></div>", f"<div class='toolbar'><article>{STORY}</article></div><div class=comments><p>c</p></div>"])
def test_articles_stay(page):
    lines, kinds = html.page_lines(f"<body><nav>menu</nav>{page}<footer>foot</footer>")
    kept = [x for x, k in zip(lines, kinds) if k != 2]
    assert kept == ["Main story that goes on for a while.", "And a second part."]


def test_names_inside_an_article():
    page = ("<article><p>One</p><div class='toc-entry'>two</div><div class='form-group'>three</div><div class='cookie-notice'>x</div>"
            "<div class='site_footer'>y</div><form>z<input></form><div class=comments><article>reader</article></div></article>")
    lines, kinds = html.page_lines(page)
    assert [x for x, k in zip(lines, kinds) if k == 1] == ["One", "two", "three"]


@pytest.mark.parametrize("piece", ["<div ", "<textarea", "<a \"", "<a '", "<!--", "<script>", "<b", "</p", "<div>", "</div>", "<form class=ad>"])
def test_malformed_pages_take_linear_time(piece):
    import time
    began = time.process_time()
    html.page_lines(piece * 60_000)
    html.page_lines("<p>text</p>" + piece * 60_000 + ">")
    assert time.process_time() - began < 10


def test_deep_menu_ends_where_it_closes():
    lines, kinds = html.page_lines("<nav>" + "<ul><li>x<p>" * 2_000 + "</nav><p>text</p>")
    assert lines[-1] == "text" and kinds[-1] == 0 and set(kinds[:-1]) == {2}


def test_unclosed_ends():
    assert html.page_lines("<p>a</p><script>var x = '<b>'; more")[0] == ["a"]
    assert html.page_lines("<p>a</p><!-- <b> never closed")[0] == ["a"]
    assert html.page_lines("<p>a</p> 1 < 2 and <b")[0] == ["a", "1 < 2 and <b"]


def test_shared_lines():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(0, 12))).tolist(), rng.integers(0, 4, int(rng.integers(0, 12))).tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = html.shared(a, b)
        rest = iter(b)
        assert len(places) == best[-1][-1] and places == sorted(set(places))
        assert all(a[i] in rest for i in places)


def test_html_text(spark):
    page = "<body><div>Welcome to the site</div><p>story {0} begins</p><p>and ends {0}</p><div>Imprint and contact</div></body>"
    rows = [(i, f"http://h.example/en/{i}", page.format(i)) for i in range(30)]
    rows += [(100, None, "<p>no url</p>"), (101, "http://h.example/x", None), (102, "http://one.example/", "<p>alone</p>"),
             (103, "http://one.example/", "<p>alone</p>"), (0, "http://h.example/en/0", page.format(0))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = html.report(frame).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == f"story {i} begins and ends {i}" for i in range(30))
    assert texts[100] == "no url" and texts[101] == "" and texts[102] == texts[103] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.report(frame.limit(0)).count() == 0


def test_html_copies(spark):
    page = "<body><div>Welcome to the site</div><p>story {0} begins</p><div>Imprint and contact</div></body>"
    rows = [(100 * i + j, f"http://h.example/en/{i}?v={j}", page.format(i)) for i in range(4) for j in (range(40) if i == 2 else range(3))]
    rows += [(1000 + i, f"http://copies.example/{i}", page.format(9)) for i in range(30)]
    got = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert key((r["page_id"], r["text"]) for r in got) == key(
        [(i, f"story {i // 100} begins" if i < 1000 else "Welcome to the site story 9 begins Imprint and contact") for i, *_ in rows])


def _fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = simhash.report(docs).collect()
    prints = [(i, _fingerprint(t)) for i, t, *_ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for x in range(len(ROWS)):
            for y in range(len(ROWS)):
                if (prints[x][1] ^ prints[y][1]).bit_count() <= 3:
                    group[x] = group[y] = min(group[x], group[y])
    ids = [[prints[x][0] for x in range(len(ROWS)) if group[x] == g and prints[x][0] is not None] for g in group]
    assert key(got) == key([(i, f"{p:016x}", min(x, default=None)) for (i, p), x in zip(prints, ids)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.report(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_xxh64():
    raw = os.urandom(400)
    starts = np.arange(0, 150)
    stops = starts + np.arange(150)
    got = simhash.xxh64(np.frombuffer(raw, np.uint8), starts, stops)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, stops)]


def test_simhash_links(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2**62, 2**62, 30)
    values = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (12, 2))}
    got = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    roots = {r["node"]: r["root"] for r in got}
    label = {v: v for v in values}
    for _ in range(20):
        for x in values:
            near = [label[y] for y in values if ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
            label[x] = min(near)
    assert {v: roots.get(v, v) for v in values} == label


@pytest.mark.parametrize("hub", [1, 3, 10_000])
def test_components_with_hubs(spark, monkeypatch, hub):
    from sitescope.llm import components as CC
    monkeypatch.setattr(CC, "HUB", hub)
    monkeypatch.setattr(CC, "MOST_HUBS", 1_000_000)
    rng = np.random.default_rng(hub)
    edges = [(1000, 2000 + i) for i in range(60)] + [(5, 3000 + i) for i in range(40)] + [(i, i + 1) for i in range(100, 140)]
    edges += [(int(a), int(b)) for a, b in rng.integers(4000, 4100, (60, 2))] + [(2003, 3001), (7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in CC.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert all(got.get(x, x) == label[x] for x in label)


def test_licenses(spark, docs, empty):
    texts = [t for _, t in licenses.KNOWN[:2]]
    rows = [(1, "Copyright (c) 2024 Somebody\n\n" + texts[0].upper().replace("LICENSE", "LICENCE")), (2, texts[1] + " and more"),
            (3, "x y z\nReleased under the   MIT licence!\n(c) 1999 Else"), (4, None)]
    bsd = dict(licenses.KNOWN[::-1])["BSD-3-Clause"]
    rows += [(5, "Copyright (c) 2020, Somebody\n\n" + bsd.replace("1. ", " 1) ").replace("copyright holder", "Copyright Owner")),
             (6, bsd.replace("endorse", "praise")), (7, dict(licenses.KNOWN)["Zlib"].replace("\n", "\n\n  "))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in (5, 6, 7)] == ["BSD-3-Clause", None, "Zlib"]
    assert got[1]["license_id"] == "MIT" and got[2]["license_id"] is None
    assert got[3]["license_id"] is None and got[3]["notices"] == "MIT"
    assert got[4]["digest"] == sha("") and got[4]["license_id"] is None
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(empty).count() == 0


def test_pipeline(spark):
    from conftest import SF_SMALL
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert out and sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), SF_SMALL).columns == columns


def test_half_keys():
    rng = np.random.default_rng(11)
    for _ in range(300):
        a = "".join(rng.choice(list("abü "), int(rng.integers(1, 12))))
        k, c = int(rng.integers(0, len(a))), str(rng.choice(list("abü ")))
        for b in (a[:k] + a[k + 1:], a[:k] + c + a[k + 1:], a[:k] + c + a[k:]):
            assert set(linededup._half_keys(a)) & set(linededup._half_keys(b))
