import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from photolake.llm import decontaminate, graph, ngram_join, suffix_dedup
from photolake.llm.base import table, written
from photolake.llm.suffixes import repeats

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def removed(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        s = (t or "").encode()
        cover = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if s[i:i + length] in seen:
                cover[i:i + length] = b"\1" * length
            seen.add(s[i:i + length])
        spans = sum(1 for i in range(len(s)) if cover[i] and not (i and cover[i - 1]))
        out[d] = (len(s), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(s, cover) if not c)).hexdigest())
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.sampled_from([2, 3, 5, 9, 17]))
def test_transform_finds_repeats(strings, length):
    cover = [bytearray(len(s)) for s in strings]
    for k, a, b in repeats(strings, length):
        cover[k][a:b] = b"\1" * (b - a)
    seen = set()
    for s, c in zip(strings, cover):
        expected = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if s[i:i + length] in seen:
                expected[i:i + length] = b"\1" * length
            seen.add(s[i:i + length])
        assert c == expected


@pytest.mark.parametrize("params", [{}, {"together": 2, "block_bytes": 20_000}])
def test_repeated_bytes(spark, params):
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()][:120]
    rows += [(1000 + i, f"{rng.random()}{line}{rng.random()}" * 2) for i in range(60)] + [(2000, "é" * 300), (2001, None), (2002, "")]
    docs = spark.createDataFrame(rows, DOC).withColumn("id", F.lit("clash"))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, **params).collect()} == removed(rows, 100)


def test_crowded_windows_go_to_no_block(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = text(150)
    rows = [(i, text(160) + shared + text(160)) for i in range(60)]
    largest, sizes = 8, []
    split = suffix_dedup._split

    def watched(*args):
        out = split(*args)
        parts = out if isinstance(out, tuple) else (out,)
        sizes.extend(r["count"] for r in parts[0].groupBy("key").count().collect())
        return out

    monkeypatch.setattr(suffix_dedup, "_split", watched)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC), together=largest)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == removed(rows, 100)
    assert max(sizes, default=0) <= largest


def test_repeated_rows_and_ids(spark):
    rows = [(None, "ab" * 80), (3, "ab" * 80), (3, "ab" * 80), (3, "xy" * 90), (1, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("3", 160), ("3", 160), ("3", 178), ("None", 158)]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def joined(rows, n=5):
    grams = {}
    for d, t in rows:
        w = words(t)
        grams[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    index, parent, degree = {}, {d: d for d in grams}, Counter()
    for d in sorted(grams):
        for g in grams[d]:
            index.setdefault(g, []).append(d)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for d in grams:
        for e, k in Counter(e for g in grams[d] for e in index[g] if e > d).items():
            if k >= 0.8 * (len(grams[d]) + len(grams[e]) - k) - 1e-9:
                degree.update([d, e])
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (root(d), degree[d]) for d in grams}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, block):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    start = [f"w{i}" for i in range(150)]
    for i in range(60):  # a crowded group of different texts
        own = list(start)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((5000 + i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOC), block=block).collect()}
    assert got == joined(rows)


def test_near_duplicate_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f g"), (3, "a b c"), (4, "A b, c"), (5, "q r s t u"), (5, "q r s t u"), (6, "a b c d e f g")]
    docs = spark.createDataFrame(rows, DOC).withColumn("key", F.lit("clash")).withColumn("mark", F.lit(1))
    got = sorted((str(r.doc_id), r.class_id, r.n_links, r.is_first) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [("1", 1, 0, True), ("2", 2, 0, True), ("3", 3, 1, True), ("4", 3, 1, False), ("5", 5, 1, True), ("5", 5, 1, True),
                   ("6", 6, 0, True), ("None", None, 0, True)]
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "None"]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_and_rows(0.8, 0.99999, 96)
    assert (1 - 0.8 ** rows) ** bands <= 1e-5 and bands * rows <= 96


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 380)] + [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_score(a, b):
    rows, best = [[0] * (len(b) + 1)], 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[j] - 1))
        best = max(best, *row)
        rows.append(row)
    return best


def test_alignment_equals_the_plain_recurrence():
    import numpy as np
    rng = random.Random(6)
    items = [np.array([rng.randint(10, 14) for _ in range(rng.randint(1, 12))], dtype=np.uint64) for _ in range(50)]
    texts = [np.array([rng.randint(10, 14) for _ in range(rng.randint(1, 25))], dtype=np.uint64) for _ in range(50)]
    assert decontaminate.align(items, texts).tolist() == [slow_score(a.tolist(), b.tolist()) for a, b in zip(items, texts)]


def rough(item, text):
    code = {}
    a, b = ([code.setdefault(w, len(code)) for w in words(t)] for t in (item, text))
    return slow_score(a, b) / (2 * len(a))


def test_leaks(spark):
    rng = random.Random(7)
    benchmark = table(spark, SF, "benchmark")
    items = benchmark.collect()
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    for i, item in enumerate(items):
        edited = [rng.choice(["zzz", "qqq rrr", ""]) if rng.random() < 0.15 else w for w in item.text.split(" ")]
        rows.append((9000 + i, "aa bb cc " * 40 + " ".join(edited) + " dd ee" * 40))
    rows += [(None, items[0].text), (-1, None), (-2, "")]
    docs = spark.createDataFrame(rows, DOC).withColumn("words", F.lit("clash")).withColumn("row", F.lit(1))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, benchmark).collect()}
    exact = {(d, x.item_id) for d, t in rows for x in items if f" {' '.join(words(x.text))} " in f" {' '.join(words(t))} "}
    assert all(got.get(pair) == 1.0 for pair in exact)
    # Edited copies: those that brute-force alignment with the whole document scores high enough.
    near = {(9000 + i, x.item_id) for i, x in enumerate(items) if rough(x.text, dict(rows)[9000 + i]) >= decontaminate.MIN_SCORE}
    assert len(near) > 0.9 * len(items) and {pair for pair in got if (pair[0] or 0) >= 9000} == near
    assert all(abs(got[d, i] - rough(next(x.text for x in items if x.item_id == i), dict(rows)[d])) < 1e-4 for d, i in near)
    assert {d for d, _ in got if d is not None and d < 9000} == {d for d, _ in exact if d is not None and d < 9000}  # no clean one
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_in_many_documents(spark):
    item = [f"w{i}" for i in range(40)]
    edited = " ".join(f"x{i}" if i in (6, 13, 20, 27, 34) else w for i, w in enumerate(item))
    rows = [(0, " ".join(item))] + [(i, f"a{i} b{i} c{i} {edited} d{i}") for i in range(1, 13)] + [(20, f"{edited} e f g h " * 9)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    expected = {d: round(rough(" ".join(item), t), 4) for d, t in rows}
    assert {r.doc_id: r.score for r in decontaminate.leaks(spark.createDataFrame(rows, DOC), benchmark).collect()} == expected


def test_recall_by_score(spark):
    """Copies edited in many ways: at least 0.9 of those that brute-force alignment scores in each tenth from 0.5 up are found."""
    rng = random.Random(12)
    items, rows, truth = [], [], {}
    for i in range(300):
        size = rng.choice([12, 16, 24, 40])
        item = [f"i{i}w{j}" for j in range(size)]
        every, share, regular = rng.randint(2, 6), rng.uniform(0, 0.4), rng.random() < 0.4
        text = []
        for j, w in enumerate(item):
            if not (j % every == every - 1 if regular else rng.random() < share):
                text.append(w)
            elif regular or rng.random() < 0.6:
                text.append(f"x{rng.random()}".replace(".", ""))
            elif rng.random() < 0.5:
                text += ["y", w]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(["filler"] * 30 + text + ["end"] * 30)))
        truth[i] = rough(items[i][1], rows[i][1])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.leaks(spark.createDataFrame(rows, DOC), benchmark).collect()}
    for band in range(5, 10):
        own = [i for i, s in truth.items() if band / 10 <= s < band / 10 + 0.1]
        assert len(own) >= 10 and sum(i in got for i in own) >= 0.9 * len(own), (band, len(own))
    assert all(abs(got[i] - truth[i]) < 1e-4 for i in got)
    every_fourth = [w if j % 4 < 3 else f"z{j}" for j, w in enumerate(next(t for _, t in items if t.count(" ") == 39).split(" "))]
    found = decontaminate.leaks(spark.createDataFrame([(1, " ".join(every_fourth))], DOC), benchmark).collect()
    assert [r.score for r in found] == [0.6375 if len(every_fourth) == 40 else None]


def test_common_phrases_open_few_passages(spark):
    """A phrase that all items and many documents share is no seed; a leak of an item that holds it still is found."""
    rng = random.Random(13)
    phrase = "choose the best answer from this list"
    items = [(i, " ".join([f"a{i}x{j}" for j in range(15)] + [phrase] + [f"b{i}x{j}" for j in range(18)])) for i in range(200)]
    rows = [(i, " ".join(f"{' '.join(f'r{rng.random()}' for _ in range(5))} {phrase}" for _ in range(8))) for i in range(500)]
    rows += [(900 + i, f"start {items[i][1]} end") for i in range(20)] + [(1000 + i, items[5][1]) for i in range(300)]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, DOC)
    assert decontaminate._candidates(*decontaminate._prepare(docs, benchmark)).count() < 1000
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(900 + i, i) for i in range(20)} | {(1000 + i, 5) for i in range(300)}


def test_leaks_in_very_long_texts_and_short_items(spark):
    filler = " ".join(f"f{i}" for i in range(300_000))
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, "only two"), (3, "red green blue"), (4, None), (None, "k l m n o p q")],
                                      "item_id long, text string")
    rows = [(1, f"{filler} {' '.join(f'w{i}' for i in range(30))} {filler}"), (2, "only two"), (3, "a red green blue b"), (4, "k l m x o p q"), (5, filler)]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(spark.createDataFrame(rows, DOC), benchmark).collect()}
    assert got == {(1, 1): 1.0, (3, 3): 1.0, (4, None): round(11 / 14, 4)}


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    extra = [(None, "the and of that is secret: abcdefghijk the with for", None, None, 1), (5000, None, "en", "s", 0),
             (5001, "la de que le une dans pour avec token=12345678", "fr", "s", 1), (5001, "la de que le une dans pour avec token=12345678", "fr", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("row", F.lit("clash")).withColumn("id", F.lit(1))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == docs.columns
            counts.append(out.count())
            kept = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
        if name == "ngram_jaccard_join":
            groups = joined([(d, t) for d, t in kept if d is not None])
            assert all(n == 0 for _, n in groups.values())
        if name == "secret_scan":
            assert not any(d == 5000 for d, _ in kept) and (None, "the and of that is <secret> the with for") in kept
        docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0.7 * counts[0]
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in kept}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF))
        assert empty.count() == 0
