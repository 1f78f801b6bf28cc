import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from photolake.llm import prefix_trie, queries, simhash, spelling
from photolake.llm.base import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


# --- spelling variants ----------------------------------------------------------------------

def near_words(counts):
    gaps = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1:]].add(w)
    near = defaultdict(set)
    for (a, b), group in gaps.items():
        group = group | ({a + b} & set(counts))
        for w in group:
            for x in group - {w}:
                if len(w) == len(x) or {len(w), len(x)} == {len(a + b), len(a + b) + 1}:
                    near[w].add(x)
    return near


def variants(counts, ratio=10):
    near, out = near_words(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near[w]), counts[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def got_variants(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(1)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): int(10 ** rng.uniform(0, 6)) for _ in range(900)}
    counts |= {"aaaaa": 5, "aaaa": 50, "aaa": 500, "aa": 5000, "b$": 3}
    frame = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, key string, id long")
    expected = variants({w: n for w, n in counts.items() if "$" not in w}) | {"b$": (None, "b$", 3, 0, None)}
    assert got_variants(spelling.group_variants(frame)) == expected


def test_long_words_and_edges(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcde") for _ in range(spelling.LONG))
    counts = {base: 10000, base + "a": 900, base[:-1]: 80, base[:100] + "z" + base[101:]: 7, base[:9] + "y" + base[9:]: 3, "x" * 30_000: 40,
              "x" * 30_001: 4, "x" * 15_000 + "y" + "x" * 15_000: 2}
    expected = variants(counts)
    assert expected[base + "a"][0] == base and expected["x" * 30_001][0] == "x" * 30_000
    rows = [*counts.items(), (None, 5), ("", 2), ("word", 1), ("word", 1), ("nulls", None)]
    got = got_variants(spelling.group_variants(spark.createDataFrame(rows, "word string, n long")))
    assert {w: got[w] for w in counts} == expected
    assert got[None] == (None, None, 5, 0, None) and got["word"][2] == 2 and got["nulls"][2] == 0 and got[""][3] == 0
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_spelling_query_reads_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcÀÉö") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "1", "×", "ÿ"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, "Letters letters"), (100, None), (101, ""), (102, "longest " * 300_000 + "LONGESt"), (102, "longest")]
    spark.createDataFrame([(d, t, "r", 1) for d, t in rows], DOC + ", run string, word long").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 31 == 0 else run] += 1
    expected = variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert expected["longest"][2] > 200_000
    assert got_variants(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == expected


# --- fingerprints ---------------------------------------------------------------------------

def fingerprint(t):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_any_texts():
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.none() | st.lists(st.sampled_from(["a", "B", "é ", " ", "\t\n", "\x0d", "ab cd", "　"])).map("".join)))
    def check(texts):
        assert simhash.text_fingerprints(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]

    check()
    long = " ".join(f"w{i % 977}" for i in range(200_000))  # more than one step
    assert simhash.text_fingerprints(pa.array(["x", long, None])).tolist() == [fingerprint("x"), fingerprint(long), 0]


def linked(prints, distance=3):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= distance and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 5])
def test_links_equal_brute_force(spark, chunk):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(400):  # crowded: many fingerprints share blocks, some at exactly 3 and 4 bits
        value = rng.choice(seeds)
        for _ in range(rng.randint(0, 7)):
            value ^= 1 << rng.randrange(64)
        prints[value] = value
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    pairs = [(r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "fp long"), chunk=chunk).collect()]
    low = (1 << 64) - 1
    assert all((u & low) in prints and 0 < ((u ^ v) & low).bit_count() for u, v in pairs)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        x, y = sorted((root(u & low), root(v & low)))
        parent[y] = x
    assert {p: root(p) for p in prints} == linked(prints)


def test_simhash_edges(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(None, "only here"), (None, rows[0][1]), (7000, rows[0][1].upper()), (7001, None), (7002, ""), (7003, " \t\n"), (7004, "one"),
             (7004, "one"), (7005, "ONE"), (7006, "word " * 200_000)]
    docs = spark.createDataFrame(rows, DOC).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    low = (1 << 64) - 1
    assert Counter((r.doc_id, r.fp & low) for r in got) == Counter((d, fingerprint(t)) for d, t in rows)
    prints = {i: fingerprint(t) for i, (_, t) in enumerate(rows)}
    least = {}
    for i, root in linked(prints).items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    expected = Counter((rows[i][0], prints[i], least.get(root)) for i, root in linked(prints).items())
    assert Counter((r.doc_id, r.fp & low, r.component_id) for r in got) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs.selectExpr("1L AS fp"), distance=6)


# --- prefix trie ----------------------------------------------------------------------------

def turn_list(rows):
    key = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    out = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, key(r))):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return dict(out)


def trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, cs in members.items():
        own = (len(cs) - 1) * len(re.findall("[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += own
    return Counter((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path], leaves[path], saved[path],
                    hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(path)).encode()).hexdigest())
                   for path, cs in members.items())


def conversations(rng, n):
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 13])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", rng.choice(["a b", "c", "d  e f"])) for t in range(size)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"
ORDER = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("params", [{}, {"segment": 4, "shard_turns": 40}, {"shard_turns": 7}])
def test_trie_equals_brute_force(spark, params):
    rng = random.Random(6)
    rows = conversations(rng, 150)
    rows += [(200, None, None, None), (200, 3, "user", ""), (200, 3, "user", ""), (201, None, None, "x"), (201, None, "user", None), (None, 1, "user", "lost"),
             (-5, 1, "user", "a b"), (202, 1, "user", "long " * 300_000)]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(4)]  # many copies of one conversation
    rows += [(400, t, "user", "c") for t in range(14)]
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("key", F.lit("clash")).withColumn("pos", F.lit(9))
    got = prefix_trie.conversation_trie(frame, **params).select(*ORDER).collect()
    assert Counter(tuple(r) for r in got) == trie(turn_list(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    assert prefix_trie.conversation_trie(empty).columns == ORDER
    convs = spark.createDataFrame([(3,), (1,)], "conv_id long")
    got = [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.encoded(empty), convs).collect()]
    assert got == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]


def test_search_trees_are_balanced():
    rows = [{"ids": [i], "words": [1], "n": 1, "least": i, "ends": None, "below_children": 0} for i in range(1000)]
    tree, nodes = prefix_trie._grow(rows)
    height, stack = 0, [(tree.down[0], 1)]
    while stack:
        at, d = stack.pop()
        if at >= 0:
            height = max(height, d)
            stack += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert height <= 10 and sorted(tree.turn[x] for x in nodes) == list(range(1000))


def test_trie_query_rebuilds_every_conversation(spark, tmp_path):
    rng = random.Random(7)
    rows = [r for r in conversations(rng, 90) if r[0] not in (20, 40)] + [(61, None, "user", None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    own = turn_list(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).select(*ORDER).collect()
    assert Counter(tuple(r) for r in got) == trie(rebuilt)
    assert any(not t for t in rebuilt.values())
