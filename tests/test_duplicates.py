"""Hamming join, duplicate groups and boxes against brute force, with hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from photolake.operators import boxes as bx, hashing


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def bits(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1")


def corpus(n=120, seed=3):
    """Random hashes, near copies, a crowded neighbourhood, and one hash holding a third of all rows."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    near = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for h in base[:60]]
    crowd = [base[0] ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randint(1, 4))) for _ in range(60)]
    hot = [base[1]] * ((len(base) + len(near) + len(crowd)) // 2)
    hashes = [signed(h) for h in base + near + crowd + hot]
    rng.shuffle(hashes)
    return list(enumerate(hashes))


def table(spark, rows):
    return spark.createDataFrame(rows, "image_id bigint, h bigint")


@pytest.mark.parametrize("k, blocks, chunk", [(0, None, 4096), (3, None, 5), (3, 5, 4096), (6, 8, 20)])
def test_hamming_pairs_equal_brute_force(spark, k, blocks, chunk):
    rows = corpus()
    distinct = sorted({h for _, h in rows})
    want = sorted((a, b, bits(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bits(a, b) <= k)
    got = hashing.hamming_pairs(table(spark, rows).select("h").distinct(), None, k, blocks, chunk)
    assert sorted(tuple(r) for r in got.select("h1", "h2", "hamming").collect()) == want


def test_existing_duplicates(spark):
    rows = corpus()
    new, old = rows[::2], rows[1::2]
    want = sorted(i for i, h in new if any(bits(h, g) <= 5 for _, g in old))
    got = hashing.existing_duplicates(table(spark, new), table(spark, old), 5)
    assert sorted(r.image_id for r in got.collect()) == want


def greedy(rows, k):
    done, groups = set(), {}
    for i, h in rows:
        if i in done:
            continue
        members = [i] + [j for j, g in rows if j != i and j not in done and bits(h, g) <= k]
        done.update(members)
        if len(members) > 1:
            groups[i] = sorted(members)
    return groups


def test_keys_of_hashes_are_never_broadcast(spark):
    rows = table(spark, corpus())
    plan = hashing.hamming_pairs(rows.select("h").distinct(), rows.select("h").distinct(), 5)
    assert plan.collect()  # the plan is final only after its own run
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_groups_equal_the_sequential_result(spark):
    rows = corpus(60)
    chain, h = [], 0
    for i in range(12):  # a chain: each within reach of the next only
        h ^= sum(1 << (5 * i + b) for b in range(5))
        chain.append((5000 + i, signed(h)))
    rows = sorted(rows + chain)
    found = {}
    for r in hashing.duplicate_groups(table(spark, rows), 6).collect():
        found.setdefault(r.leader, []).append(r.image_id)
    assert {k: sorted(v) for k, v in found.items()} == greedy(rows, 6)


def test_crowded_corpus(spark):
    """A hundred thousand hashes that agree in half of their bits: every key of those is one bucket."""
    rng = random.Random(11)
    near = [rng.getrandbits(24) for _ in range(100_000)]
    distinct = sorted(set(near))
    rows = [(h << 40 | 12345,) for h in distinct]
    frame = spark.createDataFrame([(signed(h),) for h, in rows], "h bigint").repartition(4)
    got = {frozenset((r.h1, r.h2)) for r in hashing.hamming_pairs(frame, None, 1, blocks=4).collect()}
    known = set(distinct)
    want = {frozenset((signed(h << 40 | 12345), signed((h ^ 1 << b) << 40 | 12345))) for h in distinct for b in range(24) if h ^ 1 << b in known}
    assert got == want and len(want) > 1000


def test_long_chains_take_few_rounds(spark, monkeypatch):
    calls = []
    cut = hashing.cut
    monkeypatch.setattr(hashing, "cut", lambda df: (calls.append(1), cut(df))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(5000)], "lo bigint, hi bigint")
    assert sorted(r.node for r in hashing.greedy_leaders(chain).collect()) == list(range(0, 5001, 2))
    assert len(calls) <= 36


def test_leaders_of_random_graphs(spark):
    rng = random.Random(12)
    edges = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(700)} | {(i, i + 1) for i in range(500, 600)} | {(700, i) for i in range(701, 760)}
    leads = set()
    for node in sorted({x for e in edges for x in e}):
        if not any(lo in leads for lo, hi in edges if hi == node):
            leads.add(node)
    got = [r.node for r in hashing.greedy_leaders(spark.createDataFrame(sorted(edges), "lo bigint, hi bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == leads


def test_no_duplicates_at_all(spark):
    rows = [(1, 0), (2, 255), (3, -1)]
    assert hashing.duplicate_groups(table(spark, rows)).count() == 0


def overlap(a, b):
    iw = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    ih = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - iw * ih
    return iw * ih / union if union > 0 else 0.0


def some_boxes():
    rng = random.Random(5)
    rows = [(i % 3 if i % 2 else 7, i, rng.randint(0, 300), rng.randint(0, 300), rng.randint(10, 150), rng.randint(10, 150))
            for i in range(160)]
    return rows + [(7, 1000 + i, 5, 5, 40, 40) for i in range(20)] + [(8, 2000, 1, 1, 0, 0)]


BOX = "image_id bigint, box_id bigint, x int, y int, w int, h int"


def test_suppression_is_greedy(spark):
    rows = some_boxes()
    got = {}
    for r in bx.box_nms(spark.createDataFrame(rows, BOX)).collect():
        got.setdefault(r.image_id, []).append((r["rank"], r.box_id))
    def merit(b):
        w, h = b[4], b[5]
        return min(1.0, w * h / 90000) * (1 - abs(w / h - 1)) if w > 0 and h > 0 else 0.0
    for image in {b[0] for b in rows}:
        kept = []
        for b in sorted((b for b in rows if b[0] == image), key=lambda b: (-merit(b), b[1])):
            if len(kept) < 5 and all(overlap(b[2:], k[2:]) <= 0.3 for k in kept):
                kept.append(b)
        assert [i for _, i in sorted(got[image])] == [b[1] for b in kept]


def test_iou_pairs_state_every_overlap(spark):
    rows = some_boxes()
    shape = {b[1]: b[2:] for b in rows}
    first = {}
    for b in sorted(rows, key=lambda b: b[1]):
        first.setdefault((b[0], b[2:]), b[1])
    reps = [b for b in rows if first[(b[0], b[2:])] == b[1]]
    want = {(a[1], b[1]) for a in reps for b in reps
            if a[0] == b[0] and a[1] < b[1] and overlap(a[2:], b[2:]) > 0.3}
    want |= {(first[(b[0], b[2:])], b[1]) for b in rows if first[(b[0], b[2:])] != b[1]}
    got = bx.iou_pairs(spark.createDataFrame(rows, BOX)).collect()
    assert {(r.box_1, r.box_2) for r in got} == want and len(got) == len(want)
    assert all(abs(r.iou - overlap(shape[r.box_1], shape[r.box_2])) < 1e-9 for r in got if shape[r.box_1] != shape[r.box_2])


@pytest.mark.parametrize("threshold", [0.3, 0.05, 0.0])
def test_iou_pairs_of_all_sizes(spark, threshold):
    rng = random.Random(21)
    rows = [(1, i, rng.randint(-200, 3000), rng.randint(-200, 3000), int(10 ** rng.uniform(0, 3.5)), int(10 ** rng.uniform(0, 3.5))) for i in range(250)]
    rows += [(1, 900 + i, 10 * i, 7 * i, 0, 5) for i in range(3)] + [(1, 1000, 0, 0, 3000, 3000), (1, 1001, 100, 50, 3000, 2900)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and overlap(a[2:], b[2:]) > threshold}
    got = bx.iou_pairs(spark.createDataFrame(rows, BOX), threshold).collect()
    assert {(r.box_1, r.box_2) for r in got} == want and len(got) == len(want) > 1


def test_a_box_covers_at_most_four_cells_of_its_grid(spark):
    sides = spark.createDataFrame([(x, y, w, h) for x in (-5, 0, 31, 3000) for y in (7, 63) for w, h in ((1, 1), (33, 2), (3000, 3000), (64, 65))],
                                  "x int, y int, w int, h int")
    counts = sides.select(F.size(bx._covered_cells(bx._level_of(F.col("w"), F.col("h")))).alias("n")).collect()
    assert all(1 <= r.n <= 4 for r in counts)


def test_suppression_never_moves_boxes_by_image_alone(spark):
    rows = [(1, i, i % 50, i % 40, 20 + i % 30, 20 + i % 20) for i in range(60)]
    plan = bx.box_nms(spark.createDataFrame(rows, BOX))._jdf.queryExecution().executedPlan().toString().split("\n")
    alone = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(image_id#" in line and "salt" not in line and "Reused" not in line]
    assert alone and all("partial" in plan[i + 1] or "Sort" in plan[i + 1] or "functions=[" in plan[i + 1] for i in alone)
    assert not [line for line in plan if "box_id" in line.split("[plan_id")[0] and "Exchange" in line and "salt" not in line]


def test_fallback_only_without_first_methods(spark):
    rows = [(1, 1, "cascade"), (1, 2, "haar"), (2, 3, "haar"), (3, 4, "dnn"), (2, 5, "other")]
    got = bx.combine_detections(spark.createDataFrame(rows, "image_id bigint, box_id bigint, method string"))
    assert sorted(r.box_id for r in got.collect()) == [1, 3, 4]
