"""Search, tags, collection state, statistics, exports and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from photolake.operators import collect as co, metadata as md, models, predictions as pred, ranking, search, similarity, stats, tags
from photolake.sources import export, images
from photolake.streaming import streams

POST = ("post_id bigint, blog string, type string, post_ts timestamp_ntz, likes int, note_count int, is_nsfw boolean, "
        "tags array<string>, photos array<struct<url: string>>")


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def post(i, day=10, likes=9, notes=9, nsfw=False, tag=("art",), urls=1, kind="photo", blog="a"):
    return (i, blog, kind, ts(day), likes, notes, nsfw, list(tag) if tag is not None else None,
            [(f"https://{blog}.example.com/img/{i}_{n}.jpg",) for n in range(urls)])


def posts(spark, *rows):
    return spark.createDataFrame(list(rows), POST)


def test_search_limits_are_inclusive_and_nulls_count_as_zero(spark):
    rows = posts(spark, post(1, 5), post(2, 25), post(3, 26), post(4, likes=None), post(5, notes=2), post(6, nsfw=True),
                 post(7, nsfw=None), post(8, kind="text"), post(9, blog="b", urls=3), post(10, urls=0), post(11, tag=None))
    p = search.SearchParams(start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", min_likes=5, min_notes=3)
    ids = lambda q: sorted(r.post_id for r in search.search_posts(rows, q).collect())
    assert ids(p) == [1, 2, 7, 9, 9, 9, 11]
    assert ids(search.SearchParams(blogs=("b",), days=None)) == [9, 9, 9]
    assert ids(search.SearchParams(tags=("art", "x"), blogs=("b",), days=None)) == [9, 9, 9]
    assert ids(search.SearchParams(tags=("x",), days=None)) == []
    assert ids(search.SearchParams(content_type=("text",), days=None)) == [8]


def test_search_is_a_map(spark):
    plan = search.search_posts(posts(spark, post(1)), search.SearchParams(days=None))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tags(spark):
    rows = posts(spark, post(1, tag=("SELFIE", "表情")), post(2, tag=("sunset",)), post(3, tag=()), post(4, tag=("ヌード",)))
    found = {}
    for r in tags.translate_tags(rows).collect():
        found.setdefault((r.post_id, r.tag), set()).add(r.expanded)
    assert found[(1, "SELFIE")] == {"selfie", "自撮り", "セルフポートレート", "セルフショット"}
    assert {"face", "expression", "visage", "look"} <= found[(1, "表情")]
    assert set(p for p, _ in found) == {1, 4}
    verdict = {r.post_id: r for r in tags.classify_by_tags(rows).collect()}
    assert verdict[1].matched_tags == ["expression", "face", "selfie"] and verdict[1].is_person
    assert abs(verdict[1].confidence - 3 / 21) < 1e-12
    assert not verdict[2].is_person and not verdict[3].is_person and verdict[4].is_nsfw and not verdict[4].is_person
    assert sorted(r.post_id for r in tags.tag_search(rows, "自撮り").collect()) == [1]


def test_quota_with_a_hot_tag(spark):
    rows = posts(spark, *[post(i, tag=("art",) if i % 3 else ("art", f"t{i % 5}")) for i in range(120)])
    counts = {r.tag: r.n for r in tags.tag_quota_sample(rows).groupBy("tag").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) <= 10 and counts["art"] == 10
    related = tags.related_images(rows).collect()
    assert all(r.post_id != r.other_post_id for r in related)
    per = {}
    for r in related:
        per.setdefault(r.post_id, []).append(r.url)
    assert len(per) == 120 and all(len(v) == 3 for v in per.values())


# --- state ----------------------------------------------------------------------------------

def state(spark, total, downloaded, skipped, errors, params, end=ts(1)):
    items = [(u, "downloaded") for u in downloaded] + [(u, "skipped") for u in skipped]
    return co.State(spark.createDataFrame(items, co.ITEMS), spark.createDataFrame([(e, e) for e in errors], co.ERRORS),
                    spark.createDataFrame([(total, params, end)], co.RUNS))


def count(s, status):
    return s.items.where(F.col("status") == status).count()


def test_merge_case(spark):
    a = state(spark, 10, ["1", "2"], ["3"], [], {"blogs": "x"}, ts(1))
    b = state(spark, 5, ["4", "5"], ["6"], ["network error"], {"tags": "y"}, ts(2))
    m = co.merge_collections(a, b)
    run = m.runs.first()
    assert (run.total_found, count(m, "downloaded"), count(m, "skipped"), m.errors.count()) == (15, 4, 2, 1)
    assert run.params == {"blogs": "x", "tags": "y"} and run.end_ts == ts(2)
    other = co.merge_collections(b, a)
    assert sorted(m.items.collect()) == sorted(other.items.collect())
    newer = co.merge_collections(a, state(spark, 0, ["1"], [], [], {"blogs": "z"}))
    assert newer.runs.first().params == {"blogs": "z"} and count(newer, "downloaded") == 2


def test_default_window_is_thirty_days(spark):
    rows = posts(spark, *[post(i, i) for i in range(1, 29)])
    found = lambda **p: sorted({r.post_id for r in search.search_posts(rows, search.SearchParams(**p)).collect()})
    assert found() == []  # all posts are long past
    assert found(now="2024-02-09 00:00:00") == [i for i in range(1, 29) if i >= 10]
    assert found(now="2024-01-12 23:00:00", days=2) == [i for i in (10, 11, 12) if ts(i) >= dt.datetime(2024, 1, 10, 23)]
    assert found(days=None) == list(range(1, 29)) and found(end="2024-01-05 00:00:00") == found(days=None, end="2024-01-05 00:00:00")


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert export.load_state(spark, path) is None
    export.save_state(state(spark, 15, ["1", "2", "3"], ["4"], [], {"k": "v"}), path, "2024-01-01T00:00:00")
    back = export.load_state(spark, path)
    assert (back.runs.first().total_found, count(back, "downloaded"), count(back, "skipped"), back.errors.count()) == (15, 3, 1, 0)
    export.save_state(state(spark, 16, ["9"], [], ["e"], {}), path, "2024-01-02T00:00:00")
    later = export.load_state(spark, path)
    assert (later.runs.first().total_found, later.items.count(), later.errors.count()) == (16, 1, 1)
    export.save_state(state(spark, 16, ["9"], [], ["e"], {}), path, "2024-01-02T00:00:00")
    again = export.load_state(spark, path)
    assert (again.runs.count(), again.items.count(), again.errors.count()) == (1, 1, 1)


def test_a_damaged_save_gives_the_one_before(spark, tmp_path):
    path, folder = str(tmp_path / "state"), tmp_path / "state"
    for day in (1, 2, 3, 4):
        export.save_state(state(spark, day, [f"{day}-{i}" for i in range(500)], [], [], {"day": str(day)}), path, f"2024-01-0{day}T00:00:00")
    newest = lambda: getattr(export.load_state(spark, path), "runs", None) and export.load_state(spark, path).runs.first().total_found
    assert newest() == 4
    for f in (folder / "saves" / "2024-01-04T00-00-00" / "items").glob("*.parquet"):  # a data page, not the footer
        raw = bytearray(f.read_bytes())
        raw[len(raw) // 3:len(raw) // 3 + 40] = b"x" * 40
        f.write_bytes(bytes(raw))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert newest() == 3
    for f in (folder / "saves" / "2024-01-03T00-00-00" / "runs").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    assert newest() == 2
    for f in (folder / "manifests" / "2024-01-02T00-00-00").glob("*.parquet"):  # a save without its manifest does not exist
        f.write_bytes(b"cut off")
    assert newest() == 1
    for f in (folder / "saves" / "2024-01-01T00-00-00" / "items").glob("*.parquet"):
        f.unlink()
    assert export.load_state(spark, path) is None


def test_resume_window(spark):
    now = "2024-03-01 00:00:00"
    w = co.resume_window(state(spark, 1, [], [], [], {}, ts(20)).runs, now).first()
    assert (w.start_ts, w.end_ts) == (ts(20), dt.datetime(2024, 3, 1))
    none = co.resume_window(spark.createDataFrame([], co.RUNS), now).first()
    assert none.start_ts == dt.datetime(2024, 1, 31)


# --- filters and collection -----------------------------------------------------------------

IMAGE = "image_id bigint, path string, width int, height int, length bigint, format string"


def raw(spark, **grids):
    rows = [(int(i[1:]), 24, 24, bytearray((b * 24 * 24 * 3)[:24 * 24 * 3])) for i, b in grids.items()]
    return spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")


RAMP = bytes(range(256))


def test_filter_case(spark):
    im = spark.createDataFrame([(1, "/a/1.jpg", 800, 600, 10, "jpg"), (2, "/a/2.jpg", 800, 600, 10, "jpg"),
                                (3, "/a/3.jpg", 499, 600, 10, "jpg"), (4, "/a/4.jpg", 800, 500, 10, "jpg")], IMAGE)
    r = raw(spark, i1=RAMP, i2=b"\x50", i3=RAMP, i4=RAMP)
    p = md.FilterParams(min_resolution=(500, 500), ratio_range=(1.0, 1.5), entropy_threshold=2.0)
    assert [x.image_id for x in md.advanced_filter(im, r, p).collect()] == [1]  # 2 is flat, 3 small, 4 too wide


def test_collection_statuses_are_disjoint(spark):
    rows = posts(spark, *[post(i, 10 + i) for i in range(1, 7)])
    im = spark.createDataFrame([(i, f"/a/{i}.jpg", 1000, 800 if i != 2 else 100, 10, "jpg") for i in range(1, 6)], IMAGE)
    votes = spark.createDataFrame([(i, "anime" if i != 5 else "sketch", 0.9) for i in range(1, 6)],
                                  "image_id bigint, label string, confidence double")
    key = F.regexp_extract("url", r"/img/(\d+)_", 1).cast("long")
    cat = co.Catalogue(im, raw(spark, i1=RAMP, i2=RAMP, i4=RAMP, i5=RAMP), votes, key)
    p = co.CollectParams(search=search.SearchParams(min_likes=5, min_notes=3, days=None), styles=("anime",), run_ts="2024-02-01 00:00:00")
    first = {r.image_id: (r.status, r.reason) for r in co.collect_images(rows, cat, p).collect()}
    assert first == {1: ("downloaded", None), 2: ("skipped", "filters"), 3: ("error", "no pixels"),
                     4: ("downloaded", None), 5: ("skipped", "style"), 6: ("error", "no image")}
    files = co.collect_images(rows, cat, p).where("image_id = 4").select("filename")
    assert files.first().filename.startswith("a_20240201_000000_")
    again = co.collect_images(rows, cat, p, existing=files)
    parts = co.status_partition(again)
    assert [r.reason for r in parts["skipped"].where("image_id = 4").collect()] == ["exists"]
    assert sum(f.count() for f in parts.values()) == 6
    none_known = co.collect_images(rows, cat, p, known=parts["downloaded"])
    assert 1 not in [r.image_id for r in none_known.collect()]
    assert co.collect_images(rows, cat, co.CollectParams(search=search.SearchParams(min_likes=5, min_notes=3, days=None), max_images=2)).count() == 2


# --- ranking, statistics, exports -----------------------------------------------------------

def test_running_totals_in_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 4}", i * 7919 % 1009, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint").repartition(3)
    got = ranking.running_before(df, ["g"], [F.col("o")], F.col("v"), "before").collect()
    assert len(got) == 400
    for r in got:
        assert r.before == sum(v for g, o, v in rows if g == r.g and o < r.o)


def test_eviction(spark):
    files = spark.createDataFrame([("d", f"/d/{i}", 100, i) for i in range(10)] + [("e", "/e/1", 100, 1)],
                                  "cache_dir string, path string, length bigint, atime bigint")
    out = ranking.cache_eviction(files, max_bytes=500)
    assert sorted(r.path for r in out.where("evict").collect()) == [f"/d/{i}" for i in range(6)]
    done = {r.cache_dir: r for r in ranking.cleanup_performed(out).collect()}
    assert (done["d"].bytes_after, done["d"].cleanup_performed, done["e"].cleanup_performed) == (400, True, False)


def test_stats_of_an_empty_log(spark):
    none = spark.createDataFrame([], "attempt_id bigint, url string, ts timestamp_ntz, attempt int, outcome string, error_type string")
    r = stats.download_stats(none).first()
    assert (r.total_attempts, r.success_rate) == (0, 0.0)


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([Row(id=1, size=Row(w=2, h=3), name="x,y")])
    b = spark.createDataFrame([Row(id=2, extra=["p"])])
    export.export_metadata(a, str(tmp_path / "j"), "unknown")
    line = "".join(f.read_text() for f in (tmp_path / "j").glob("*.json"))
    assert json.loads(line)["size"] == {"w": 2, "h": 3}
    export.export_metadata_csv(str(tmp_path / "c"), a, b)
    back = {r.id: r for r in spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).collect()}
    assert back["1"].asDict().keys() == {"extra", "id", "name", "size"} and back["1"].name == "x,y" and back["2"].extra == '["p"]'
    meta = spark.createDataFrame([(1, "a.PNG", True), (2, "b.webp", True), (3, "c.gif", False)], "image_id bigint, filename string, is_person boolean")
    assert tuple(md.organize_by_class(meta).first()) == (2, 1, 1)
    export.write_organised(md.organised(meta), str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o").glob("is_person=*")) == ["is_person=false", "is_person=true"]



def test_organised_types_are_taken_before_decoding(spark):
    names = ["/img/a/1.PNG", "/img/a/2.webp", "/img/b.png/3", "/img/b/4.jpeg", None]
    files = spark.createDataFrame([(i, p, 2, 2, 12) for i, p in enumerate(names)], "image_id bigint, path string, width int, height int, length bigint")
    bitmaps = spark.createDataFrame([(i, 2, 2, bytearray(range(12))) for i in range(5)], "image_id bigint, width int, height int, data binary")
    posts = spark.createDataFrame([(0, ["smile"]), (1, ["smile"]), (3, ["art"])], "image_id bigint, tags array<string>")
    boxes = spark.createDataFrame([(0, 1), (1, 2)], "image_id bigint, box_id bigint")
    kept = md.organisable(files)
    assert sorted(r.image_id for r in kept.collect()) == [0, 3]
    found, all_files = (sorted(md.organised(md.post_metadata(x, bitmaps, posts, boxes)).collect()) for x in (kept, files))
    assert found == all_files and [(r.image_id, r.is_person, r.detected_faces) for r in found] == [(0, True, 1), (3, False, 0)]


def test_tags_of_an_image_are_collected_once_each(spark, tmp_path):
    from photolake.plans.q_metadata import image_posts
    tables = {"documents": ([(0, "ab", "x"), (1, None, "y")], "doc_id bigint, text string, source string"),
              "labels": ([(0, 1), (0, 0)], "doc_id bigint, toxic int"),
              "events": ([(e, dt.datetime(2024, 1, 1), u, "view", 1.0, '{"k": 1}') for e, u in ((2, 0), (4, 0), (14, 0), (2, 0), (7, 2), (7, 2), (17, 3))],
                         "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    tagged = image_posts(spark, str(tmp_path))
    assert "collect_set" not in tagged._jdf.queryExecution().executedPlan().toString()
    assert {r.image_id: r.tags for r in tagged.collect()} == {0: ["Landscape", "Musician", "portrait"], 1: ["Landscape", "nsfw"]}


# --- models and search ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float((i % 3 == c) + 0.05 * ((i * 37 + c * 11) % 7)) for c in range(3)], i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "image_id bigint, embedding array<float>, class_index int").cache()


def test_head_learns_and_survives_a_round_trip(spark, vectors, tmp_path):
    names = ["x", "y", "z"]
    model = models.train_head(vectors, 3, rate=4.0)
    scored = models.predict_batch(model, vectors, names, 0.5)
    sums = scored.groupBy("image_id").agg(F.sum("confidence").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n == 3 for r in sums)
    right = pred.best_label(scored).join(vectors, "image_id").where(F.element_at(F.array(*map(F.lit, names)), F.col("class_index") + 1) == F.col("label"))
    assert right.count() == 60
    models.save_model(spark, model, str(tmp_path / "m"))
    assert models.load_model(spark, str(tmp_path / "m")) == model
    again = models.predict_batch(models.load_model(spark, str(tmp_path / "m")), vectors, names, 0.5)
    assert sorted(again.collect()) == sorted(scored.collect())

    @F.pandas_udf("array<double>")
    def scorer(v):
        return v.map(lambda a: [float(x) for x in a])
    assert models.score_with(vectors, lambda c: scorer(c), names).count() == 180


def test_head_stops_and_keeps_the_best_weights(spark, vectors):
    parted = vectors.withColumn("part", F.when(F.col("image_id") % 4 == 0, "validation"))
    # Held-out classes contradict what is learnt, so the loss on them rises from the second epoch on.
    wrong = parted.withColumn("class_index", F.when(F.col("part") == "validation", (F.col("class_index") + 1) % 3).otherwise(F.col("class_index")))
    model = models.train_head(wrong, 3, epochs=30, patience=3)
    assert model.best_epoch == 1 and len(model.losses) == 4 and model.losses[0] == min(model.losses)
    assert model.weights == models.train_head(wrong, 3, epochs=1).weights
    full = models.train_head(parted.repartition(7), 3, epochs=6, patience=3)
    assert full == models.train_head(parted.coalesce(1), 3, epochs=6, patience=3)  # exact sums, whatever the placement
    assert list(full.losses) == sorted(full.losses, reverse=True) and full.best_epoch == 6
    odd = parted.unionByName(spark.createDataFrame([(99, None, 1, None), (98, [1.0, 2.0, 3.0], None, None)], parted.schema))
    assert models.train_head(odd, 3, epochs=6, patience=3) == full
    with pytest.raises(ValueError):
        models.train_head(parted.limit(0), 3)


@pytest.mark.parametrize("block", [7, 1000])
def test_batch_neighbours_equal_single_searches(spark, vectors, block):
    emb = vectors.select(F.col("image_id").alias("vec_id"), "embedding")
    got = {}
    for r in similarity.batch_neighbors(emb, emb, 4, block, block + 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = round(r.similarity, 9)
    assert len(got) == 60
    for q in (0, 17, 59):
        vector = emb.where(F.col("vec_id") == q).first().embedding
        best = [round(r.similarity, 9) for r in similarity.semantic_search(emb.where(F.col("vec_id") != q), vector, 4).collect()]
        assert [got[q][i] for i in (1, 2, 3, 4)] == best


def test_far_blocks_never_meet(spark):
    """Clusters at right angles: neighbours equal the full product, though most pairs of blocks are left out."""
    rng = np.random.default_rng(5)
    points = [(i, [float(x) for x in np.eye(6)[i % 6] + rng.normal(0, 0.02, 6)]) for i in range(300)]
    points += [(300, [0.0] * 6), (301, [0.0] * 6), (302, points[0][1]), (303, points[0][1]), (304, None)]
    emb = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    left, _ = similarity.neighbor_blocks(emb, emb, 5, 20, 20)
    ordinary = left.where(~F.col("query_id").isin(300, 301)).select("query_id", "cell")
    assert ordinary.distinct().count() < 0.5 * 302 * left.select("cell").distinct().count()
    known = points[:-1]
    full = np.array([p[1] for p in known])
    unit = np.divide(full, np.linalg.norm(full, axis=1, keepdims=True), out=np.zeros_like(full), where=full.any(axis=1, keepdims=True))
    expected = set()
    for i, row in enumerate(np.round(unit @ unit.T, 12)):
        best = sorted((-s, j) for j, s in enumerate(row) if j != i)[:5]
        expected |= {(i, j, rank) for rank, (_, j) in enumerate(best, 1)}
    got = {(r.query_id, r.vec_id, r["rank"]) for r in similarity.batch_neighbors(emb, emb, 5, 20, 20).collect()}
    assert got == expected
    assert similarity.batch_neighbors(emb.limit(0), emb, 5).count() == 0 and similarity.batch_neighbors(emb, emb.limit(0), 5).count() == 0
    zeros = emb.where("vec_id IN (300, 301)")
    assert [(r.query_id, r.vec_id) for r in similarity.batch_neighbors(zeros, zeros, 5).orderBy("query_id").collect()] == [(300, 301), (301, 300)]


def test_neighbours_move_no_vector_twice(spark):
    """What is exchanged is the tables, once each, and the k best; the corpus is stored once, however many blocks meet."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 8))
    vectors[40:80] = vectors[0]  # more copies than k in one block
    vectors[80:83] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (5, rows[0][1]), (7, rows[7][1]), (900, None), (901, [float("nan")] * 8), (902, [1.0] * 7 + [None])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    known = [(i, np.array(v)) for i, v in rows[:404]]
    unit = np.stack([v / (np.linalg.norm(v) or 1) for _, v in known])
    sims, expected = np.round(unit @ unit.T, 12), {}
    for i, (q, _) in enumerate(known):
        expected.setdefault(q, []).extend((-sims[i, j], o) for j, (o, _) in enumerate(known) if o != q)
    want = sorted((q, o, rank) for q, pairs in expected.items() for rank, (_, o) in enumerate(sorted(pairs)[:5], 1))
    for blocks in ((30, 50), (1000, 1000)):
        found = similarity.batch_neighbors(emb, emb, 5, *blocks)
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Join" not in plan and "Generate" not in plan
    cells = similarity.store_cells(emb.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("vector")), 5, 50)
    assert len([name for names in cells.files for name in names]) >= 8 and 360 <= cells.size.sum() <= 404 and cells.copies == 4
    mask = rng.random((13, 11)) < 0.1
    assert similarity._true(mask).tolist() == np.flatnonzero(mask).tolist()


# --- streams --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Five files of posts, arriving one per batch; urls repeat across files."""
    folder = tmp_path_factory.mktemp("feed")
    rows = [post(i, 1 + i // 20, tag=("art", f"t{i % 3}")) for i in range(100)]
    rows += [post(200 + i, 6)[:8] + (rows[i][8],) for i in range(20)]
    for n in range(6):
        posts(spark, *rows[20 * n:20 * n + 20]).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), posts(spark, *rows)


def test_stream_equals_batch(spark, feed, tmp_path):
    folder, batch = feed
    params = search.SearchParams(end="2024-01-04 00:00:00")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        streams.stream_collect(streams.read_stream(spark, folder, batch.schema), params, tags.related_pool(batch), out, str(tmp_path / "c"))
    done = spark.read.parquet(out)
    want = search.search_posts(batch, params)
    assert sorted(r.url for r in done.where("kind = 'found'").collect()) == sorted(r.url for r in want.collect())
    assert done.select("batch_id").distinct().count() > 1
    related = tags.related_images(batch).join(want.select("post_id").distinct(), "post_id", "left_semi")
    columns = ["post_id", "tag", "rank", "other_post_id", "url"]
    assert sorted(done.where("kind = 'related'").select(*columns).collect()) == sorted(related.select(*columns).collect()) != []
    # A batch that is done again replaces its own rows.
    before = done.count()
    last = done.agg(F.max("batch_id")).first()[0]
    rows = done.where(F.col("batch_id") == last).drop("batch_id").collect()
    streams.write_batch(spark.createDataFrame(rows, done.drop("batch_id").schema), last, out)
    assert spark.read.parquet(out).count() == before


def test_stream_dedup(spark, feed, tmp_path):
    folder, batch = feed
    stream = search.photo_rows(streams.read_stream(spark, folder, batch.schema))
    streams.stream_dedup(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted({r.url for r in search.photo_rows(batch).collect()})


def test_stream_dedup_keeps_late_urls_and_reads_no_results(spark, tmp_path):
    out, sent = str(tmp_path / "out"), []
    for n, urls in enumerate((["a", "b", "a"], ["b", "c"], ["a", "z", "c"])):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_dedup(streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), out, str(tmp_path / "c"))
        sent += urls
        if n == 0:  # results that are gone are not sent again: what was seen is state
            (tmp_path / "out").rename(tmp_path / "taken")
    got = [r.url for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["c", "z"] and {r.url for r in spark.read.parquet(str(tmp_path / "taken")).collect()} == {"a", "b"}


def test_stream_quota_gives_a_repeated_post_no_second_place(spark, tmp_path):
    schema = "post_id bigint, tags array<string>"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(i, ["art"]) for i in range(6)], [(i, ["art"]) for i in range(6)] * 3, [(i, ["art"]) for i in range(4, 9)], [(i, ["art"]) for i in range(50)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        streams.stream_tag_quota(streams.read_stream(spark, folder, spark.read.parquet(folder).schema), out, str(tmp_path / "c"))
    got = [(r.batch_id, r.post_id) for r in spark.read.parquet(out).collect()]
    assert len(got) == 10 and {p for b, p in got if b == 0} == set(range(6)) and {p for b, p in got if b == 2} == {6, 7, 8}
    assert not [p for b, p in got if b == 1] and len({p for _, p in got}) == 10


def test_stream_quota_holds_across_batches(spark, feed, tmp_path):
    folder, batch = feed
    streams.stream_tag_quota(streams.read_stream(spark, folder, batch.schema), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    counts = {r.tag: r.n for r in got.groupBy("tag").agg(F.count("*").alias("n")).collect()}
    sizes = {r.tag: r.n for r in tags.sample_tag(batch).groupBy("tag").agg(F.count("*").alias("n")).collect()}
    assert counts == {t: min(10, n) for t, n in sizes.items()}
    assert got.select("post_id").distinct().count() == got.count()


def test_stream_stats(spark, tmp_path):
    for n in range(3):
        rows = [(ts(1 + n, h % 24), "success" if h % 4 else "failed") for h in range(30)]
        spark.createDataFrame(rows, "ts timestamp_ntz, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [(dt.datetime(2020, 1, 1), "success")]  # counts, however late
    spark.createDataFrame(late, "ts timestamp_ntz, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.read.parquet(str(tmp_path / "in"))
    streams.stream_stats(streams.read_stream(spark, str(tmp_path / "in"), log.schema), str(tmp_path / "out"), str(tmp_path / "c"))
    got = streams.latest_counts(spark.read.parquet(str(tmp_path / "out")))
    want = log.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "outcome").agg(F.count("*").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
