"""Decoding, rasters, stencils and features on small images with known answers."""

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.operators import boxes as bx, features, hashing, metadata as md, raster, tallies, texture
from photolake.plans import q_decode
from photolake.sources import images


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def frame(spark, grids):
    """(image_id, width, height, data) from arrays of shape h x w x 3."""
    rows = [(i, g.shape[1], g.shape[0], bytearray(g.astype(np.uint8).tobytes())) for i, g in enumerate(grids)]
    return spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")


def tiles(spark, *grids, **params):
    return images.image_tiles(frame(spark, grids), halo=True, **params).cache()


def noise(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3))


def gray(g):
    return (299 * g[..., 0] + 587 * g[..., 1] + 114 * g[..., 2] + 500) // 1000



def test_listing_and_decoding(spark, tmp_path):
    sub = tmp_path / "cats"
    sub.mkdir()
    pixels = noise(2, 3)
    (sub / "a.png").write_bytes(png(pixels))
    (sub / "b.JPG").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("no")
    listed = images.list_images(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.select("path").collect()) == ["a.png", "b.JPG"]
    assert "ReadSchema: struct<path:string>" in listed.select("path")._jdf.queryExecution().executedPlan().toString()
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.decode_images(spark, str(sub)).collect()}
    good, bad = rows["a.png"], rows["b.JPG"]
    assert (good.width, good.height, good.mode, good.format, good.error) == (3, 2, "RGB", "png", None)
    assert good.aspect_ratio == 1.5
    assert bad.width is None and bad.error == "cannot decode"
    decoded = images.decode_images(spark, str(sub)).withColumn("image_id", F.lit(1).cast("long"))
    px = raster.explode_pixels(images.image_tiles(decoded, bgr=True)).collect()
    assert len(px) == 6
    for p in px:
        assert (p.r, p.g, p.b) == tuple(pixels[p.y, p.x])
        assert p.gray == gray(pixels)[p.y, p.x]
    labels = images.labels_from_path(decoded.select("image_id", "path")).collect()
    assert {(r.label, r.class_index) for r in labels} == {("cats", 0)}


def test_files_are_listed_some_folders_at_a_time(spark, tmp_path, monkeypatch):
    """No read lists more files than allowed, and together they decode every image once."""
    n = 90
    texts = [(i, "x" * (3 * i + 1) if i % 10 else None) for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    listed, decode = [], images.decode_images
    monkeypatch.setattr(q_decode, "AT_ONCE", 12)
    monkeypatch.setattr(images, "decode_images", lambda *a: listed.append(len((df := decode(*a)).inputFiles())) or df)
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    rows = {r.image_id: r for r in q_decode.decode_images(spark, str(tmp_path)).collect()}
    assert sum(listed) == n - 9 and 1 < len(listed) and max(listed) <= 12 and spark.conf.get(name) == before
    assert sorted(rows) == [i for i in range(n) if i % 10] and all(r.red == ord("x") * r.width * r.height and r.error is None for r in rows.values())
    assert q_decode.groups([("a", 5), ("b", 9), ("c", 3), ("d", 40), ("e", 1)], 12) == [["a"], ["b", "c"], ["d"], ["e"]]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert q_decode.decode_images(spark, f"{tmp_path}/none").count() == 0


def mirrored(v, y, x):
    h, w = v.shape
    y = min(1, h - 1) if y < 0 else max(h - 2, 0) if y >= h else y
    x = min(1, w - 1) if x < 0 else max(w - 2, 0) if x >= w else x
    return int(v[y, x])


def stencils(v):
    """(lap, gx, gy) of every pixel."""
    h, w = v.shape
    pad = np.array([[mirrored(v, y, x) for x in range(-1, w + 1)] for y in range(-1, h + 1)], dtype=np.int64)
    at = lambda dy, dx: pad[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
    lap = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * at(0, 0)
    gx = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return lap, gx, gy


def test_tiles_hold_whole_images(spark):
    big, small = noise(150, 131), noise(3, 2, 2)
    rows = tiles(spark, big, small).collect()
    assert sorted((r.image_id, r.y0, r.x0, r.h, r.w) for r in rows) == [
        *[(0, y, x, min(64, 150 - y), min(64, 131 - x)) for y in (0, 64, 128) for x in (0, 64, 128)], (1, 0, 0, 3, 2)]
    for r in rows:
        g = (big, small)[r.image_id]
        px = np.array(r.px).reshape(r.h, r.w)
        assert (r.width, r.height) == (g.shape[1], g.shape[0])
        part = g[r.y0:r.y0 + r.h, r.x0:r.x0 + r.w]
        assert all(((px >> s & 255) == part[..., k]).all() for k, s in enumerate((16, 8, 0)))
        pad = np.array(r.pad).reshape(r.h + 2, r.w + 2) >> 24 & 255
        v = gray(g)
        assert all(pad[i, j] == mirrored(v, r.y0 + i - 1, r.x0 + j - 1) for i in range(r.h + 2) for j in range(r.w + 2))


def test_bytes_repeat_and_empty_images_have_no_tile(spark):
    rows = [(0, 2, 2, bytearray(b"abcd")), (1, 1, 1, bytearray()), (2, 1, 1, None), (3, 0, 0, bytearray(b"x"))]
    got = images.image_tiles(spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")).collect()
    assert [r.image_id for r in got] == [0] and [x & 0xFFFFFF for x in got[0].px] == [0x616263, 0x646162, 0x636461, 0x626364]


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (1, 6), (6, 1), (2, 2), (13, 9)])
def test_stencils_mirror_their_borders(spark, shape):
    g = noise(*shape)
    lap, gx, gy = stencils(gray(g))
    r = tiles(spark, g, side=4)
    found = raster.laplacian(r).collect()
    assert len(found) == shape[0] * shape[1] and all(p.lap == lap[p.y, p.x] for p in found)
    assert all((p.gx, p.gy) == (gx[p.y, p.x], gy[p.y, p.x]) for p in raster.sobel(r).collect())


def test_features_of_many_tiles_equal_those_of_the_whole(spark):
    g = noise(150, 131) // 3 + np.arange(131)[None, :, None]
    v, (lap, gx, gy) = gray(g).astype(np.int64), stencils(gray(g))
    r = tiles(spark, g)
    assert r.count() == 9
    row = texture.tone_and_edges(r).first()
    close = lambda a, b: abs(a - b) < 1e-9 * max(1, abs(b))
    assert close(row.sharpness, lap.var()) and close(row.contrast, v.std()) and close(row.brightness, v.mean())
    assert close(row.edge_density, np.hypot(gx, gy).mean()) and row.dynamic_range == v.max() - v.min()
    both = texture.color_and_blur(r).first()
    assert close(both.blur_score, texture.blur_score(r).first().blur_score) and close(both.color_ratio, features.color_ratio(r).first().color_ratio)
    counts = np.bincount(v.reshape(-1), minlength=256) / v.size
    assert close(features.gray_entropy_bits(r).first().entropy, -(counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    assert close(features.color_variance(r).first().variance, g.reshape(-1).var())
    values, often = np.unique((g[..., 0] << 16 | g[..., 1] << 8 | g[..., 2]).reshape(-1), return_counts=True)
    profile = features.color_profile(r).first()
    assert (profile.r << 16 | profile.g << 8 | profile.b) == values[often.argmax()]
    assert profile.hist_g == np.bincount(g[..., 1].reshape(-1), minlength=256).tolist() and close(profile.variance, g.reshape(-1).var())
    for name, dy, dx in texture.DIRECTIONS:
        a = v[:150 - dy, max(0, -dx):131 - max(0, dx)]
        b = v[dy:, max(0, dx):131 + min(0, dx)]
        pairs = Counter(zip(a.reshape(-1).tolist(), b.reshape(-1).tolist()))
        want = {(i, j): (pairs[i, j] + pairs[j, i]) / (2 * a.size) for x in pairs for i, j in (x, x[::-1])}
        got = {(c.i, c.j): c.p for c in texture.glcm(r, angles=(name,)).collect()}
        assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    sections = {s.section: s.mean_g for s in features.thirds_composition(r).collect()}
    assert close(sections[5], g[50:100, 86:, 1].mean()) and len(sections) == 9
    thumb = {(t.y, t.x): t.r for t in raster.thumbnail_raster(r, 24, 16).collect()}
    ys, xs = np.arange(150) * 16 // 150, np.arange(131) * 13 // 131
    assert len(thumb) == 16 * 13 and close(thumb[15, 4], g[np.ix_(ys == 15, xs == 4)][..., 0].mean())
    flips = {(p.y, p.x): p.r for p in raster.augment_raster(r).where("variant = 'flip'").collect()}
    assert len(flips) == v.size and close(flips[140, 3], g[140, 127, 0] / 255)


def overlap(t, n, m, y):
    return max(0, min((t + 1) * n, (y + 1) * m) - max(t * n, y * m))


@pytest.mark.parametrize("size", [lambda w, h: images.squeezed(w, h, 5), lambda w, h: images.lowered(w, h, 7)])
def test_resampling_weighs_by_area(spark, size):
    g = noise(19, 12)
    w, h = size(12, 19)
    wy = np.array([[overlap(t, 19, h, y) for y in range(19)] for t in range(h)])
    wx = np.array([[overlap(t, 12, w, x) for x in range(12)] for t in range(w)])
    want = np.stack([(2 * (wy @ g[..., k] @ wx.T) + 19 * 12) // (2 * 19 * 12) for k in range(3)], axis=2)
    row = tiles(spark, g, size=size).first()
    px = np.array(row.px).reshape(h, w)
    assert all(((px >> s & 255) == want[..., k]).all() for k, s in enumerate((16, 8, 0)))
    bands = images._resampled(g.astype(np.uint8), w, h, rows=4)
    assert (bands == want).all()
    assert images.squeezed(80, 300) == (80, 100) and images.lowered(1000, 900) == (333, 300) and images.lowered(7, 300) == (7, 300)


def test_feature_invariants(spark):
    flat, wild = np.full((6, 9, 3), 77), noise(20, 30)
    r = tiles(spark, flat, wild)
    sums = {x.image_id: x.n for x in features.color_histogram(r).groupBy("image_id").agg(F.sum("cnt").alias("n")).collect()}
    assert sums == {0: 3 * 54, 1: 3 * 600}
    for entropy in (features.gray_entropy_nats, features.gray_entropy_bits):
        found = {x.image_id: x.entropy for x in entropy(r).collect()}
        assert found[0] == 0 and found[1] > 3
    matrix = texture.glcm(r).cache()
    assert all(abs(x.s - 1) < 1e-9 for x in matrix.groupBy("image_id", "angle").agg(F.sum("p").alias("s")).collect())
    cells = {(x.image_id, x.angle, x.i, x.j): x.p for x in matrix.collect()}
    assert all(cells[(a, b, j, i)] == p for (a, b, i, j), p in cells.items())
    same = {x.image_id: x for x in texture.glcm_features(matrix).collect()}[0]
    assert (same.contrast, same.energy, same.correlation) == (0, 1, 1)
    mode = {x.image_id: (x.r, x.g, x.b) for x in features.dominant_color_mode(r).collect()}
    assert mode[0] == (77, 77, 77)


@pytest.mark.parametrize("shape", [(32, 32), (9, 5), (150, 131)])
def test_phash_bits_match_a_direct_transform(spark, shape):
    g = noise(*shape) // 2 + (np.arange(shape[1]) % 90)[None, :, None]
    v = gray(g).astype(object)
    basis = np.array([[round(np.cos(np.pi * u * (2 * x + 1) / 64) * 16384) for x in range(32)] for u in range(8)], dtype=object)
    wy, wx = (basis @ np.array([[overlap(t, n, 32, y) for y in range(n)] for t in range(32)], dtype=object) for n in shape)
    c = (wy @ v @ wx.T).reshape(-1).tolist()
    middle = sorted(c)[31] + sorted(c)[32]
    want = sum(1 << (63 - i) for i in range(64) if 2 * c[i] > middle)
    got = hashing.phash(tiles(spark, g)).first().h
    assert got & (2 ** 64 - 1) == want


def test_crops_clip_to_the_image(spark):
    g = noise(10, 12)
    rows = [(0, 1, 2, 3, 4, 5, 1), (0, 2, 8, 8, 50, 50, 0), (0, 3, 40, 1, 5, 5, 0), (0, 4, 1, 1, 0, 3, 0)]
    boxes = spark.createDataFrame(rows, "image_id bigint, box_id bigint, x int, y int, w int, h int, eyes int")
    bitmaps = frame(spark, [g])
    got = {(p.box_id, p.y, p.x): p.gray for p in raster.roi_pixels(boxes, bitmaps).collect()}
    v = gray(g)
    want = {(1, y, x): v[y, x] for y in range(3, 8) for x in range(2, 6)}
    want |= {(2, y, x): v[y, x] for y in range(8, 10) for x in range(8, 12)}
    assert got == want
    flags = {x.box_id: x.quality for x in bx.face_quality(raster.roi_tiles(boxes, bitmaps)).collect()}
    assert set(flags) == {1, 2} and all(0 <= q <= 1 for q in flags.values())


def test_stencils_of_crops_over_many_tiles(spark):
    g = noise(30, 26)
    rng = np.random.default_rng(3)
    spots = [(0, 0, 26, 30), (3, 4, 1, 9), (5, 7, 8, 1), (24, 28, 9, 9), (-2, -3, 9, 9), *[tuple(rng.integers(0, 20, 2)) + tuple(rng.integers(1, 20, 2)) for _ in range(8)]]
    boxes = spark.createDataFrame([(0, i, *map(int, s), 1) for i, s in enumerate(spots)],
                                  "image_id bigint, box_id bigint, x int, y int, w int, h int, eyes int")
    crops = raster.roi_tiles(boxes, frame(spark, [g]), side=7).cache()
    assert crops.count() > 50
    known = {}
    for p in raster.neighbourhoods(crops, ("box_id",)).select("box_id", "y", "x", raster.laplacian_of().alias("lap")).collect():
        x, y, w, h = spots[p.box_id]
        part = gray(g)[max(y, 0):y + h, max(x, 0):x + w]
        laps = known.setdefault(p.box_id, stencils(part)[0])
        assert p.lap == laps[p.y, p.x]
    assert {b.box_id: b.n for b in raster.positioned(crops, "box_id").groupBy("box_id").agg(F.count("*").alias("n")).collect()} == {
        i: gray(g)[max(y, 0):y + h, max(x, 0):x + w].size for i, (x, y, w, h) in enumerate(spots)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("feature", [features.mean_color, features.color_variance, features.contrast_brightness, features.skin_ratio_score,
                                     features.color_ratio, features.thirds_composition, texture.blur_score, texture.tone_and_edges,
                                     texture.color_and_blur, texture.quality_score, hashing.phash])
def test_scalar_features_move_only_partial_sums(spark, feature):
    plan = plan_of(feature(images.image_tiles(frame(spark, [noise(3, 3)]), halo=True)))
    lines = plan.split("\n")
    moved = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert moved and all("partial_" in lines[i + 1] for i in moved[-1:])
    assert len(moved) == (2 if feature is features.thirds_composition else 1)


def test_only_survivors_are_decoded(spark):
    bitmaps = frame(spark, [noise(3, 3), noise(4, 4)])
    facts = spark.createDataFrame([(0, 3, 3, 5, "png"), (1, 4, 4, 5, "png")], "image_id bigint, width int, height int, length bigint, format string")
    flags = spark.createDataFrame([], "image_id bigint, is_nsfw boolean")
    plans = [plan_of(md.advanced_filter(facts, bitmaps, md.FilterParams(palette=((1, 2, 3),)))), plan_of(md.valid_image(facts, bitmaps, flags))]
    for plan in plans:
        assert "MapInArrow" in plan
        for part in plan.split("MapInArrow")[1:]:
            assert "LeftSemi" in part.split("Exchange hashpartitioning(image_id")[0] or "LeftSemi" in part


def test_empty_input(spark):
    none = images.image_tiles(frame(spark, [noise(2, 2)]).where("image_id < 0"), halo=True)
    assert features.gray_entropy_bits(none).count() == 0
    assert texture.tone_and_edges(none).count() == 0
    assert hashing.phash(none).count() == 0


COUNTED = [features.gray_entropy_nats, features.gray_entropy_bits, features.joint_color_entropy, features.dominant_color_mode,
           features.palette_kmeans, features.color_profile, texture.glcm, lambda t: texture.glcm_features(texture.glcm(t, angles=("0",))),
           lambda t: raster.thumbnail_raster(t, 4, 4)]


@pytest.mark.parametrize("feature", COUNTED)
def test_counts_move_by_raster_only(spark, feature):
    """No exchange by colour, level or pair: a row moved holds a tile's counts."""
    plan = feature(tiles(spark, noise(9, 9)))._jdf.queryExecution().executedPlan().toString()
    keys = [part.split(", ") for part in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert keys and all(len(k) == 2 for k in keys)  # image_id and the number of partitions


def test_cooccurrence_moves_gray_levels(spark, monkeypatch):
    """What is exchanged for glcm is a byte a pixel and no pair counts; slices and batches of any size give the same cells."""
    g = [noise(150, 131), noise(7, 9, seed=3), noise(1, 1), noise(1, 6, seed=4)]
    plan = texture.glcm(images.image_tiles(frame(spark, g), halo=True))._jdf.queryExecution().sparkPlan()
    nodes, moved = [plan], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "RepartitionByExpression" in node.nodeName() or "Exchange" in node.nodeName():
            moved += [f.dataType().simpleString() for f in (node.schema().apply(i) for i in range(node.schema().size()))]
    assert "binary" in moved and not any("array" in kind or "struct" in kind for kind in moved)

    def cells():
        found = texture.glcm(images.image_tiles(frame(spark, g), halo=True)).collect()
        assert len(found) == len({tuple(c)[:4] for c in found})
        return {tuple(c)[:4]: c.p for c in found}

    whole = cells()
    monkeypatch.setattr(tallies, "MET_ROWS", 1)
    monkeypatch.setattr(tallies, "OUT_CELLS", 50)
    assert cells() == whole
    v = gray(g[1])
    pairs = Counter(zip(v[:, :-1].reshape(-1).tolist(), v[:, 1:].reshape(-1).tolist()))
    want = {(i, j): (pairs[i, j] + pairs[j, i]) / (2 * 7 * 8) for x in pairs for i, j in (x, x[::-1])}
    got = {(i, j): p for (key, angle, i, j), p in whole.items() if (key, angle) == (1, "0")}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert {(key, angle) for key, angle, _, _ in whole if key > 1} == {(3, "0")}


@pytest.mark.parametrize("rows", [1, 400])
def test_counts_of_one_id_add_up_across_batches(spark, rows):
    """Two rows of one id are one raster, whatever batches its tiles come in; a null id is an id."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        a, b = noise(6, 5), noise(6, 5, seed=2) // 4
        both = frame(spark, [np.concatenate([a, b]), b]).withColumn("image_id", F.when(F.col("image_id") == 0, 7))
        apart = frame(spark, [a, b, b]).withColumn("image_id", F.when(F.col("image_id") < 2, 7))
        for feature in (features.gray_entropy_nats, features.gray_entropy_bits, features.joint_color_entropy, features.dominant_color_mode,
                        features.palette_kmeans):
            want, got = (sorted(feature(images.image_tiles(x, side=s)).collect(), key=str) for x, s in ((both, 64), (apart, 2)))
            assert [r[0] for r in want] == [r[0] for r in got] and {r[0] for r in got} == {7, None}
            for x, y in zip(want, got):
                assert list(x)[1:] == pytest.approx(list(y)[1:])
    finally:
        spark.conf.set(name, old)


def test_quality_takes_no_row_per_pixel(spark):
    grids = [noise(70, 130), noise(3, 5, 2), noise(1, 1, 3), np.full((6, 4, 3), 90)]
    t = tiles(spark, *grids)
    scored = texture.quality_score(t)
    assert "Generate" not in plan_of(scored)
    slow = texture.tone_and_edges(t).select("image_id", *texture.quality_parts())
    names = ["image_id", "sharpness_score", "brightness_score", "noise_score"]
    assert sorted(scored.select(*names).collect()) == sorted(slow.select(*names).collect())
    assert texture.quality_score(t.where("image_id < 0")).collect() == []


def test_palettes_are_one_row_per_image(spark):
    grids = [noise(9, 7), np.full((4, 4, 3), 90), noise(130, 120, 3)]
    found = md.palette_of(frame(spark, grids))
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(found))) == 1
    rows = features.palette_kmeans(images.image_tiles(frame(spark, grids), size=images.squeezed)).collect()
    want = {i: sorted(tuple(r)[1:] for r in rows if r.image_id == i) for i in range(3)}
    assert {r.image_id: [tuple(c) for c in r.dominant_colors] for r in found.collect()} == want
    assert [len(want[i]) for i in range(3)] == [3, 1, 3]


def test_palettes_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    rasters = [np.unique(rng.integers(0, 4096, m)) for m in (1, 2, 3, 40, 300)]
    counts = [rng.integers(1, 9, len(q)) for q in rasters]
    bounds = np.cumsum([0, *map(len, rasters)])
    row, found = features._palettes(bounds, np.concatenate(rasters), np.concatenate(counts), 3, 10)
    got = [tuple(int(x) for x in r) for r in zip(row, *found)]
    want = []
    for i, (q, n) in enumerate(zip(rasters, counts)):
        points = [[(int(v) >> s & 15) * 16 + 8 for s in (8, 4, 0)] for v in q]
        seeds = sorted(range(len(q)), key=lambda j: (-n[j], q[j]))[:3]
        centers = [[c * features.UNIT for c in points[j]] for j in seeds]
        for _ in range(10):
            cells = [min(range(len(centers)), key=lambda c: sum((x * features.UNIT - y) ** 2 for x, y in zip(p, centers[c]))) for p in points]
            for c in range(len(centers)):
                own = [j for j in range(len(q)) if cells[j] == c]
                if own:
                    weight = sum(int(n[j]) for j in own)
                    centers[c] = [sum(int(n[j]) * points[j][d] for j in own) * features.UNIT // weight for d in range(3)]
        want += [(i, c, *(x // features.UNIT for x in center)) for c, center in enumerate(centers)]
    assert got == want
    cell, values = np.array([0, 2, 0]), np.array([1 << 53, 5, 1])
    assert features._exact_sums(cell, values, 3).tolist() == [(1 << 53) + 1, 0, 5]


def test_small_images_are_packed_together(monkeypatch):
    monkeypatch.setattr(images, "PACK_CELLS", 20)
    calls = []
    packed = images._packed
    monkeypatch.setattr(images, "_packed", lambda rgb: calls.append(rgb.shape) or packed(rgb))
    grids = [noise(*shape, seed).astype(np.uint8) for seed, shape in enumerate([(3, 4), (2, 5), (7, 9), (1, 1), (4, 4)])]
    found = dict(images._packed_together(enumerate(grids)))
    assert calls == [(22, 3), (17, 3)]  # the large one is packed by bands later
    assert sorted(found) == [0, 1, 2, 3, 4] and (found[2] == grids[2]).all()
    assert all((found[i] == packed(grids[i])).all() for i in (0, 1, 3, 4))
    for side, halo in ((64, True), (2, True), (2, False)):
        whole = list(images._cut(found[0], side, halo))
        bands = list(images._cut(grids[0], side, halo))
        assert len(whole) == len(bands) and all(a[:2] == b[:2] and (a[2] == b[2]).all() and (not halo or (a[3] == b[3]).all())
                                                for a, b in zip(whole, bands))
