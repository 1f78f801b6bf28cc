"""Colour and tone features per image.

Every feature begins with a grouping whose partial sums are taken tile by tile, where the tiles are made; what moves
are sums or counts, never pixels. ``keys`` names the raster's identity, so the same code serves whole images and crops.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from photolake.functions.columns import blue, green, hsv, int_div, packed_luma, packed_sum, ratio, red, var_pop_of
from photolake.operators.raster import KEYS, explode_pixels, positioned
from photolake.operators.tallies import added, entropy, lists, per_raster, pixels, range_bins, rasters


def channel_values(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, channel, v): three rows per pixel."""
    v = F.col("v")
    rows = F.array(*[F.struct(F.lit(name).alias("channel"), value.alias("bin"))
                     for name, value in (("r", red(v)), ("g", green(v)), ("b", blue(v)))])
    return tiles.select(*keys, F.explode("px").alias("v")).select(*keys, F.inline(rows))


def color_histogram(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of each channel value that occurs."""
    return channel_values(tiles, keys).groupBy(*keys, "channel", "bin").agg(F.count("*").alias("cnt"))


def gray_entropy_nats(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entropy (nats) of the channel mean, 256 bins over the image's own range."""
    def feature(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
        run, _, count = added(rasters(bounds), range_bins(v, bounds, 256), n)
        return None, [entropy(run, count, len(bounds) - 1, np.log)]

    total = pixels(lambda px: (px >> 16 & 255) + (px >> 8 & 255) + (px & 255))
    return per_raster(tiles, keys, ["px"], total, feature, "entropy double")


def gray_entropy_bits(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entropy (bits) of the luma histogram."""
    def feature(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
        return None, [entropy(rasters(bounds), n, len(bounds) - 1, np.log2)]

    return per_raster(tiles, keys, ["px"], pixels(lambda px: px >> 24), feature, "entropy double")


def _exact_colors(px: np.ndarray) -> np.ndarray:
    """0xRRGGBB; its order is (r, g, b) order."""
    return px & 0xFFFFFF


def _channels(v: np.ndarray) -> list[np.ndarray]:
    return [v >> 16 & 255, v >> 8 & 255, v & 255]


def _joint_entropy(bounds: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    r, g, b = (range_bins(c, bounds, 16) for c in _channels(v))
    run, _, count = added(rasters(bounds), (r << 8) | (g << 4) | b, n)
    return entropy(run, count, len(bounds) - 1, np.log2, 1e-10)


def commonest(bounds: np.ndarray, v: np.ndarray, n: np.ndarray, bits: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Most frequent value below 2 ** bits of each raster, and its count; ties go to the smallest value."""
    top = (1 << bits) - 1
    best = np.maximum.reduceat((n << bits) | (top - v), bounds[:-1])
    return top - (best & top), best >> bits


def joint_color_entropy(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entropy (bits) of the joint 16x16x16 colour histogram over each channel's own range."""
    return per_raster(tiles, keys, ["px"], pixels(_exact_colors), lambda *counts: (None, [_joint_entropy(*counts)]), "entropy double")


def color_uniformity(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the count entropies of hue and saturation (counts are not normalised)."""
    v = F.col("v")
    hue, sat, _ = hsv(red(v), green(v), blue(v))
    rows = F.array(F.struct(F.lit("h").alias("channel"), hue.alias("bin")),
                   F.struct(F.lit("s").alias("channel"), sat.alias("bin")))
    counts = (tiles.select(*keys, F.explode("px").alias("v")).select(*keys, F.inline(rows))
              .groupBy(*keys, "channel", "bin").agg(F.count("*").alias("cnt")))
    return counts.groupBy(*keys).agg(
        (-F.sum(F.col("cnt") * F.log2(F.col("cnt") + F.lit(1e-7))) / 2).alias("uniformity"))


def dominant_color_mode(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent exact colour; ties go to the smallest colour in (r, g, b) order."""
    def feature(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
        color, count = commonest(bounds, v, n)
        return None, [*[c.astype(np.int32) for c in _channels(color)], count]

    return per_raster(tiles, keys, ["px"], pixels(_exact_colors), feature, "r int, g int, b int, cnt bigint")


def _channel_sums() -> list[Column]:
    v = F.col("v")
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{k}") for k, c in
                                       (("r", red(v)), ("g", green(v)), ("b", blue(v)))]]


def mean_color(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean colour, truncated to integers."""
    sums = tiles.select(*keys, F.explode("px").alias("v")).groupBy(*keys).agg(*_channel_sums())
    return sums.select(*keys, *[int_div(F.col(f"s_{c}"), F.col("n")).cast("int").alias(c) for c in "rgb"])


def color_variance(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population variance over all channel values."""
    return variance_of(tiles.select(*keys, F.explode("px").alias("v")).select(*keys, "v", F.lit(1).cast("long").alias("n")), keys)


def variance_of(colors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    v, n = F.col("v"), F.col("n")
    squares = red(v) * red(v) + green(v) * green(v) + blue(v) * blue(v)
    sums = colors.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * packed_sum(v)).alias("s1"), F.sum(n * squares).alias("s2"))
    return sums.select(*keys, var_pop_of(3 * F.col("n"), F.col("s1"), F.col("s2")).alias("variance"))


def contrast_brightness(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Standard deviation and mean of gray."""
    g = F.col("g")
    sums = (tiles.select(*keys, F.explode("px").alias("v")).select(*keys, packed_luma(F.col("v")).alias("g"))
            .groupBy(*keys).agg(F.count("*").alias("n"), F.sum(g).alias("s1"), F.sum(g * g).alias("s2")))
    return sums.select(*keys, F.sqrt(var_pop_of(F.col("n"), F.col("s1"), F.col("s2"))).alias("contrast"),
                       ratio(F.col("s1"), F.col("n")).alias("brightness"))


def skin_ratio_score(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Twice the share of skin-coloured pixels, at most 1."""
    v = F.col("v")
    hue, sat, val = hsv(red(v), green(v), blue(v))
    skin = (hue <= 20) & (sat >= 48) & (val >= 80)
    return (tiles.select(*keys, F.explode("px").alias("v")).select(*keys, skin.alias("skin")).groupBy(*keys)
            .agg(F.least(F.lit(1.0), 2 * ratio(F.count_if("skin"), F.count("*"))).alias("score")))


def color_ratio(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean distance of the channels from gray, over 255."""
    p = explode_pixels(tiles, keys)
    gap = sum((F.abs(F.col(c) - F.col("gray")) for c in "rgb"), F.lit(0))
    return p.groupBy(*keys).agg((ratio(F.sum(gap), F.count("*")) / 255.0).alias("color_ratio"))


def thirds_composition(tiles: DataFrame) -> DataFrame:
    """Mean colour of the 3x3 sections (the last takes the remainder) and the brightest of them."""
    def third(pos: Column, size: Column) -> Column:
        return F.when(size >= 3, F.least(int_div(pos, int_div(size, 3)), F.lit(2))).otherwise(2)

    width, height = F.col("width"), F.col("height")
    section = (third(F.col("y"), height) * 3 + third(F.col("x"), width)).cast("int")
    sums = (positioned(tiles, "image_id", "width", "height").groupBy("image_id", section.alias("section"))
            .agg(*_channel_sums(), F.any_value("width").alias("width"), F.any_value("height").alias("height")))
    total = F.col("s_r") + F.col("s_g") + F.col("s_b")
    means = sums.select("image_id", "section", *[ratio(F.col(f"s_{c}"), F.col("n")).alias(f"mean_{c}") for c in "rgb"],
                        ratio(total, 3 * F.col("n")).alias("mean"),
                        ratio(F.col("width"), F.col("height")).alias("aspect_ratio"))
    best = F.max(F.struct("mean", (-F.col("section")).alias("neg"))).over(W.partitionBy("image_id"))
    return means.withColumn("dominant_section", -best["neg"]).drop("mean")


# --- palettes -------------------------------------------------------------------------------

def _quantised(v: Column) -> Column:
    """12-bit colour: the high four bits of each channel."""
    return int_div(red(v), 16) * 256 + int_div(green(v), 16) * 16 + int_div(blue(v), 16)


def palette_topk(tiles: DataFrame, k: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k most frequent 12-bit colours of each image, with counts."""
    counts = (tiles.select(*keys, F.explode("px").alias("v"))
              .groupBy(*keys, _quantised(F.col("v")).alias("color")).agg(F.count("*").alias("cnt")))
    order = W.partitionBy(*keys).orderBy(F.desc("cnt"), "color")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


UNIT = 1_000_000


def quantised_colors(px: np.ndarray) -> np.ndarray:
    """``_quantised`` of packed pixels in an array."""
    return (px >> 12 & 0xF00) | (px >> 8 & 0xF0) | (px >> 4 & 0xF)


def _exact_sums(cell: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Sum of whole numbers from 0 up by cell; floating sums only where all of them are exact."""
    if values.sum() < 1 << 53:
        return np.bincount(cell, weights=values, minlength=cells).astype(np.int64)
    sums = np.zeros(cells, dtype=np.int64)
    np.add.at(sums, cell, values)
    return sums


def _palettes(bounds: np.ndarray, q: np.ndarray, n: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, list]:
    """Weighted k-means of each raster's 12-bit colours, in millionths of a colour step, seeded with the k most frequent colours. Only
    bounded lists (at most 4096 colours) enter, some hundred rasters at a time. Integer arithmetic throughout."""
    run, size = rasters(bounds), np.diff(bounds)
    order = np.lexsort((q, -n, run))
    q, n, place = q[order], n[order], np.arange(len(q)) - bounds[run]
    colors = np.stack([(q >> 8) * 16 + 8, (q >> 4 & 15) * 16 + 8, (q & 15) * 16 + 8])
    used = np.arange(k) < size[:, None]
    centers = np.zeros((3, k, len(size)), dtype=np.int64)
    centers[:, place[place < k], run[place < k]] = colors[:, place < k] * UNIT
    for _ in range(rounds):
        best = np.full(len(run), np.iinfo(np.int64).max)
        cell = np.zeros(len(run), dtype=np.int64)
        for c in range(k):
            gap = sum((color * UNIT - center[c][run]) ** 2 for color, center in zip(colors, centers))
            closer = (gap < best) & used[run, c]
            best, cell = np.where(closer, gap, best), np.where(closer, c, cell)
        cell = cell * len(size) + run
        weight, *sums = (_exact_sums(cell, x, k * len(size)).reshape(k, -1) for x in (n, *(colors * n)))
        moved = np.where(weight > 0, np.stack(sums) * UNIT // np.maximum(weight, 1), centers)
        going = (moved != centers).any(axis=(0, 1))[run]
        if not going.any():
            break  # further rounds change nothing
        centers = moved
        colors, n, run = colors[:, going], n[going], run[going]  # nor do they for the other rasters
    row, cluster = np.nonzero(used)
    return row, [x.astype(np.int32) for x in (cluster, *(centers[:, cluster, row] // UNIT))]


def palette_kmeans(tiles: DataFrame, k: int = 3, rounds: int = 10) -> DataFrame:
    """k palette colours per image: weighted k-means over its quantised colours. ``tiles``: images resampled to ``squeezed`` size."""
    return per_raster(tiles, KEYS, ["px"], pixels(quantised_colors), lambda *counts: _palettes(*counts, k, rounds),
                      "cluster int, r int, g int, b int")


def palette_arrays(tiles: DataFrame, k: int = 3, rounds: int = 10) -> DataFrame:
    """``palette_kmeans`` with one row per image: its colours in an array, by cluster."""
    def feature(bounds: np.ndarray, q: np.ndarray, n: np.ndarray):
        row, found = _palettes(bounds, q, n, k, rounds)
        ends = np.searchsorted(row, np.arange(len(bounds)))
        return None, [lists(x, ends) for x in found]

    names = ("cluster", "r", "g", "b")
    arrays = per_raster(tiles, KEYS, ["px"], pixels(quantised_colors), feature, ", ".join(f"{name} array<int>" for name in names))
    return arrays.select(*KEYS, F.arrays_zip(*names).alias("dominant_colors"))


def color_profile(tiles: DataFrame) -> DataFrame:
    """One record per image: joint entropy, dominant colour, variance and three 256-bin histograms, all from one count of colours."""
    def feature(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
        runs, run, channels = len(bounds) - 1, rasters(bounds), _channels(v)
        hist = []
        for c in channels:
            counts = np.zeros(runs * 256, dtype=np.int64)
            np.add.at(counts, run * 256 + c, n)
            hist.append(lists(counts, np.arange(runs + 1) * 256))
        sums = [np.add.reduceat(n * x, bounds[:-1]) for x in (1, sum(channels), sum(c * c for c in channels))]
        return None, [_joint_entropy(bounds, v, n), *[c.astype(np.int32) for c in _channels(commonest(bounds, v, n)[0])], *sums, *hist]

    full = per_raster(tiles, KEYS, ["px"], pixels(_exact_colors), feature, "color_entropy double, r int, g int, b int, n bigint, s1 bigint, "
                      "s2 bigint, hist_r array<bigint>, hist_g array<bigint>, hist_b array<bigint>").where("image_id IS NOT NULL")
    return full.select("image_id", "color_entropy", "r", "g", "b", var_pop_of(3 * F.col("n"), F.col("s1"), F.col("s2")).alias("variance"),
                       "hist_r", "hist_g", "hist_b")
