"""Texture, edges and sharpness, from array-indexed stencils on haloed tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions.columns import blue, green, ratio, red, var_pop_of
from photolake.operators.raster import KEYS, angle_of, gradients_of, laplacian_of, magnitude_of, neighbourhoods
from photolake.operators.tallies import per_raster_moved, rasters


def blur_score(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Variance of the Laplacian; low means blurry."""
    lap = F.col("lap")
    sums = (neighbourhoods(tiles, keys).select(*keys, laplacian_of().alias("lap")).groupBy(*keys)
            .agg(F.count("*").alias("n"), F.sum(lap).alias("s1"), F.sum(lap * lap).alias("s2")))
    return sums.select(*keys, var_pop_of(F.col("n"), F.col("s1"), F.col("s2")).alias("blur_score"))


def color_and_blur(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """color_ratio and blur_score in one pass and one grouping."""
    px, lap = F.col("packed"), F.col("lap")
    gap = sum((F.abs(c(px) - F.col("v")) for c in (red, green, blue)), F.lit(0))
    sums = (neighbourhoods(tiles, keys).select(*keys, gap.alias("gap"), laplacian_of().alias("lap")).groupBy(*keys)
            .agg(F.count("*").alias("n"), F.sum("gap").alias("gap"), F.sum(lap).alias("s1"), F.sum(lap * lap).alias("s2")))
    return sums.select(*keys, (ratio(F.col("gap"), F.col("n")) / 255.0).alias("color_ratio"),
                       var_pop_of(F.col("n"), F.col("s1"), F.col("s2")).alias("blur_score"))


def tone_and_edges(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every scalar stencil feature in one pass and one grouping."""
    gx, gy = gradients_of()
    px = (neighbourhoods(tiles, keys).select(*keys, "v", laplacian_of().alias("lap"), gx.alias("gx"), gy.alias("gy"))
          .withColumn("mag", magnitude_of(F.col("gx"), F.col("gy"))).withColumn("angle", angle_of(F.col("gx"), F.col("gy"))))
    v, lap = F.col("v"), F.col("lap")
    sums = px.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(lap).alias("l1"),
        F.sum(lap * lap).alias("l2"), F.avg("mag").alias("edge_density"), F.avg("angle").alias("mean_angle"),
        (F.max(v) - F.min(v)).alias("dynamic_range"))
    return sums.select(*keys, ratio(F.col("s1"), F.col("n")).alias("brightness"),
                       F.sqrt(var_pop_of(F.col("n"), F.col("s1"), F.col("s2"))).alias("contrast"),
                       var_pop_of(F.col("n"), F.col("l1"), F.col("l2")).alias("sharpness"),
                       "edge_density", "mean_angle", "dynamic_range")


def tone_and_sharpness(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The brightness, contrast and sharpness of ``tone_and_edges`` from whole-number sums, taken tile by tile: no row per pixel."""
    names = ("n", "s1", "s2", "l1", "l2")

    @F.arrow_udf(f"struct<{', '.join(f'{name}: bigint' for name in names)}>")
    def sums(w: pa.Array, h: pa.Array, pad: pa.Array) -> pa.Array:
        offsets, gray = pad.offsets.to_numpy(), (pad.values.to_numpy().view(np.uint32) >> 24).astype(np.int64)
        rows = np.zeros((len(pad), len(names)), dtype=np.int64)
        for i, (width, height) in enumerate(zip(w.to_pylist(), h.to_pylist())):
            grid = gray[offsets[i]:offsets[i + 1]].reshape(height + 2, width + 2)
            v = grid[1:-1, 1:-1]
            lap = grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:] - 4 * v
            rows[i] = v.size, v.sum(), (v * v).sum(), lap.sum(), (lap * lap).sum()
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], names=list(names))

    n, s1, s2, l1, l2 = map(F.col, names)
    total = (tiles.select(*keys, sums("w", "h", "pad").alias("sums")).select(*keys, "sums.*").groupBy(*keys)
             .agg(*[F.sum(name).alias(name) for name in names]))
    return total.select(*keys, ratio(s1, n).alias("brightness"), F.sqrt(var_pop_of(n, s1, s2)).alias("contrast"),
                        var_pop_of(n, l1, l2).alias("sharpness"))


def quality_basic(tiles: DataFrame) -> DataFrame:
    return tone_and_edges(tiles).select("image_id", "sharpness", "edge_density", "dynamic_range")


def quality_parts() -> list[Column]:
    return [F.least(F.col("sharpness") / 1000.0, F.lit(1.0)).alias("sharpness_score"),
            (1.0 - F.abs(F.col("brightness") / 255.0 - 0.5) * 2).alias("brightness_score"),
            (1.0 - F.col("contrast") / 255.0).alias("noise_score")]


def quality_score(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of sharpness, brightness and noise scores, with the parts. ``tiles``: images resampled to ``lowered`` size."""
    parts = tone_and_sharpness(tiles, keys).select(*keys, *quality_parts())
    return parts.withColumn("quality", (F.col("sharpness_score") + F.col("brightness_score") + F.col("noise_score")) / 3)


# The four co-occurrence directions at distance 1: name, row step, column step.
DIRECTIONS = (("0", 0, 1), ("45", 1, 1), ("90", 1, 0), ("135", 1, -1))


def glcm(tiles: DataFrame, keys: Sequence[str] = KEYS, angles: Sequence[str] = ("0", "45", "90", "135")) -> DataFrame:
    """Symmetric, normalised gray co-occurrence for each of ``angles``; only cells that occur.

    A tile has more pairs than pixels, so its gray levels move, a byte each, and pairs are counted, both ways round, where a raster's
    tiles meet.
    """
    wanted = [(i, dy, dx) for i, (name, dy, dx) in enumerate(DIRECTIONS) if name in angles]

    @F.arrow_udf("binary")
    def gray(pad: pa.Array) -> pa.Array:
        offsets, px = pad.offsets.to_numpy(), pad.values.to_numpy().view(np.uint32)
        return pa.Array.from_buffers(pa.binary(), len(pad), [None, pa.py_buffer(offsets), pa.py_buffer((px >> 24).astype(np.uint8))])

    def pairs(columns: list[pa.Array]):
        codes, sizes = [np.zeros(0, np.int32)], []
        for data, width, height, y0, x0, w, h in zip(columns[-1], *(c.to_pylist() for c in columns[:-1])):
            pad = np.frombuffer(data.as_buffer(), np.uint8).reshape(h + 2, w + 2)
            sizes.append(0)
            for angle, dy, dx in wanted:
                # Rows and columns of the tile whose partner lies inside the raster.
                y1, first, x1 = min(h, height - dy - y0), max(0, -dx - x0), min(w, width - dx - x0)
                if y1 > 0 and x1 > first:
                    v, u = pad[1:1 + y1, 1 + first:1 + x1], pad[1 + dy:1 + dy + y1, 1 + dx + first:1 + dx + x1]
                    v, u = v.astype(np.int32), u.astype(np.int32)
                    codes += [(v << 8 | u | angle << 16).reshape(-1), (u << 8 | v | angle << 16).reshape(-1)]
                    sizes[-1] += 2 * v.size
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(codes), None

    def cells(bounds: np.ndarray, code: np.ndarray, n: np.ndarray):
        """A row for each raster and angle; a cell is its count, level and partner's level, in one number."""
        run, angle = rasters(bounds), code >> 16
        first = np.flatnonzero(np.diff(run << 2 | angle, prepend=-1))
        return run[first], [angle[first].astype(np.int32)], np.append(first, len(code)), n << 16 | code & 0xFFFF

    held = tiles.withColumns({"rw": F.col("width"), "rh": F.col("height"), "gray": gray("pad")})
    counts = per_raster_moved(held, keys, ["width", "height", "y0", "x0", "w", "h", "gray"], pairs, cells,
                              "direction int, cells array<bigint>", carry=["rw", "rh"])
    w, h, direction, cell = F.col("rw").cast("long"), F.col("rh").cast("long"), F.col("direction"), F.col("cell")
    n_pairs = F.when(direction == 0, (w - 1) * h).when(direction == 2, w * (h - 1)).otherwise((w - 1) * (h - 1))
    return (counts.select(*keys, F.get(F.array(*[F.lit(name) for name, _, _ in DIRECTIONS]), direction).alias("angle"),
                          (2 * n_pairs).alias("total"), F.explode("cells").alias("cell"))
            .select(*keys, "angle", F.shiftright(cell, 8).bitwiseAND(255).cast("int").alias("i"), cell.bitwiseAND(255).cast("int").alias("j"),
                    ratio(F.shiftright(cell, 16), F.col("total")).alias("p")))


def glcm_features(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy and correlation of the horizontal matrix."""
    p, i, j = F.col("p"), F.col("i").cast("double"), F.col("j").cast("double")
    d = i - j
    sums = matrix.where("angle = '0'").groupBy(*keys).agg(
        F.sum(p * d * d).alias("contrast"), F.sum(p * F.abs(d)).alias("dissimilarity"),
        F.sum(p / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(p * p)).alias("energy"),
        F.sum(p * i).alias("m"), F.sum(p * i * i).alias("m2"), F.sum(p * i * j).alias("mij"))
    m, var = F.col("m"), F.col("m2") - F.col("m") * F.col("m")
    return sums.select(*keys, "contrast", "dissimilarity", "homogeneity", "energy",
                       F.when(var > 1e-9, (F.col("mij") - m * m) / var).otherwise(F.lit(1.0)).alias("correlation"))


def half_turn_bin(gx: Column, gy: Column) -> Column:
    """One of eight equal bins over [0, pi] for gy >= 0, last bin closed.

    Decided by slopes in place of angles: gradients are integers and tan(pi/8) is irrational, so no
    rounding can move a pixel across a bin edge.
    """
    t = math.sqrt(2) - 1
    a = -gx
    return (F.when(gy == 0, F.when(gx >= 0, 0).otherwise(7))
            .when(gx > 0, F.when(gy < t * gx, 0).when(gy < gx, 1).when(t * gy < gx, 2).otherwise(3))
            .when(a < t * gy, 4).when(a < gy, 5).when(t * a < gy, 6).otherwise(7)).cast("int")


def edge_orientation_hist(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels per gradient direction bin over the upper half turn; the lower half is left out."""
    gx, gy = gradients_of()
    return (neighbourhoods(tiles, keys).select(*keys, gx.alias("gx"), gy.alias("gy")).where("gy >= 0")
            .select(*keys, half_turn_bin(F.col("gx"), F.col("gy")).alias("bin"))
            .groupBy(*keys, "bin").agg(F.count("*").alias("cnt")))
