"""Tiles to pixels, crops, thumbnails and augmentation.

A tile row is ``(keys..., width, height, y0, x0, w, h, px[, pad])``: a part of a raster of width x height whose first pixel is at
(y0, x0). ``pad`` is the tile with a border of one pixel, so stencils read their neighbours by array position: everything here is a map over
tiles and needs neither a shuffle nor a sort, whatever the size of an image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions.columns import blue, green, int_div, packed_luma, red
from photolake.operators.tallies import lists, per_raster
from photolake.sources.images import TILE, image_tiles

KEYS = ("image_id",)


def positioned(tiles: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel: ``keep``, packed value v, and place y, x in the raster."""
    p, w = F.col("p"), F.col("w")
    return (tiles.select(*keep, "y0", "x0", "w", F.posexplode("px").alias("p", "v"))
            .select(*keep, "v", (F.col("y0") + int_div(p, w)).cast("int").alias("y"), (F.col("x0") + p % w).cast("int").alias("x")))


def explode_pixels(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per pixel: position, channels and gray value."""
    px = F.col("v")
    return positioned(tiles, *keys).select(*keys, "y", "x", red(px).alias("r"), green(px).alias("g"), blue(px).alias("b"),
                                           packed_luma(px).alias("gray"))


def neighbourhoods(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each pixel (packed, and its gray value v) with its eight gray neighbours (n_ul .. n_dr), read from the bordered tile by position."""
    p, w = F.col("p"), F.col("w")
    flat = (tiles.select(*keys, "y0", "x0", "w", "pad", F.posexplode("px").alias("p", "v"))
            .withColumn("row", int_div(p, w).cast("int")).withColumn("col", (p % w).cast("int"))
            .withColumn("o", F.col("row") * (w + 2) + F.col("col")))

    def at(dy: int, dx: int):
        return packed_luma(F.get("pad", F.col("o") + dy * (w + 2) + dx))

    return flat.select(*keys, F.col("v").alias("packed"), (F.col("y0") + F.col("row")).alias("y"), (F.col("x0") + F.col("col")).alias("x"),
                       packed_luma(F.col("v")).alias("v"),
                       at(0, 0).alias("n_ul"), at(0, 1).alias("n_u"), at(0, 2).alias("n_ur"),
                       at(1, 0).alias("n_l"), at(1, 2).alias("n_r"),
                       at(2, 0).alias("n_dl"), at(2, 1).alias("n_d"), at(2, 2).alias("n_dr"))


def laplacian(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Four-neighbour Laplacian per pixel."""
    return neighbourhoods(tiles, keys).select(*keys, "y", "x", "v", laplacian_of().alias("lap"))


def laplacian_of():
    return F.col("n_u") + F.col("n_d") + F.col("n_l") + F.col("n_r") - 4 * F.col("v")


def gradients_of():
    gx = (F.col("n_ur") + 2 * F.col("n_r") + F.col("n_dr")) - (F.col("n_ul") + 2 * F.col("n_l") + F.col("n_dl"))
    gy = (F.col("n_dl") + 2 * F.col("n_d") + F.col("n_dr")) - (F.col("n_ul") + 2 * F.col("n_u") + F.col("n_ur"))
    return gx, gy


def magnitude_of(gx, gy):
    return F.sqrt((gx * gx + gy * gy).cast("double"))


def angle_of(gx, gy):
    """Direction in [0, 2 pi)."""
    a = F.atan2(gy.cast("double"), gx.cast("double"))
    return F.when(a < 0, a + 2 * F.pi()).otherwise(a)


def sobel(tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """3x3 Sobel gradients, magnitude and direction per pixel."""
    gx, gy = gradients_of()
    return (neighbourhoods(tiles, keys).select(*keys, "y", "x", gx.alias("gx"), gy.alias("gy"))
            .withColumn("magnitude", magnitude_of(F.col("gx"), F.col("gy")))
            .withColumn("angle", angle_of(F.col("gx"), F.col("gy"))))


def clipped_boxes(boxes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Boxes cut to their image: the box's columns with left, top, width and height of what is inside; none outside."""
    sizes = bitmaps.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"))
    rest = [c for c in boxes.columns if c not in ("image_id", "box_id", "x", "y", "w", "h")]
    left, top = F.greatest(F.col("x"), F.lit(0)), F.greatest(F.col("y"), F.lit(0))
    return (boxes.join(sizes, "image_id")
            .select("image_id", "box_id", *rest, left.alias("left"), top.alias("top"),
                    (F.least(F.col("x") + F.col("w"), F.col("iw")) - left).alias("width"),
                    (F.least(F.col("y") + F.col("h"), F.col("ih")) - top).alias("height"))
            .where((F.col("width") > 0) & (F.col("height") > 0)))


def _cells(first: Column, size: Column, side: int) -> Column:
    # The optimizer may evaluate this next to the filter above, so an empty box must not fail here.
    return F.sequence(int_div(first, F.lit(side)), int_div(first + F.greatest(size, F.lit(1)) - 1, F.lit(side)))


def roi_tiles(boxes: DataFrame, bitmaps: DataFrame, side: int = TILE, halo: bool = True) -> DataFrame:
    """Each box as tiles of its own: (image_id, box_id, other columns, left, top, width, height, y0, x0, w, h, px[, pad]).

    width and height are those of the clipped box, y0 and x0 count from its corner. Boxes meet the haloed tiles they touch, by
    grid cell; a crop needs no pixel beyond a tile's halo, since its own border is mirrored inwards. Only images with boxes are decoded.
    """
    crops = clipped_boxes(boxes, bitmaps)
    wanted = bitmaps.join(boxes.select("image_id").distinct(), "image_id", "left_semi")
    tiles = image_tiles(wanted, halo=halo, side=side).select(
        "image_id", int_div(F.col("y0"), F.lit(side)).alias("cy"), int_div(F.col("x0"), F.lit(side)).alias("cx"),
        F.col("y0").alias("ty"), F.col("x0").alias("tx"), F.col("w").alias("tw"), F.col("h").alias("th"), "px", *["pad"] * halo)
    met = (crops.withColumn("cy", F.explode(_cells(F.col("top"), F.col("height"), side)))
           .withColumn("cx", F.explode(_cells(F.col("left"), F.col("width"), side)))
           .join(tiles, ["image_id", "cy", "cx"]))
    for lead, size, begin, tile, length, at, n in (("top", "height", "y0", "ty", "th", "fy", "h"), ("left", "width", "x0", "tx", "tw", "fx", "w")):
        met = (met.withColumn(at, F.greatest(F.col(lead), F.col(tile)))
               .withColumn(n, F.greatest(F.least(F.col(lead) + F.col(size), F.col(tile) + F.col(length)) - F.col(at), F.lit(1)))
               .withColumn(begin, F.col(at) - F.col(lead)))

    def inside(i: Column, size: str) -> Column:
        """A place of the crop for one that may lie just outside of it."""
        n = F.col(size)
        return F.when(i < 0, F.least(F.lit(1), n - 1)).when(i >= n, F.greatest(n - 2, F.lit(0))).otherwise(i)

    def bordered(i: Column) -> Column:
        row = (F.col("top") + inside(F.col("y0") + i, "height") - F.col("ty") + 1) * (F.col("tw") + 2)
        start = F.col("left") - F.col("tx") + 1  # the crop's first column in a bordered row
        one = lambda place: F.slice("pad", (row + start + inside(place, "width") + 1).cast("int"), F.lit(1))
        return F.concat(one(F.col("x0") - 1), F.slice("pad", (row + start + F.col("x0") + 1).cast("int"), F.col("w")), one(F.col("x0") + F.col("w")))

    plain = F.flatten(F.transform(F.sequence(F.col("fy") - F.col("ty"), F.col("fy") - F.col("ty") + F.col("h") - 1), lambda i: F.slice(
        "px", (i * F.col("tw") + F.col("fx") - F.col("tx") + 1).cast("int"), F.col("w"))))
    parts = [plain.alias("px")]
    if halo:
        parts.append(F.flatten(F.transform(F.sequence(F.lit(-1), F.col("h")), bordered)).alias("pad"))
    return met.select(*crops.columns, "y0", "x0", "w", "h", *parts)


def roi_pixels(boxes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pixels of each box, in image coordinates."""
    keys = ("image_id", "box_id")
    return positioned(roi_tiles(boxes, bitmaps, halo=False), *keys, "left", "top").select(
        *keys, (F.col("top") + F.col("y")).alias("y"), (F.col("left") + F.col("x")).alias("x"), packed_luma(F.col("v")).alias("gray"))


def thumbnail_raster(tiles: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Box-average to the planned thumbnail size (never enlarging); one row per thumbnail pixel.

    A tile's pixels are summed by cell where the tile is made; a cell has four entries, its channels' sums and its pixels.
    """
    def cells(first: int, n: int, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """(cell, first place in the tile) along an axis."""
        at = np.arange(first, first + n) * max(1, math.floor(size * scale)) // size
        start = np.flatnonzero(np.diff(at, prepend=-1))
        return at[start], start

    def sums(columns: list[pa.Array]):
        px, offsets = columns[-1].values.to_numpy().view(np.uint32), columns[-1].offsets.to_numpy()
        codes, weights, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for i, (width, height, y0, x0, w, h) in enumerate(zip(*(c.to_pylist() for c in columns[:-1]))):
            scale = min(1.0, max_w / width, max_h / height)
            (cy, fy), (cx, fx) = cells(y0, h, height, scale), cells(x0, w, width, scale)
            grid = px[offsets[i]:offsets[i + 1]].reshape(h, w)
            planes = np.stack([grid >> 16 & 255, grid >> 8 & 255, grid & 255, np.ones_like(grid)], axis=2).astype(np.int64)
            weights.append(np.add.reduceat(np.add.reduceat(planes, fy, axis=0), fx, axis=1).reshape(-1))
            codes.append((((cy[:, None] * max_w + cx) * 4)[:, :, None] + np.arange(4)).reshape(-1))
            sizes.append(codes[-1].size)
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(codes), np.concatenate(weights)

    def means(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
        four = n.reshape(-1, 4)
        return None, [lists(x, bounds // 4) for x in (v[::4] // 4, *(four[:, c] / four[:, 3] for c in range(3)))]

    thumbs = per_raster(tiles, KEYS, ["width", "height", "y0", "x0", "w", "h", "px"], sums, means,
                        "cells array<int>, rs array<double>, gs array<double>, bs array<double>")
    cell, p = F.col("cell"), F.col("p")
    return (thumbs.select("image_id", "rs", "gs", "bs", F.posexplode("cells").alias("p", "cell"))
            .select("image_id", int_div(cell, F.lit(max_w)).cast("int").alias("y"), (cell % max_w).cast("int").alias("x"),
                    *[F.get(f"{c}s", p).alias(c) for c in "rgb"]))


def augment_raster(tiles: DataFrame, dx: int = 1, dy: int = 1) -> DataFrame:
    """Training variants in one pass: rescaled original, horizontal flip, and a shift.

    A shifted pixel that leaves the frame is dropped.
    """
    variants = F.array(
        F.struct(F.lit("original").alias("variant"), F.col("y").alias("vy"), F.col("x").alias("vx")),
        F.struct(F.lit("flip").alias("variant"), F.col("y").alias("vy"), (F.col("width") - 1 - F.col("x")).alias("vx")),
        F.struct(F.lit("shift").alias("variant"), (F.col("y") + dy).alias("vy"), (F.col("x") + dx).alias("vx")))
    flat = positioned(tiles, "image_id", "width", "height").select("image_id", "width", "height", "v", F.inline(variants))
    inside = (F.col("vx") >= 0) & (F.col("vx") < F.col("width")) & (F.col("vy") >= 0) & (F.col("vy") < F.col("height"))
    v = F.col("v")
    return flat.where(inside).select("image_id", "variant", F.col("vy").alias("y"), F.col("vx").alias("x"),
                                     (red(v) / 255.0).alias("r"), (green(v) / 255.0).alias("g"),
                                     (blue(v) / 255.0).alias("b"))
