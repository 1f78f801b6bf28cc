"""Detection boxes: filtering, ranking, overlap, suppression and crops' features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from photolake.functions.columns import box_score, iou, ratio, var_pop_of
from photolake.operators.features import commonest, quantised_colors
from photolake.operators.ranking import ranked
from photolake.operators.raster import clipped_boxes, roi_tiles
from photolake.operators.tallies import added, entropy, flat, per_raster, rasters
from photolake.operators.texture import tone_and_edges

ROI = ("image_id", "box_id")


def detection_filter(boxes: DataFrame, min_confidence: float = 0.5, min_side: int = 30, max_side: int = 300,
                     limit: int = 10) -> DataFrame:
    """Confident boxes of sensible size, the first ``limit`` per image in detection order."""
    ok = ((F.col("confidence") > min_confidence) & F.col("w").between(min_side, max_side)
          & F.col("h").between(min_side, max_side))
    order = W.partitionBy("image_id").orderBy("box_id")
    return boxes.where(ok).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def scored(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("score", box_score(F.col("w"), F.col("h")))


def box_rank(boxes: DataFrame, limit: int | None = None) -> DataFrame:
    """Boxes of each image by size and squareness, best first.

    The full ranking is placed by range, so an image with very many boxes spans several tasks. Callers that
    need only the best boxes pass ``limit``, which is applied per task before the exchange.
    """
    if not limit:
        full = ranked(scored(boxes), ["image_id"], [F.desc("score"), F.asc("box_id")])
        return full.withColumn("rank", F.col("rank").cast("int"))
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "box_id")
    return scored(boxes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Slices into which the boxes of an image are dealt.
SALTS = 16


def box_nms(boxes: DataFrame, threshold: float = 0.3, keep: int = 5, salts: int = SALTS) -> DataFrame:
    """Greedy suppression: per image keep the best box, drop boxes overlapping a kept one, at most ``keep``.

    Runs as ``keep`` rounds, each picking the best surviving box of every image. Boxes are placed once, by image and salt, and stay
    there: a round takes the best of each slice, merges one row per slice to one per image, and sends the kept boxes back to
    the image's slices. So an image holding a large share of all boxes stays spread out.
    """
    fields = ("box_id", "x", "y", "w", "h", "score")
    candidates = scored(boxes).select(
        "image_id", F.pmod(F.xxhash64("box_id"), F.lit(salts)).alias("salt"), *fields).repartition("image_id", "salt")
    slices = candidates.select("image_id", "salt").distinct()
    merit = F.struct("score", (-F.col("box_id")).alias("neg"), *[c for c in fields if c != "score"])

    def best_of(frame: DataFrame, alive: Column, earlier: Sequence[str], name: str) -> DataFrame:
        rest = [F.any_value(c).alias(c) for c in earlier]
        return (frame.groupBy("image_id", "salt").agg(*rest, F.max(F.when(alive, merit)).alias("top"))
                .groupBy("image_id").agg(*rest, F.max("top").alias(name)))

    kept = best_of(candidates, F.lit(True), (), "kept_1")
    for i in range(2, keep + 1):
        names = [f"kept_{j}" for j in range(1, i)]
        alive = F.lit(True)
        for name in names:
            clash = (F.col(f"{name}.box_id") == F.col("box_id")) | (iou("", f"{name}.") > threshold)
            alive = alive & ~F.coalesce(clash, F.lit(False))
        # The kept boxes ride along, so each round refers to the one before it once.
        kept = best_of(candidates.join(slices.join(kept, "image_id"), ["image_id", "salt"]), alive, names, f"kept_{i}")
    boxes_of = F.array_compact(F.array(*[f"kept_{i}" for i in range(1, keep + 1)]))
    return (kept.select("image_id", F.posexplode(boxes_of).alias("pos", "b"))
            .select("image_id", (F.col("pos") + 1).alias("rank"), *[F.col(f"b.{c}").alias(c) for c in fields]))


#: Cells of the finest grid have a side of 2 ** LEVEL.
LEVEL = 5


def _level_of(w: Column, h: Column) -> Column:
    """The finest grid whose cells are at least as large as a box, which then covers at most four of them."""
    side = F.greatest(w, h, F.lit(1)) - 1
    return F.greatest(F.when(side > 0, F.length(F.bin(side.cast("long")))).otherwise(0), F.lit(LEVEL))


def _covered_cells(level: Column) -> Column:
    """Every cell of a level's grid that a box touches."""
    def cells(at: str, size: str) -> Column:
        cell = lambda c: F.call_function("shiftright", c, level)  # noqa: E731 - rounds down below zero too
        return F.sequence(cell(F.col(at)), cell(F.col(at) + F.greatest(F.col(size) - 1, F.lit(0))))

    xs = cells("x", "w")
    return F.flatten(F.transform(cells("y", "h"), lambda cy: F.transform(xs, lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))))


def iou_pairs(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Overlapping box pairs (box_1 < box_2) of the same image with IoU above ``threshold``.

    A box lies on the grid of its own size, where it covers at most four cells. Since the IoU is at most the ratio of the longer sides,
    it can only meet boxes at most log2(1 / threshold) levels coarser, so it lies on these grids too; a pair meets on the
    grid of the larger box, and is reported in the cell that holds the corner of its intersection, so no duplicate removal is needed. Identical
    rectangles are linked to their first box only (IoU 1) and meet the others through it, so a pile
    of equal boxes never turns into all of its pairs.
    """
    names = ("x", "y", "w", "h")
    reach = min(26, math.ceil(math.log2(1 / threshold))) if threshold > 0 else 26
    rects = boxes.groupBy("image_id", *names).agg(F.min("box_id").alias("box_id"), F.count("*").alias("copies"))
    cells = (rects.withColumn("own", _level_of(F.col("w"), F.col("h")))
             .withColumn("level", F.explode(F.sequence(F.col("own"), F.least(F.col("own") + reach, F.lit(31)))))
             .withColumn("c", F.explode(_covered_cells(F.col("level"))))
             .select("image_id", "level", "own", "c.cx", "c.cy", "box_id", *names))
    a, b = cells.alias("a"), cells.alias("b")
    overlap = iou("a.", "b.")

    def at(axis: str) -> Column:
        return F.call_function("shiftright", F.greatest(f"a.{axis}", f"b.{axis}"), F.col("a.level"))

    meets = ((F.greatest("a.own", "b.own") == F.col("a.level")) & (at("x") == F.col("a.cx")) & (at("y") == F.col("a.cy")))
    close = (a.join(b, ["image_id", "level", "cx", "cy"])
             .where((F.col("a.box_id") < F.col("b.box_id")) & meets & (overlap > threshold))
             .select("image_id", F.col("a.box_id").alias("box_1"), F.col("b.box_id").alias("box_2"),
                     overlap.alias("iou")))
    piles = rects.where("copies > 1").withColumnRenamed("box_id", "box_1")
    star = (boxes.join(piles, ["image_id", *names]).where("box_id <> box_1")
            .select("image_id", "box_1", F.col("box_id").alias("box_2"), F.lit(1.0).alias("iou")))
    return close.unionByName(star)


def combine_detections(boxes: DataFrame, methods: Sequence[str] = ("cascade", "dnn"),
                       fallback: Sequence[str] = ("haar",)) -> DataFrame:
    """Boxes of the first methods; the fallback's boxes only for images without any of those."""
    first = boxes.where(F.col("method").isin(list(methods)))
    spare = boxes.where(F.col("method").isin(list(fallback)))
    return first.unionByName(spare.join(first.select("image_id").distinct(), "image_id", "left_anti"))


# --- features of crops ----------------------------------------------------------------------

def face_orientation(crops: DataFrame) -> DataFrame:
    """Mean gradient direction and magnitude of each crop."""
    return tone_and_edges(crops, ROI).select(*ROI, F.col("mean_angle").alias("dominant_angle"),
                                             F.col("edge_density").alias("gradient_magnitude"))


def face_quality_of(contrast: Column, sharpness: Column, eyes: Column) -> Column:
    raw = 1.0 / (1.0 + contrast) * (sharpness / 100.0) * F.when(eyes > 0, 1.0).otherwise(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def face_quality(crops: DataFrame) -> DataFrame:
    """Low noise, sharp, eyes visible; clamped to 0..1. ``eyes`` is a column of the crops."""
    stats = tone_and_edges(crops, (*ROI, "eyes"))
    return stats.select(*ROI, face_quality_of(F.col("contrast"), F.col("sharpness"), F.col("eyes")).alias("quality"))


def _equalised(bounds: np.ndarray, gray: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crop, v, cnt): histogram of each crop after histogram equalisation, from its gray levels in order."""
    run, start = rasters(bounds), bounds[:-1]
    total = np.add.reduceat(count, start)
    running = np.cumsum(count)
    up_to = running - (running[start] - count[start])[run]
    span = (total - count[start])[run]
    value = np.where(span == 0, gray, (510 * (up_to - count[start][run]) + span) // np.maximum(2 * span, 1))
    return added(run, value, count)


def _crop_features(bounds: np.ndarray, v: np.ndarray, n: np.ndarray):
    """Of gray levels (0 .. 255) and 12-bit colours (256 and up)."""
    runs, tone = len(bounds) - 1, v < 256
    run = rasters(bounds)
    edges = np.searchsorted(run[tone], np.arange(runs + 1))
    crop, value, count = _equalised(edges, v[tone], n[tone])
    at = np.searchsorted(crop, np.arange(runs))
    sums = [np.add.reduceat(x, at) for x in (count, value * count, value * value * count)]
    colors = np.searchsorted(run[~tone], np.arange(runs + 1))
    return None, [*sums, entropy(crop, count, runs, np.log), commonest(colors, v[~tone] - 256, n[~tone], 12)[0]]


def _levels_and_colors(columns: list[pa.Array]):
    px, tile = flat(columns[0])
    px = px.view(np.uint32)
    return np.concatenate([tile, tile]), np.concatenate([px >> 24, 256 + quantised_colors(px)]), None


def face_features(crops: DataFrame) -> DataFrame:
    """Mean, deviation and entropy (nats) of the equalised crop, and its most frequent 12-bit colour, from one count of both."""
    stats = per_raster(crops, ROI, ["px"], _levels_and_colors, _crop_features, "n bigint, s1 bigint, s2 bigint, entropy double, top_color bigint")
    return stats.where("image_id IS NOT NULL AND box_id IS NOT NULL").select(
        *ROI, ratio(F.col("s1"), F.col("n")).alias("mean_intensity"),
        F.sqrt(var_pop_of(F.col("n"), F.col("s1"), F.col("s2"))).alias("std_intensity"), "entropy", "top_color")


def face_details(boxes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One record per kept detection, with location, tone, quality, features and orientation, and with the number and the
    locations of all kept detections of its image (as many as ``detection_filter`` keeps, at most).
    """
    kept = detection_filter(boxes)
    crops = roi_tiles(kept, bitmaps)
    tone = tone_and_edges(crops, (*ROI, "eyes"))
    place = F.struct(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    location = clipped_boxes(kept, bitmaps).select(*ROI, place.alias("location"))
    faces = location.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "location"))).alias("faces")).select(
        "image_id", F.size("faces").alias("face_count"), F.col("faces.location").alias("face_locations"))
    return (location.join(tone, list(ROI)).join(face_features(crops), list(ROI)).join(faces, "image_id")
            .select(*ROI, "face_count", "face_locations", "location", "brightness", "contrast",
                    F.col("eyes").alias("eyes_count"),
                    face_quality_of(F.col("contrast"), F.col("sharpness"), F.col("eyes")).alias("quality_score"),
                    F.struct("mean_intensity", "std_intensity", "entropy", "top_color").alias("features"),
                    F.struct(F.col("mean_angle").alias("dominant_angle"),
                             F.col("edge_density").alias("gradient_magnitude")).alias("orientation")))


def detection_metrics(boxes: DataFrame, images: DataFrame, large: int = 1_000_000, medium: int = 300_000) -> DataFrame:
    """Detected boxes per image, summed by image format and size class. Counts come before the join."""
    per_image = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    size = F.when(F.col("width") * F.col("height") >= large, "large").when(
        F.col("width") * F.col("height") >= medium, "medium").otherwise("small")
    found = F.coalesce(F.col("n"), F.lit(0))
    return (images.join(per_image, "image_id", "left").groupBy("format", size.alias("size_class"))
            .agg(F.count("*").alias("n_images"), F.sum(found).alias("n_boxes"), F.count_if(found > 0).alias("n_with_boxes")))
