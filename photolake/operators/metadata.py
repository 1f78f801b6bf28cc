"""Image filters and metadata records.

Cheap tests on stored columns run first; pixel features are computed only for the survivors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions import fixed
from photolake.functions.columns import color_distance, ratio
from photolake.operators import features, hashing, predictions as pred, tags, texture
from photolake.sources.images import image_tiles, lowered, squeezed

Color = tuple[int, int, int]


@dataclass(frozen=True)
class FilterParams:
    """Advanced filters; entropy 0 and an empty palette leave those tests out."""
    min_resolution: tuple[int, int] = (800, 600)
    ratio_range: tuple[float, float] = (0.5, 2.0)
    entropy_threshold: float = 2.0
    palette: tuple[Color, ...] = ()
    tolerance: float = 30.0


def aspect_ratio() -> Column:
    return ratio(F.col("width"), F.col("height"))


def palette_match(colors: DataFrame, palette: Sequence[Color], tolerance: float = 30.0) -> DataFrame:
    """Flag mean colours within ``tolerance`` of any palette colour. A map over literals, no join."""
    return colors.withColumn("matches", near_palette((F.col("r"), F.col("g"), F.col("b")), palette, tolerance))


def near_palette(color: tuple[Column, Column, Column], palette: Sequence[Color], tolerance: float) -> Column:
    hit = F.lit(False)
    for c in palette:
        hit = hit | (color_distance(color, c) <= tolerance)
    return hit


def survivors(bitmaps: DataFrame, images: DataFrame) -> DataFrame:
    """Bitmaps of these images only; taken before decoding."""
    return bitmaps.join(images.select("image_id"), "image_id", "left_semi")


def palette_of(bitmaps: DataFrame) -> DataFrame:
    """(image_id, dominant_colors) at the size at which palettes are taken."""
    return features.palette_arrays(image_tiles(bitmaps, size=squeezed))


def quality_of(bitmaps: DataFrame) -> DataFrame:
    """(image_id, quality) at the size at which quality is judged."""
    return texture.quality_score(image_tiles(bitmaps, halo=True, size=lowered)).select("image_id", "quality")


def cheap_filter(p: FilterParams) -> Column:
    return ((F.col("width") >= p.min_resolution[0]) & (F.col("height") >= p.min_resolution[1])
            & aspect_ratio().between(*p.ratio_range))


def feature_filter(p: FilterParams) -> Column:
    """Over ``entropy``, ``r``, ``g``, ``b``."""
    cond = F.lit(True)
    if p.entropy_threshold:
        cond = cond & (F.col("entropy") >= p.entropy_threshold)
    if p.palette:
        cond = cond & near_palette((F.col("r"), F.col("g"), F.col("b")), p.palette, p.tolerance)
    return cond


def advanced_filter(images: DataFrame, bitmaps: DataFrame, p: FilterParams) -> DataFrame:
    """Images passing resolution, shape, entropy and palette tests."""
    kept = images.where(cheap_filter(p))
    tiles = image_tiles(survivors(bitmaps, kept))
    if p.entropy_threshold:
        kept = kept.join(features.gray_entropy_nats(tiles), "image_id")
    if p.palette:
        kept = kept.join(features.mean_color(tiles), "image_id")
    return kept.where(feature_filter(p))


def valid_image(images: DataFrame, bitmaps: DataFrame, flags: DataFrame, min_side: int = fixed.MIN_SIDE) -> DataFrame:
    """(image_id, is_valid, reject_reason): the first failing test in order of cost.

    ``flags`` gives is_nsfw per image. Only images that pass the tests on stored columns are decoded; one of them that has no
    bitmap is ``undecodable``.
    """
    cheap = (F.when(F.col("length") > fixed.MAX_FILE_BYTES, "file_size")
             .when((F.col("width") < min_side) | (F.col("height") < min_side), "too_small")
             .when(~aspect_ratio().between(fixed.MIN_RATIO, fixed.MAX_RATIO), "aspect_ratio")
             .when(~F.lower("format").isin(fixed.VALID_FORMATS), "format"))
    checked = images.select("image_id", cheap.alias("cheap"))
    scores = texture.color_and_blur(image_tiles(survivors(bitmaps, checked.where("cheap IS NULL")), halo=True))
    reason = (F.coalesce(F.col("cheap"), F.when(F.col("color_ratio").isNull(), "undecodable")
                         .when(F.col("color_ratio") < fixed.MIN_COLOR_RATIO, "low_color")
                         .when(F.col("blur_score") < fixed.MIN_BLUR_VARIANCE, "blurry")
                         .when(F.coalesce("is_nsfw", F.lit(False)), "nsfw")))
    return (checked.join(scores, "image_id", "left").join(flags, "image_id", "left")
            .select("image_id", reason.alias("reject_reason"))
            .select("image_id", F.col("reject_reason").isNull().alias("is_valid"), "reject_reason"))


def evaluate_quality(images: DataFrame, bitmaps: DataFrame, min_resolution: tuple[int, int] = (800, 600),
                     min_entropy: float = 4.0, min_sharpness: float = 100.0) -> DataFrame:
    """Resolution, entropy (bits) and sharpness verdicts per image."""
    tiles = image_tiles(survivors(bitmaps, images), halo=True)
    resolved = (F.col("width") >= min_resolution[0]) & (F.col("height") >= min_resolution[1])
    rich, sharp = F.col("entropy") >= min_entropy, F.col("blur_score") > min_sharpness
    return (images.join(features.gray_entropy_bits(tiles), "image_id").join(texture.blur_score(tiles), "image_id")
            .select("image_id", resolved.alias("meets_minimum"), "entropy", rich.alias("meets_entropy"),
                    F.col("blur_score").alias("laplacian_variance"), sharp.alias("is_sharp"),
                    (resolved & rich & sharp).alias("overall_quality")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def thumbnail_plan(images: DataFrame, contents: DataFrame, box: tuple[int, int] = (200, 200)) -> DataFrame:
    """Thumbnail size (shape kept, never enlarged) and name, from the content's digest."""
    digests = contents.select("image_id", F.substring(F.md5("content"), 1, 8).alias("digest"))
    scale = F.least(F.lit(1.0), ratio(F.lit(box[0]), F.col("width")), ratio(F.lit(box[1]), F.col("height")))
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5).cast("int"))
    return images.join(digests, "image_id").select(
        "image_id", side("width").alias("thumb_width"), side("height").alias("thumb_height"),
        F.concat(stem, F.lit("_thumb_"), "digest", F.lit(".jpg")).alias("thumb_name"))


def color_name(r: str, g: str, b: str) -> Column:
    """Nearest named colour to three channel columns, by squared distance, then by name."""
    options = (f"struct(({r} - {x}) * ({r} - {x}) + ({g} - {y}) * ({g} - {y}) + ({b} - {z}) * ({b} - {z}) AS d, "
               f"'{name}' AS name)" for name, (x, y, z) in fixed.COLOR_NAMES.items())
    return F.expr(f"array_min(array({', '.join(options)})).name")


def recommend_tags(bitmaps: DataFrame) -> DataFrame:
    """Distinct tags from palette colour names, brightness, shape and quality."""
    tones = palette_of(bitmaps).select("image_id", F.explode("dominant_colors").alias("c")).groupBy("image_id").agg(
        F.collect_set(F.concat(color_name("c.r", "c.g", "c.b"), F.lit(" tone"))).alias("tones"))
    stats = features.contrast_brightness(image_tiles(bitmaps), ("image_id", "width", "height"))
    light = F.col("brightness") / 255.0
    scored = stats.select("image_id", light.alias("light"), aspect_ratio().alias("shape")).join(quality_of(bitmaps), "image_id")
    found = F.array_compact(F.array(
        F.when(F.col("light") < 0.3, "dark").when(F.col("light") > 0.7, "bright"),
        F.when(F.col("shape") < 0.75, "portrait").when(F.col("shape") > 1.33, "landscape"),
        F.when(F.col("quality") > 0.8, "high-quality").when(F.col("quality") < 0.3, "low-quality")))
    return scored.join(tones, "image_id").select(
        "image_id", F.array_sort(F.array_distinct(F.concat("tones", found))).alias("tags"))


def basic_metadata(images: DataFrame, bitmaps: DataFrame, predictions: DataFrame, mode: str = "RGB", min_side: int = 300) -> DataFrame:
    """Size, format, hash, quality and classification of each decodable image."""
    bitmaps = survivors(bitmaps, images)
    verdict = pred.classify_valid(images, predictions, min_side)
    return (images.join(hashing.phash(image_tiles(bitmaps)), "image_id")
            .join(quality_of(bitmaps), "image_id")
            .join(verdict, "image_id")
            .select("image_id", "width", "height", F.col("length").alias("file_size"), "format",
                    F.lit(mode).alias("color_mode"), F.lower(F.lpad(F.hex("h"), 16, "0")).alias("phash"),
                    F.col("quality").alias("quality_score"),
                    F.struct("is_valid", "is_high_resolution", "is_potentially_nsfw", "top_predictions")
                    .alias("ai_classification")))


def post_metadata(images: DataFrame, bitmaps: DataFrame, posts: DataFrame, boxes: DataFrame) -> DataFrame:
    """File facts with the post's tags, detections, palette, quality and person flag.

    ``posts`` has image_id and tags. Every part but the images is optional per image.
    """
    bitmaps = survivors(bitmaps, images)
    verdict = tags.classify_by_tags(posts.withColumnRenamed("image_id", "post_id")).select(
        F.col("post_id").alias("image_id"), "is_person")
    palette = palette_of(bitmaps)
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("detected"))
    quality = quality_of(bitmaps)
    return (images.join(posts.select("image_id", "tags"), "image_id", "left").join(verdict, "image_id", "left")
            .join(counts, "image_id", "left").join(palette, "image_id", "left").join(quality, "image_id", "left")
            .select("image_id", file_name(F.col("path")).alias("filename"), F.col("length").alias("file_size"),
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                    F.coalesce("detected", F.lit(0)).alias("detected_faces"), "dominant_colors",
                    F.coalesce("quality", F.lit(0.0)).alias("image_quality"),
                    F.coalesce("is_person", F.lit(False)).alias("is_person")))


def image_report(images: DataFrame, bitmaps: DataFrame, predictions: DataFrame, min_side: int = 300) -> DataFrame:
    """One nested record per image: metadata, analysis and file facts."""
    bitmaps = survivors(bitmaps, images)
    tiles = image_tiles(bitmaps, halo=True)
    basic = basic_metadata(images, bitmaps, predictions, min_side=min_side)
    basic = basic.select("image_id", F.struct(*[c for c in basic.columns if c != "image_id"]).alias("basic_metadata"))
    profile = features.color_profile(tiles)
    histogram = profile.select("image_id", F.struct(
        F.col("hist_r").alias("red"), F.col("hist_g").alias("green"), F.col("hist_b").alias("blue")).alias("histogram"))
    texture_parts = texture.glcm_features(texture.glcm(tiles, angles=("0",)))
    skin = features.skin_ratio_score(tiles).withColumnRenamed("score", "nsfw_score")
    channels = bitmaps.select("image_id", F.col("n_channels") if "n_channels" in bitmaps.columns else F.lit(3).alias("n_channels"))
    return (images.join(basic, "image_id").join(palette_of(bitmaps), "image_id").join(histogram, "image_id")
            .join(texture.tone_and_edges(tiles), "image_id").join(skin, "image_id").join(channels, "image_id")
            .join(texture_parts.select("image_id", F.struct(*[c for c in texture_parts.columns if c != "image_id"])
                                       .alias("texture")), "image_id")
            .select("image_id", "basic_metadata",
                    F.struct(F.struct("width", "height", aspect_ratio().alias("aspect_ratio")).alias("dimensions"),
                             F.struct("dominant_colors", "histogram").alias("color_analysis"),
                             F.struct(F.col("sharpness").alias("blur_score"), "edge_density", "contrast",
                                      F.col("brightness").alias("mean_brightness")).alias("quality_metrics"),
                             "texture", "nsfw_score", F.col("n_channels").alias("channels")).alias("advanced_analysis"),
                    F.struct("path", F.col("length").alias("size_bytes"), F.col("atime").alias("last_modified"))
                    .alias("file_info")))


def organize_by_class(metadata: DataFrame) -> DataFrame:
    """Totals of images and of person images, over files of the organised types."""
    return organised(metadata).agg(F.count("*").alias("total_images"), F.count_if("is_person").alias("person_images"),
                                   F.count_if(~F.col("is_person")).alias("non_person_images"))


def _organised_type(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(fixed.ORGANIZE_EXTENSIONS)


def organisable(images: DataFrame) -> DataFrame:
    """Image files of the organised types; taken before decoding."""
    return images.where(_organised_type(file_name(F.col("path"))))


def organised(metadata: DataFrame) -> DataFrame:
    return metadata.where(_organised_type(F.col("filename")))
