"""Class predictions: top labels, safety, and evaluation against true labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from photolake.functions.columns import ratio
from photolake.functions.fixed import NSFW_LABEL_WORDS


def top_predictions(predictions: DataFrame, k: int = 3, confident: float = 0.5) -> DataFrame:
    """The k most likely labels per image; an image has one row per class, so its window is bounded."""
    order = W.partitionBy("image_id").orderBy(F.desc("confidence"), "label")
    return (predictions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .withColumn("is_confident", F.col("confidence") >= confident))


def best_label(predictions: DataFrame) -> DataFrame:
    """The most likely label per image (ties by name); a partially aggregated maximum."""
    top = F.min(F.struct((-F.col("confidence")).alias("neg"), "label")).alias("m")
    extra = [F.any_value("true_label").alias("true_label")] if "true_label" in predictions.columns else []
    best = predictions.groupBy("image_id").agg(top, *extra)
    return best.select("image_id", F.col("m.label").alias("label"), (-F.col("m.neg")).alias("confidence"),
                       *(["true_label"] if extra else []))


rank_style = best_label


def classify_valid(images: DataFrame, predictions: DataFrame, min_side: int = 300,
                   words: Sequence[str] = tuple(NSFW_LABEL_WORDS)) -> DataFrame:
    """High resolution and none of the top three labels unsafe."""
    unsafe = F.lower("label").rlike("|".join(words))
    flags = top_predictions(predictions).groupBy("image_id").agg(
        F.bool_or(unsafe).alias("unsafe"),
        F.sort_array(F.collect_list(F.struct("rank", "label", "confidence"))).alias("top"))
    high = (F.col("width") >= min_side) & (F.col("height") >= min_side)
    nsfw = F.coalesce(F.col("unsafe"), F.lit(False))
    return images.join(flags, "image_id", "left").select(
        "image_id", (high & ~nsfw).alias("is_valid"), high.alias("is_high_resolution"),
        nsfw.alias("is_potentially_nsfw"),
        F.transform("top", lambda t: F.struct(t["label"].alias("label"), t["confidence"].alias("confidence")))
        .alias("top_predictions"))


def classification_stats(verdicts: DataFrame) -> DataFrame:
    """One row of totals over the verdicts of ``classify_valid``."""
    return verdicts.agg(
        F.count_if("is_valid").alias("valid_images"), F.count_if(~F.col("is_valid")).alias("invalid_images"),
        F.count_if("is_high_resolution").alias("high_resolution_images"),
        F.count_if(~F.col("is_high_resolution")).alias("low_resolution_images"),
        F.count_if("is_potentially_nsfw").alias("potentially_nsfw_images"))


def type_distribution(predictions: DataFrame) -> DataFrame:
    """Images and mean confidence per most likely label."""
    return best_label(predictions).groupBy("label").agg(F.count("*").alias("n_images"),
                                                        F.avg("confidence").alias("mean_confidence"))


# --- evaluation -----------------------------------------------------------------------------

def confusion_matrix(best: DataFrame, classes: Sequence[str]) -> DataFrame:
    """True x predicted counts with every class pair present. The grid is the model's classes squared."""
    grid = best.sparkSession.createDataFrame([(t, p) for t in classes for p in classes],
                                             "true_label string, predicted string")
    counts = best.groupBy("true_label", F.col("label").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true_label", "predicted"], "left").select(
        "true_label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, ratio(a, b)).otherwise(F.lit(0.0))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted means.

    The matrix has classes squared rows, so this is small whatever the number of images.
    """
    hit = F.col("true_label") == F.col("predicted")
    sides = matrix.select(F.inline(F.array(
        F.struct(F.col("true_label").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed")))))
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "claimed")]).select(
        "label", "tp", _safe(F.col("tp"), F.col("claimed")).alias("precision"),
        _safe(F.col("tp"), F.col("actual")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("actual") + F.col("claimed")).alias("f1"), F.col("actual").alias("support"))
    scores = ("precision", "recall", "f1")
    accuracy = _safe(F.sum("tp"), F.sum("support"))
    whole = per.agg(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in scores],
                 F.sum("support").alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in scores],
                 F.sum("support").alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores],
                 F.sum("support").alias("support")).alias("w"))
    return per.drop("tp").unionByName(whole.select(F.inline(F.array("a", "m", "w"))))


def eval_loss(predictions: DataFrame) -> DataFrame:
    """Accuracy and categorical cross-entropy. One grouping by image, then one row."""
    p_true = F.max(F.when(F.col("label") == F.col("true_label"), F.col("confidence")))
    top = F.min(F.struct((-F.col("confidence")).alias("neg"), "label"))
    per = predictions.groupBy("image_id").agg(p_true.alias("p"), top.alias("m"),
                                              F.any_value("true_label").alias("true_label"))
    floor = 1e-7
    return per.agg(F.count("*").alias("n_images"),
                   F.avg((F.col("m.label") == F.col("true_label")).cast("int")).alias("accuracy"),
                   F.avg(-F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor)))).alias("loss"))
