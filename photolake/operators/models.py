"""The trainable head: softmax over stored embeddings, by full gradient steps in fixed-point numbers.

Features, probabilities and weights are scaled integers, so sums over any number of tasks are exact and a run can be repeated
to the last digit. A step reads the data once: every task returns one array of sums of the model's size, and the same pass
gives the validation loss of the current weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Scale of features and probabilities, and of weights.
UNIT, WEIGHT = 10 ** 6, 10 ** 9


@dataclass(frozen=True)
class Head:
    """weights[class][dimension], the last dimension for the constant feature; the epoch they are from, and the validation
    loss after each epoch that was run (none without validation rows)."""
    weights: tuple[tuple[int, ...], ...]
    best_epoch: int
    losses: tuple[float, ...]


def _features(column: pa.Array) -> np.ndarray:
    """Scaled embeddings with a constant feature, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.floor(flat * UNIT + 0.5).astype(np.int64).reshape(len(column), -1)
    return np.concatenate([rows, np.full((len(column), 1), UNIT, dtype=np.int64)], axis=1)


def _probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    logits = (x @ weights.T).astype(np.float64) / float(UNIT * WEIGHT)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pass_over(data: DataFrame, weights: list[list[int]]) -> list[int]:
    """Exact sums over all rows: the gradient, class by class; training rows; validation loss; validation rows."""
    fixed = np.array(weights, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = _features(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            p = _probabilities(x, fixed)
            error = np.floor(p * UNIT + 0.5).astype(np.int64)
            own = p[np.arange(len(y)), y]
            error[np.arange(len(y)), y] -= UNIT
            loss = np.floor(-np.log(np.maximum(own, 1e-7)) * UNIT + 0.5).astype(np.int64)
            values = np.concatenate([(error[~held].T @ x[~held]).reshape(-1), [(~held).sum(), loss[held].sum(), held.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.int64()))], names=["s"])

    parts = data.mapInArrow(sums, "s array<bigint>").select(F.posexplode("s").alias("pos", "v"))
    rows = parts.groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("pos").collect()  # of the model's size
    return [int(r["v"]) for r in rows]


def train_head(items: DataFrame, n_classes: int, epochs: int = 50, patience: int = 10, rate: float = 1.0) -> Head:
    """Softmax head over frozen features: ``epochs`` gradient steps from zero weights; stops when the validation loss has not
    fallen for ``patience`` epochs, and keeps the weights of the epoch with the least loss.

    ``items`` has embedding, class_index and part; rows of part ``validation`` only judge, all others (also with null) train. Without
    validation rows all epochs are run and the last weights kept. A row without embedding or class is left out.
    """
    held = F.coalesce(F.col("part") == "validation", F.lit(False)) if "part" in items.columns else F.lit(False)
    data = items.where("embedding IS NOT NULL AND class_index IS NOT NULL").select(
        F.col("embedding").cast("array<double>").alias("embedding"), F.col("class_index").cast("int").alias("class_index"), held.alias("held"))
    data = data.persist()
    try:
        first = data.select(F.size("embedding").alias("n")).first()
        if first is None:
            raise ValueError("no rows to train on")
        size, step = first["n"] + 1, round(rate * 1000)
        weights = [[0] * size for _ in range(n_classes)]
        best, best_loss, best_weights, losses = 0, math.inf, weights, []
        sums = _pass_over(data, weights)
        for epoch in range(1, epochs + 1):
            n = max(1, sums[-3])
            moved = iter(sums)
            # weight units per (probability unit x feature unit): WEIGHT / (UNIT * UNIT * 1000), toward zero
            weights = [[w - int(math.copysign(1, g)) * (step * abs(g) // (UNIT * n)) for w, g in zip(row, moved)] for row in weights]
            sums = _pass_over(data, weights)
            loss = sums[-2] / sums[-1] if sums[-1] else -float(epoch)
            if sums[-1]:
                losses.append(loss / UNIT)
            if loss < best_loss:
                best, best_loss, best_weights = epoch, loss, weights
            elif epoch - best >= patience:
                break
    finally:
        data.unpersist()
    return Head(tuple(map(tuple, best_weights)), best, tuple(losses))


def predict_batch(model: Head, embeddings: DataFrame, classes: Sequence[str], threshold: float = 0.5,
                  keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per image and class: label, probability, and whether it reaches ``threshold``."""
    fixed, n_keys = np.array(model.weights, dtype=np.int64), len(keys)
    schema = embeddings.select(*keys).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(_features(batch.column(n_keys)), fixed) if len(batch) else np.zeros((0, len(fixed)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(fixed), pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], values], names=[*keys, "p"])

    scored = (embeddings.where("embedding IS NOT NULL").select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
              .mapInArrow(score, schema.add("p", ArrayType(DoubleType()))))
    names = F.array(*[F.lit(c) for c in classes])
    return (scored.select(*keys, F.posexplode("p").alias("pos", "confidence"))
            .select(*keys, F.get(names, F.col("pos")).alias("label"), "confidence",
                    (F.col("confidence") >= threshold).alias("is_confident")))


def model_table(spark: SparkSession, model: Head) -> DataFrame:
    """(class_index, dim, weight): the model as a table."""
    rows = [(k, d, w) for k, row in enumerate(model.weights) for d, w in enumerate(row)]
    return spark.createDataFrame(rows, "class_index int, dim int, weight bigint")


def save_model(spark: SparkSession, model: Head, path: str) -> None:
    facts = spark.createDataFrame([(model.best_epoch, list(model.losses))], "best_epoch int, losses array<double>")
    model_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> Head:
    rows: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{path}/weights").orderBy("class_index", "dim").collect():  # of the model's size
        rows.setdefault(r["class_index"], []).append(r["weight"])
    facts = spark.read.parquet(f"{path}/facts").first()
    return Head(tuple(tuple(rows[k]) for k in sorted(rows)), facts["best_epoch"], tuple(facts["losses"]))


def score_with(images: DataFrame, scorer: Callable[[Column], Column], classes: Sequence[str],
               column: str = "embedding") -> DataFrame:
    """Predictions from a user's own vectorised scorer (a pandas UDF returning array<double>)."""
    names = F.array(*[F.lit(c) for c in classes])
    return (images.select("image_id", F.posexplode(scorer(F.col(column))).alias("pos", "confidence"))
            .select("image_id", F.get(names, F.col("pos")).alias("label"), "confidence"))
