"""Running totals and ranks inside groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from photolake.session import cut


def running_before(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the row's group.

    A window over the group alone would sort a hot group in one task. Rows are range-partitioned by
    group and order, so a hot group spans many partitions; each partition adds the totals of the
    earlier ones. The placement is checkpointed, so totals and rows see the same partitions.
    ``order`` must decide ties.
    """
    placed = cut(df.withColumn("_value", value).repartitionByRange(*group, *order)
                 .withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_part").agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_value").over(local), F.lit(0))
    return (placed.withColumn("_inside", inside).join(offsets, [*group, "_part"])
            .withColumn(name, F.col("_offset") + F.col("_inside"))
            .drop("_value", "_part", "_inside", "_offset"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers 1, 2, ... inside each group, whatever its size."""
    return running_before(df, group, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def cache_eviction(files: DataFrame, max_bytes: int = 500 * 1024 * 1024, threshold: float = 0.8) -> DataFrame:
    """Mark files to evict, oldest access first, until each cache directory holds at most its budget.

    ``files`` has cache_dir, path, length, atime.
    """
    budget = int(max_bytes * threshold)
    totals = files.groupBy("cache_dir").agg(F.sum("length").alias("total"))
    older = running_before(files, ["cache_dir"], [F.col("atime"), F.col("path")], F.col("length"), "older")
    return (older.join(totals, "cache_dir").withColumn("evict", F.col("total") - F.col("older") > budget)
            .drop("older", "total"))


def cleanup_performed(evictions: DataFrame) -> DataFrame:
    """Per cache directory: size before and after, files evicted, whether any cleanup took place."""
    freed = F.sum(F.when(F.col("evict"), F.col("length")).otherwise(0))
    return evictions.groupBy("cache_dir").agg(
        F.sum("length").alias("bytes_before"), (F.sum("length") - freed).alias("bytes_after"),
        F.count_if("evict").alias("n_evicted"), F.bool_or("evict").alias("cleanup_performed"))


def stratified_split(items: DataFrame, share: float = 0.2) -> DataFrame:
    """The first ``share`` of every class, by path, becomes the validation part."""
    sizes = items.groupBy("label").agg(F.count("*").alias("_n"))
    rows = ranked(items, ["label"], [F.col("path")], "_rank").join(sizes, "label")
    return rows.withColumn("part", F.when(F.col("_rank") <= F.floor(F.lit(share) * F.col("_n")), "validation")
                           .otherwise("training")).drop("_rank", "_n")
