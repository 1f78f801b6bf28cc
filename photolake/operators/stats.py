"""Statistics over the download attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions.columns import int_div, ratio


def _outcomes() -> list[Column]:
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    total = F.count("*")
    return [total.alias("total_attempts"), n("success").alias("successful_downloads"),
            n("failed").alias("failed_downloads"), n("skipped_duplicate").alias("skipped_duplicates"),
            F.when(total > 0, 100.0 * ratio(n("success"), total)).otherwise(F.lit(0.0)).alias("success_rate")]


def download_stats(attempts: DataFrame) -> DataFrame:
    """Totals and success rate over all attempts; one row, also for an empty log."""
    return attempts.agg(*_outcomes())


def batch_stats(attempts: DataFrame, batch_size: int = 20) -> DataFrame:
    """The same per batch, with skipped = attempts - downloaded."""
    batch = int_div(F.col("attempt_id"), F.lit(batch_size)).alias("batch")
    return (attempts.groupBy(batch).agg(*_outcomes())
            .withColumn("skipped_images", F.col("total_attempts") - F.col("successful_downloads")))


def rate_limit_flag(attempts: DataFrame, batch_size: int = 20) -> DataFrame:
    """A batch looks rate-limited when more than half of its attempts failed."""
    batch = int_div(F.col("attempt_id"), F.lit(batch_size)).alias("batch")
    failed, total = F.count_if(F.col("outcome") == "failed"), F.count("*")
    return attempts.groupBy(batch).agg(total.alias("n"), failed.alias("n_failed"),
                                       (failed > int_div(total, F.lit(2))).alias("rate_limited"))


def failure_log(attempts: DataFrame) -> DataFrame:
    """Failures per url: count, last error and its time."""
    failed = attempts.where(F.col("outcome") == "failed")
    last = F.max(F.struct("ts", "attempt_id", "error_type"))
    return failed.groupBy("url").agg(F.count("*").alias("n_failures"), last.alias("m")).select(
        "url", "n_failures", F.col("m.error_type").alias("last_error"), F.col("m.ts").alias("last_ts"))


def failures_by_type(attempts: DataFrame) -> DataFrame:
    failed = attempts.where(F.col("outcome") == "failed")
    return failed.groupBy("error_type").agg(F.count("*").alias("n_failures"), F.max("ts").alias("last_ts"))


def retry_cost(attempts: DataFrame, cap: int = 30) -> DataFrame:
    """Attempts and planned waiting per url: min(2 ** attempt, cap) seconds each, without jitter."""
    wait = F.least(F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(cap)))
    return attempts.groupBy("url").agg(F.count("*").alias("n_attempts"), F.sum(wait).alias("wait_seconds"))
