"""Helpers shared by the operators: reading tables, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from photolake.session import ensure_checkpoint_dir

#: Rows in an Arrow batch of whole texts. Texts may be very long, so batches are kept small.
TEXT_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, rows_per_batch: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, so lost executors cost only their own tasks, and later steps read columns of it
    instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if rows_per_batch:
        text_batches(spark, rows_per_batch)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the rows that go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (narrow ones); larger ones are joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def text_mark(text: str = "text"):
    """A hash that tells apart rows without an id or with a repeated one."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def nested(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, id, mark): whatever the columns are called, joins see none of their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("id"), text_mark().alias("mark"))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, hash of the text) is in ``bad`` (doc_id, mark)."""
    bad = bounded(written(bad.selectExpr("CAST(doc_id AS BIGINT) AS bad_id", "mark AS bad_mark").distinct()))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_mark"))
    return nested(docs).join(bad, same, "left_anti").select("row.*")
