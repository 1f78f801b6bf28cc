"""Streaming forms of collection: incremental search with related photos, de-duplication, counters and tag quota.

Each runs until the available input is used up; its checkpoint holds offset and state, which advance only after a batch has
succeeded. What must be remembered from batch to batch (urls seen, counters, places taken) is keyed state in Spark's state store, so
a batch never reads what earlier ones wrote. Sinks are idempotent: a batch writes its own ``batch_id`` folder and overwrites it when
it is retried. For state larger than memory set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from photolake.functions.columns import h32
from photolake.operators.search import SearchParams, search_posts
from photolake.operators.tags import related_from, sample_tag


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet",
                files_per_batch: int | None = 1) -> DataFrame:
    """A folder of parquet files as a stream: a few files per batch, or all that have arrived; ``files`` filters by name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def utc_instant(ts: Column) -> Column:
    """Event time must be an instant: read a zoneless timestamp as UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def utc_zoneless(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all available input, then stop."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(each).trigger(availableNow=True).start())
    query.awaitTermination()


def stream_collect(posts: DataFrame, params: SearchParams, pool: DataFrame, out: str, checkpoint: str, count: int = 3) -> None:
    """Search new posts batch by batch; append the photos found and, for one sampled tag of each post found, up to ``count``
    photos of other posts out of ``pool`` (``related_pool`` of the stored posts, a few rows a tag, best written once).

    Both kinds of rows of a batch are one write, so a retried batch leaves neither twice.
    """
    def collect(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        found = batch.select(F.lit("found").alias("kind"), "post_id", "url")
        related = related_from(batch.dropDuplicates(["post_id"]), pool, count).select(
            F.lit("related").alias("kind"), "post_id", "url", "tag", "rank", "other_post_id")
        write_batch(found.unionByName(related, allowMissingColumns=True), batch_id, out)
        batch.unpersist()

    drain(search_posts(posts, params).select("post_id", "tags", "url"), checkpoint, collect)


def stream_dedup(photos: DataFrame, out: str, checkpoint: str) -> None:
    """Collect each url once across batches, however late it or its copies come: the urls seen are keyed state, without a watermark."""
    drain(photos.select("url").dropDuplicates(["url"]), checkpoint, lambda b, i: write_batch(b, i, out))


def stream_stats(attempts: DataFrame, out: str, checkpoint: str, width: str = "1 day") -> None:
    """Running outcome counters per time window; each batch writes the counters it changed.

    There is no watermark, so late attempts count; the state is one counter per window and outcome.
    """
    counts = (attempts.select("outcome", utc_instant(F.col("ts")).alias("at"))
              .groupBy(F.window("at", width).alias("w"), "outcome").agg(F.count("*").alias("n"))
              .select(utc_zoneless(F.col("w.start")).alias("window_start"), "outcome", "n"))
    drain(counts, checkpoint, lambda b, i: write_batch(b, i, out), "update")


def latest_counts(written: DataFrame) -> DataFrame:
    """Current counters: the last batch that changed each one."""
    return written.groupBy("window_start", "outcome").agg(F.max_by("n", "batch_id").alias("n"))


def _admit(limit: int):
    """For one tag: the first posts of the batch by hash that still find a place; the state is the posts that have one."""
    def admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        best = pd.DataFrame({"post_id": pd.Series(dtype="int64"), "k": pd.Series(dtype="int64")})
        for part in parts:  # a hot tag streams by; no more than the free places and one part are held
            if len(taken) < limit:
                new = part.loc[~part["post_id"].isin(taken), ["post_id", "k"]]
                best = pd.concat([best, new]).drop_duplicates("post_id").nsmallest(limit - len(taken), ["k", "post_id"])
        if len(best):
            state.update((taken + [int(x) for x in best["post_id"]],))
        yield best[["post_id"]].assign(tag=key[0])

    return admit


def stream_tag_quota(posts: DataFrame, out: str, checkpoint: str, limit: int = 10) -> None:
    """At most ``limit`` posts per sampled tag over the life of the stream; a post that comes again takes no second place.

    The state of a tag is the ids of its accepted posts, at most ``limit``.
    """
    tagged = sample_tag(posts).select("tag", "post_id", h32(F.col("post_id")).alias("k"))
    admitted = tagged.groupBy("tag").applyInPandasWithState(
        _admit(limit), "post_id bigint, tag string", "taken array<bigint>", "append", GroupStateTimeout.NoTimeout)
    drain(admitted, checkpoint, lambda b, i: write_batch(b, i, out))
