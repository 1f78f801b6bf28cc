"""Searching the post feed and shaping photo rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions.columns import h32


@dataclass(frozen=True)
class SearchParams:
    """Search filters; ``None`` or an empty tuple leaves a filter out.

    Without ``start`` and ``end`` the last ``days`` days up to ``now`` (null: the time of the run) are searched; ``days=None``
    searches all time.
    """
    blogs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    min_likes: int = 0
    min_notes: int = 0
    content_type: tuple[str, ...] = ("photo",)
    nsfw_filter: bool = True
    days: int | None = 30
    now: str | None = None


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def scan_posts(posts: DataFrame, blogs: Sequence[str] = (), post_type: str | None = "photo") -> DataFrame:
    """Posts of the given blogs and type; both filters reach the scan of a stored post table."""
    if blogs:
        posts = posts.where(F.col("blog").isin(list(blogs)))
    return posts.where(F.col("type") == post_type) if post_type else posts


def matches(p: SearchParams) -> Column:
    cond = F.coalesce(F.col("note_count"), F.lit(0)) >= p.min_notes
    cond &= F.coalesce(F.col("likes"), F.lit(0)) >= p.min_likes
    if p.blogs:
        cond &= F.col("blog").isin(list(p.blogs))
    if p.content_type:
        cond &= F.col("type").isin(list(p.content_type))
    if p.start:
        cond &= F.col("post_ts") >= ntz(p.start)
    if p.end:
        cond &= F.col("post_ts") <= ntz(p.end)
    if not p.start and not p.end and p.days is not None:
        now = ntz(p.now) if p.now else F.current_timestamp().cast("timestamp_ntz")
        cond &= F.col("post_ts").between(now - F.expr(f"INTERVAL {int(p.days)} DAYS"), now)
    if p.nsfw_filter:
        cond &= ~F.coalesce(F.col("is_nsfw"), F.lit(False))
    if p.tags:
        cond &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in p.tags]))
    return cond


def photo_rows(posts: DataFrame) -> DataFrame:
    """One row per photo, with the post's columns."""
    keep = [c for c in posts.columns if c != "photos"]
    return posts.select(*keep, F.explode("photos").alias("photo")).select(*keep, F.col("photo.url").alias("url"))


def search_posts(posts: DataFrame, params: SearchParams) -> DataFrame:
    """Filter posts, then one row per photo url (bag semantics). A map: no shuffle."""
    return photo_rows(posts.where(matches(params)))


def make_filename(photos: DataFrame, run_ts: str, pattern: str = "{blog}_{timestamp}_{index}") -> DataFrame:
    """File name from the url: host label, the run's timestamp, a stable url index, and the extension."""
    fields = {
        "{blog}": F.split_part(F.call_function("parse_url", F.col("url"), F.lit("HOST")), F.lit("."), F.lit(1)),
        "{timestamp}": F.date_format(ntz(run_ts), "yyyyMMdd_HHmmss"),
        "{index}": (h32(F.col("url")) % 10000).cast("string"),
    }
    name: Column = F.lit(pattern)
    for mark, value in fields.items():
        name = F.replace(name, F.lit(mark), value)
    ext = F.split_part(F.col("url"), F.lit("."), F.lit(-1))
    return photos.withColumn("filename", F.concat(name, F.lit("."), ext))


def skip_known(photos: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Photos not collected before."""
    return photos.join(known.select(key), key, "left_anti")
