"""Collecting images: search, filter, decide, remember, resume."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from photolake.operators import features, metadata as md, predictions as pred
from photolake.operators.search import SearchParams, make_filename, ntz, search_posts, skip_known
from photolake.session import cut
from photolake.sources.images import image_tiles


@dataclass(frozen=True)
class CollectParams:
    """Collection defaults: five likes, three notes, one hundred images."""
    search: SearchParams = field(default_factory=lambda: SearchParams(min_likes=5, min_notes=3))
    filters: md.FilterParams = field(default_factory=md.FilterParams)
    styles: tuple[str, ...] = ()
    max_images: int = 100
    run_ts: str = "1970-01-01 00:00:00"
    pattern: str = "{blog}_{timestamp}_{index}"
    overwrite: bool = False


@dataclass(frozen=True)
class Catalogue:
    """What the collector needs to know about images; ``image_key`` turns a photo row into an image_id."""
    images: DataFrame
    bitmaps: DataFrame
    predictions: DataFrame
    image_key: Column


def found_photos(posts: DataFrame, p: CollectParams, known: DataFrame | None = None) -> DataFrame:
    photos = search_posts(posts, p.search)
    return photos if known is None else skip_known(photos, known)


def collect_images(posts: DataFrame, cat: Catalogue, p: CollectParams, existing: DataFrame | None = None,
                   known: DataFrame | None = None) -> DataFrame:
    """(url, image_id, filename, status, reason) for the first ``max_images`` photos found.

    status is downloaded, skipped or error. The slice is a distributed top-n; only images in it that pass the cheap tests are
    decoded, and only their predictions are ranked.
    """
    chosen = (found_photos(posts, p, known).select("post_id", "post_ts", "url", cat.image_key.alias("image_id"))
              .orderBy("post_ts", "url", "post_id").limit(p.max_images))
    chosen = make_filename(chosen, p.run_ts, p.pattern)
    info = cat.images.join(chosen.select("image_id").distinct(), "image_id", "left_semi").select(
        "image_id", "width", "height", md.cheap_filter(p.filters).alias("cheap_ok"))
    tiles = image_tiles(md.survivors(cat.bitmaps, info.where(F.coalesce("cheap_ok", F.lit(True)))))
    if p.styles:
        wanted = cat.predictions.join(info.select("image_id"), "image_id", "left_semi")
    info = info.join(features.gray_entropy_nats(tiles), "image_id", "left")
    if p.filters.palette:
        info = info.join(features.mean_color(tiles), "image_id", "left")
    if p.styles:
        info = info.join(pred.best_label(wanted).select("image_id", F.col("label").alias("style")), "image_id", "left")
    rows = chosen.join(info, "image_id", "left")
    if existing is not None and not p.overwrite:
        rows = rows.join(existing.select("filename").distinct().withColumn("exists", F.lit(True)), "filename", "left")
    else:
        rows = rows.withColumn("exists", F.lit(False))
    style_ok = F.col("style").isin(list(p.styles)) if p.styles else F.lit(True)
    reason = (F.when(F.col("width").isNull(), "no image")
              .when(~F.col("cheap_ok"), "filters")
              .when(F.col("entropy").isNull(), "no pixels")
              .when(~md.feature_filter(p.filters), "filters")
              .when(~F.coalesce(style_ok, F.lit(False)), "style")
              .when(F.coalesce("exists", F.lit(False)), "exists"))
    return rows.withColumn("reason", reason).select(
        "post_id", "url", "image_id", "filename",
        F.when(F.col("reason").isNull(), "downloaded").when(F.col("reason").startswith("no "), "error")
        .otherwise("skipped").alias("status"), "reason")


def status_partition(collected: DataFrame) -> dict[str, DataFrame]:
    """Downloaded, skipped and failed rows: three filters of one status column, which is computed once."""
    collected = cut(collected)
    return {s: collected.where(F.col("status") == s) for s in ("downloaded", "skipped", "error")}


# --- state ----------------------------------------------------------------------------------

ITEMS = "url string, status string"
ERRORS = "url string, error string"
RUNS = "total_found bigint, params map<string,string>, end_ts timestamp_ntz"


@dataclass(frozen=True)
class State:
    """Collection state as tables: items(url, status), errors(url, error), runs(total_found, params, end_ts)."""
    items: DataFrame
    errors: DataFrame
    runs: DataFrame


def state_of(collected: DataFrame, total_found: DataFrame, params: dict[str, str], end_ts: str) -> State:
    """State of one collection run. ``total_found`` has one row with total_found."""
    entries = [F.lit(x) for kv in params.items() for x in kv]
    runs = total_found.select(F.col("total_found").cast("long"), F.create_map(*entries).alias("params"),
                              ntz(end_ts).alias("end_ts"))
    return State(collected.where("status <> 'error'").select("url", "status"),
                 collected.where("status = 'error'").select("url", F.col("reason").alias("error")), runs)


def merge_collections(old: State, new: State) -> State:
    """Union of items (distinct), union of errors (kept as a bag), summed totals; newer parameters win."""
    runs = old.runs.withColumn("o", F.lit(0)).unionByName(new.runs.withColumn("o", F.lit(1)))
    both = runs.agg(F.sum("total_found").alias("total_found"), F.min_by("params", "o").alias("before"),
                    F.max_by("params", "o").alias("after"), F.max("end_ts").alias("end_ts"))
    kept = F.map_filter("before", lambda k, v: ~F.map_contains_key(F.col("after"), k))
    merged = both.select("total_found", F.map_concat(kept, F.col("after")).alias("params"), "end_ts")
    return State(old.items.unionByName(new.items).dropDuplicates(["url", "status"]),
                 old.errors.unionByName(new.errors), merged)


def resume_window(runs: DataFrame, now: str, days: int = 30) -> DataFrame:
    """One row (start_ts, end_ts): from the last run's end, or ``days`` back, until now."""
    back = ntz(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return runs.agg(F.coalesce(F.max("end_ts"), back).alias("start_ts")).withColumn("end_ts", ntz(now))


def count_found(posts: DataFrame, p: CollectParams, known: DataFrame | None = None) -> DataFrame:
    return found_photos(posts, p, known).agg(F.count("*").alias("total_found"))


def run_collection(posts: DataFrame, cat: Catalogue, p: CollectParams, params: dict[str, str],
                   existing: DataFrame | None = None, known: DataFrame | None = None) -> State:
    end = p.search.end or p.run_ts
    return state_of(collect_images(posts, cat, p, existing, known), count_found(posts, p, known), params, end)


def resume_collection(previous: State | None, posts: DataFrame, cat: Catalogue, p: CollectParams, now: str,
                      params: dict[str, str], existing: DataFrame | None = None) -> State:
    """Collect what is new since the previous state and merge; without one, collect afresh."""
    if previous is None:
        return run_collection(posts, cat, replace(p, run_ts=now, search=replace(p.search, now=p.search.now or now)), params, existing)
    start = resume_window(previous.runs, now).first()["start_ts"]
    fresh = replace(p, run_ts=now, search=replace(p.search, start=str(start), end=now))
    return merge_collections(previous, run_collection(posts, cat, fresh, params, existing, known=previous.items))
