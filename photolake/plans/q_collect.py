"""Collection runs, state, exports and streams."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from photolake.operators import collect as co, metadata as md, search, tags
from photolake.plans.oracle_views import h32
from photolake.plans.q_images import ENTROPY_NATS, MEAN_COLOR
from photolake.plans.q_metadata import BEST, MIN_SIDE, PALETTE, PERSON, VERDICT, organised_meta
from photolake.plans.q_posts import COLLECT, SAMPLED, SEARCH_WHERE
from photolake.plans.registry import query
from photolake.operators import predictions as pred
from photolake.session import cut, ensure_checkpoint_dir
from photolake.sources import export, tables
from photolake.streaming import streams

STYLES = ("anime", "sketch", "comic", "abstract", "minimalist", "watercolor", "pixel_art")
PARAMS = co.CollectParams(
    search=COLLECT, styles=STYLES, max_images=400, run_ts="2024-01-25 00:00:00",
    filters=md.FilterParams(min_resolution=(24, 20), palette=PALETTE + ((80, 80, 80), (100, 90, 100)), tolerance=60.0))
WIDE = " OR ".join(f"sqrt((r-{x})**2+(g-{y})**2+(b-{z})**2)<=60" for x, y, z in PARAMS.filters.palette)


def scratch(spark, name):
    """A fresh folder under the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def catalogue(spark, d):
    key = F.regexp_extract("url", r"/img/(\d+)_", 1).cast("long")
    return co.Catalogue(tables.images(spark, d), tables.raw_images(spark, d), tables.predictions(spark, d), key)


def earlier_files(spark, d):
    """Files collected by an earlier run: the photos of the first days, under the same run stamp."""
    photos = search.photo_rows(tables.posts(spark, d).where(F.col("post_ts") < search.ntz("2024-01-03 00:00:00")))
    return search.make_filename(photos.select("url").distinct(), PARAMS.run_ts)


def _file(stamp: str) -> str:
    return f"""concat(split_part(regexp_extract(url,'^https?://([^/]+)',1),'.',1),'_{stamp}_',{h32('url')}%10000,'.',
      regexp_extract(url,'([^.]*)$',1))"""


STAMP = "20240125_000000"
DECIDE = f"""{ENTROPY_NATS}, {MEAN_COLOR}, {BEST},
facts AS (SELECT image_id, width, height, entropy, r, g, b, label FROM images LEFT JOIN e_nats USING (image_id)
 LEFT JOIN mean_color USING (image_id) LEFT JOIN best USING (image_id))"""
REASON = f"""CASE WHEN f.width IS NULL THEN 'no image'
 WHEN NOT (width>=24 AND height>=20 AND width/height BETWEEN 0.5 AND 2.0) THEN 'filters'
 WHEN entropy IS NULL THEN 'no pixels' WHEN entropy<2.0 OR NOT ({WIDE}) THEN 'filters'
 WHEN label IS NULL OR label NOT IN {STYLES} THEN 'style'"""
IMAGE = "CAST(regexp_extract(url,'/img/([0-9]+)_',1) AS BIGINT) AS image_id"
STATUS = "CASE WHEN reason IS NULL THEN 'downloaded' WHEN reason LIKE 'no %' THEN 'error' ELSE 'skipped' END"
COLLECTED = f"""{DECIDE},
chosen AS (SELECT post_id, post_ts, url, {IMAGE} FROM photo_rows WHERE {SEARCH_WHERE}
 ORDER BY post_ts, url, post_id LIMIT 400),
old AS (SELECT DISTINCT {_file(STAMP)} AS filename FROM photo_rows WHERE post_ts<TIMESTAMP '2024-01-03 00:00:00'),
coll AS (SELECT post_id, url, image_id, filename, {REASON} WHEN filename IN (SELECT filename FROM old) THEN 'exists' END
 AS reason FROM (SELECT *, {_file(STAMP)} AS filename FROM chosen) LEFT JOIN facts f USING (image_id))"""


def collected(spark, d):
    return co.collect_images(tables.posts(spark, d), catalogue(spark, d), PARAMS, earlier_files(spark, d))


@query("collect_images", views="photo_rows images pix predictions", sql=f"""
WITH {COLLECTED} SELECT post_id, url, image_id, filename, {STATUS} AS status, reason FROM coll""")
def collect_images(spark, d):
    return collected(spark, d)


@query("status_partition", views="photo_rows images pix predictions", sql=f"""
WITH {COLLECTED} SELECT {STATUS} AS part, count(*) AS n, count(DISTINCT url) AS n_urls FROM coll GROUP BY 1""")
def status_partition(spark, d):
    parts = co.status_partition(collected(spark, d))
    counted = [frame.select(F.lit(name).alias("part"), "url").groupBy("part").agg(
        F.count("*").alias("n"), F.countDistinct("url").alias("n_urls")) for name, frame in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# --- state: two halves of the attempt log act as two runs ------------------------------------

HALF = "2024-01-15 00:00:00"


def attempt_state(spark, d, first: bool):
    """State of a run made of the attempts before or after the half-way time."""
    log = tables.attempts(spark, d)
    log = log.where(F.col("ts") < search.ntz(HALF)) if first else log.where(F.col("ts") >= search.ntz(HALF))
    status = F.when(F.col("outcome") == "success", "downloaded").otherwise("skipped")
    items = log.where("outcome <> 'failed'").select("url", status.alias("status")).distinct()
    errors = log.where("outcome = 'failed'").select("url", F.col("error_type").alias("error"))
    params = {"blogs": "all", "run": "first"} if first else {"tags": "art", "run": "second"}
    entries = [F.lit(x) for kv in params.items() for x in kv]
    runs = log.agg(F.count("*").alias("total_found"), F.max("ts").alias("end_ts")).select(
        "total_found", F.create_map(*entries).alias("params"), "end_ts")
    return co.State(items, errors, runs)


def flat_state(state):
    """A state as one frame: items, errors and run facts as (kind, a, b, n) rows."""
    def rows(frame, kind, a, b):
        return frame.groupBy(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    runs = state.runs
    return (rows(state.items, "item", "url", "status").unionByName(rows(state.errors, "error", "url", "error"))
            .unionByName(runs.select(F.lit("total").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"),
                                     F.col("total_found").alias("n")))
            .unionByName(runs.select(F.explode("params").alias("a", "b")).select(
                F.lit("param").alias("kind"), "a", "b", F.lit(1).cast("long").alias("n"))))


def _flat_sql(cond: str, params: dict) -> str:
    values = ",".join(f"('{k}','{v}')" for k, v in params.items())
    return f"""
SELECT 'item' AS kind, url AS a, CASE outcome WHEN 'success' THEN 'downloaded' ELSE 'skipped' END AS b,
 1::BIGINT AS n FROM attempts WHERE outcome<>'failed' AND {cond} GROUP BY 2, 3
UNION ALL SELECT 'error', url, error_type, count(*) FROM attempts WHERE outcome='failed' AND {cond} GROUP BY 2, 3
UNION ALL SELECT 'total', '', '', count(*) FROM attempts WHERE {cond}
UNION ALL SELECT 'param', a, b, 1 FROM (VALUES {values}) t(a, b)"""


@query("merge_collections", views="attempts",
       sql=_flat_sql("true", {"blogs": "all", "tags": "art", "run": "second"}))
def merge_collections(spark, d):
    return flat_state(co.merge_collections(attempt_state(spark, d, True), attempt_state(spark, d, False)))


@query("save_load_state", views="attempts",
       sql=_flat_sql(f"ts>=TIMESTAMP '{HALF}'", {"tags": "art", "run": "second"}))
def save_load_state(spark, d):
    """Two saves; the later one is loaded."""
    path = scratch(spark, "state")
    export.save_state(attempt_state(spark, d, True), path, "2024-02-01T00:00:00")
    export.save_state(attempt_state(spark, d, False), path, "2024-02-02T00:00:00")
    return flat_state(export.load_state(spark, path))


@query("resume_window", views="posts", sql=f"""
WITH w AS (SELECT coalesce(max(post_ts), TIMESTAMP '2023-12-26 00:00:00') AS s FROM posts WHERE post_ts<TIMESTAMP '{HALF}')
SELECT post_id, post_ts FROM posts WHERE post_ts>=(SELECT s FROM w) AND post_ts<=TIMESTAMP '2024-01-25 00:00:00'""")
def resume_window(spark, d):
    posts = tables.posts(spark, d).select("post_id", "post_ts")
    runs = posts.where(F.col("post_ts") < search.ntz(HALF)).select(F.col("post_ts").alias("end_ts"))
    window = co.resume_window(runs, "2024-01-25 00:00:00").first()  # two timestamps
    return posts.where(F.col("post_ts").between(search.ntz(str(window["start_ts"])), search.ntz(str(window["end_ts"]))))


def _round_sql(n: int, start: str, end: str, known: str) -> str:
    """One collection round: found, chosen and decided photos."""
    return f"""found{n} AS MATERIALIZED (SELECT post_id, post_ts, url, {IMAGE} FROM photo_rows
 WHERE type='photo' AND coalesce(likes,0)>=5 AND coalesce(note_count,0)>=3 AND NOT is_nsfw
  AND post_ts>=TIMESTAMP '{start}' AND post_ts<=TIMESTAMP '{end}' {known}),
coll{n} AS MATERIALIZED (SELECT url, {REASON} END AS reason FROM
 (SELECT * FROM found{n} ORDER BY post_ts, url, post_id LIMIT 400) LEFT JOIN facts f USING (image_id))"""


@query("resume_collection", views="photo_rows images pix predictions", sql=f"""
WITH {DECIDE}, {_round_sql(1, '2024-01-05 00:00:00', HALF, '')},
{_round_sql(2, HALF, '2024-01-25 00:00:00',
            "AND url NOT IN (SELECT url FROM coll1 WHERE reason IS NULL OR reason NOT LIKE 'no %')")},
bag AS (SELECT *, {STATUS} AS status FROM (SELECT * FROM coll1 UNION ALL SELECT * FROM coll2))
SELECT 'item' AS kind, url AS a, status AS b, 1::BIGINT AS n FROM bag WHERE status<>'error' GROUP BY 2, 3
UNION ALL SELECT 'error', url, reason, count(*) FROM bag WHERE status='error' GROUP BY 2, 3
UNION ALL SELECT 'total', '', '', (SELECT count(*) FROM found1)+(SELECT count(*) FROM found2)
UNION ALL SELECT 'param', a, b, 1 FROM (VALUES ('run','second'),('first','yes')) t(a, b)""")
def resume_collection(spark, d):
    """Collect until the half-way time, save; reload, resume until the end, save; reload."""
    posts, cat, path = tables.posts(spark, d), catalogue(spark, d), scratch(spark, "resume")
    start = replace(PARAMS, search=replace(COLLECT, end=HALF))
    first = co.resume_collection(export.load_state(spark, path), posts, cat, start, HALF, {"run": "first", "first": "yes"})
    export.save_state(first, path, "2024-02-01T00:00:00")
    second = co.resume_collection(export.load_state(spark, path), posts, cat, PARAMS, "2024-01-25 00:00:00",
                                  {"run": "second"})
    export.save_state(second, path, "2024-02-02T00:00:00")
    return flat_state(export.load_state(spark, path))


# --- exports --------------------------------------------------------------------------------

def image_records(spark, d):
    verdict = pred.classify_valid(tables.images(spark, d), tables.predictions(spark, d), MIN_SIDE)
    nested = F.struct("is_valid", "is_high_resolution", F.col("top_predictions.label").alias("top_labels"))
    return tables.images(spark, d).join(verdict, "image_id").select(
        "image_id", "path", "width", "height", "format", F.col("length").alias("file_size"), nested.alias("ai_classification"))


@query("export_metadata_json", views="images predictions", sql=f"""
WITH {VERDICT} SELECT image_id, path, width, height, format, length AS file_size, is_valid, top AS top_labels
FROM images JOIN verdict USING (image_id)""")
def export_metadata_json(spark, d):
    """Written as JSON and read back."""
    records, path = image_records(spark, d), scratch(spark, "json")
    export.export_metadata(records, path, "json")
    return spark.read.schema(records.schema).json(path).select(
        "image_id", "path", "width", "height", "format", "file_size", "ai_classification.is_valid",
        F.array_join("ai_classification.top_labels", ",").alias("top_labels"))


@query("export_metadata_csv", views="images boxes", sql="""
SELECT format, CAST(NULL AS VARCHAR) AS detected, CAST(height AS VARCHAR) AS height, CAST(image_id AS VARCHAR) AS image_id,
 path, concat('{"w":',width,',"h":',height,'}') AS size, CAST(width AS VARCHAR) AS width FROM images
UNION ALL SELECT NULL, CAST(count(*) AS VARCHAR), NULL, CAST(image_id AS VARCHAR), NULL, NULL, NULL FROM boxes GROUP BY image_id""")
def export_metadata_csv(spark, d):
    """Two kinds of records with different keys, written as CSV and read back."""
    files = tables.images(spark, d).select("image_id", "path", "width", "height", "format",
                                           F.struct(F.col("width").alias("w"), F.col("height").alias("h")).alias("size"))
    counts = tables.boxes(spark, d).groupBy("image_id").agg(F.count("*").alias("detected"))
    path = scratch(spark, "csv")
    export.export_metadata_csv(path, files, counts)
    frame = export.csv_frame(files, counts)
    return spark.read.schema(frame.schema).option("header", True).csv(path)


@query("organize_files", views="images photo_rows expansion", sql=f"""
WITH {PERSON} SELECT image_id, post_id IS NOT NULL AS is_person FROM images LEFT JOIN person ON post_id=image_id
WHERE format IN ('png','jpg','jpeg','bmp','gif')""")
def organize_files(spark, d):
    """Records written into person and other folders, and read back with the folder as a column."""
    path = scratch(spark, "organised")
    export.write_organised(md.organised(organised_meta(spark, d)), path)
    return spark.read.schema("image_id bigint, is_person boolean").json(path)


# --- streams --------------------------------------------------------------------------------

BATCHES = 3


def arriving(spark, d, run):
    """The whole event table in three parts, dealt by event_id; each arrives, and is processed, after the one before.

    ``run`` gets the events as a stream, and its folders of results and checkpoints; the results are returned.
    """
    events, out = tables.table(spark, d, "events"), scratch(spark, "stream")
    for k in range(BATCHES):
        events.where(F.col("event_id") % BATCHES == k).write.mode("append").parquet(out + "/in")
        run(streams.read_stream(spark, out + "/in", events.schema, files_per_batch=None), out + "/out", out + "/ckpt")
    return out + "/out"


def written(spark, out, schema):
    return spark.read.schema(schema + ", batch_id int").parquet(out)


@query("stream_collect", views="photo_rows post_tags", sql=f"""
WITH {SAMPLED},
f AS (SELECT post_id, url FROM photo_rows WHERE {SEARCH_WHERE}),
p AS (SELECT post_id AS other_post_id, url, unnest(tags) AS tag FROM photo_rows),
k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {h32('url')}, url, other_post_id) AS o FROM p),
r AS (SELECT post_id, url, s.tag AS tag, row_number() OVER (PARTITION BY post_id ORDER BY o) AS rank, other_post_id
 FROM s JOIN k ON s.tag=k.tag AND s.post_id<>k.other_post_id WHERE post_id IN (SELECT post_id FROM f) QUALIFY rank<=3)
SELECT 'found' AS kind, post_id, url, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS INT) AS rank, CAST(NULL AS BIGINT) AS other_post_id FROM f
UNION ALL SELECT 'related', post_id, url, tag, CAST(rank AS INT), other_post_id FROM r""")
def stream_collect(spark, d):
    """Photos found, and related photos of stored posts, in three batches."""
    pool = cut(tags.related_pool(tables.posts(spark, d)))
    out = arriving(spark, d, lambda events, out, ckpt: streams.stream_collect(tables.posts(spark, d, events), COLLECT, pool, out, ckpt))
    return written(spark, out, "kind string, post_id bigint, url string, tag string, rank int, other_post_id bigint").drop("batch_id")


@query("stream_dedup", views="photo_rows", sql="SELECT DISTINCT url FROM photo_rows")
def stream_dedup(spark, d):
    out = arriving(spark, d, lambda events, out, ckpt: streams.stream_dedup(
        search.photo_rows(tables.posts(spark, d, events).select("post_ts", "photos")), out, ckpt))
    return written(spark, out, "url string").drop("batch_id")


@query("stream_stats", views="attempts", sql="""
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, outcome, count(*) AS n FROM attempts GROUP BY 1, 2""")
def stream_stats(spark, d):
    out = arriving(spark, d, lambda events, out, ckpt: streams.stream_stats(tables.attempts(spark, d, events), out, ckpt))
    return streams.latest_counts(written(spark, out, "window_start timestamp_ntz, outcome string, n bigint"))


@query("stream_tag_quota", views="post_tags", sql=f"""
WITH s AS (SELECT post_id, tag FROM post_tags
 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY {h32('concat(post_id, tag)')}, tag)=1)
SELECT post_id, tag FROM s
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY post_id%{BATCHES}, {h32('post_id')}, post_id)<=10""")
def stream_tag_quota(spark, d):
    out = arriving(spark, d, lambda events, out, ckpt: streams.stream_tag_quota(tables.posts(spark, d, events), out, ckpt))
    return written(spark, out, "post_id bigint, tag string").drop("batch_id")
