"""Post search and tag queries."""

from pyspark.sql import functions as F

from photolake.functions.fixed import NSFW_TAGS, PERSON_TAGS
from photolake.operators import search, tags
from photolake.plans.oracle_views import h32, lst
from photolake.plans.registry import query, rounded
from photolake.sources import tables

COLLECT = search.SearchParams(start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", min_likes=5, min_notes=3)
SEARCH_WHERE = """type='photo' AND coalesce(likes,0)>=5 AND coalesce(note_count,0)>=3 AND NOT is_nsfw
  AND post_ts>=TIMESTAMP '2024-01-05 00:00:00' AND post_ts<=TIMESTAMP '2024-01-25 00:00:00'"""


@query("scan_posts", views="posts", sql="""
SELECT post_id, blog, post_ts, likes, note_count, is_nsfw, array_to_string(tags, ',') AS tags, len(photos) AS n_photos
FROM posts WHERE type='photo'""")
def scan_posts(spark, d):
    return search.scan_posts(tables.posts(spark, d)).select(
        "post_id", "blog", "post_ts", "likes", "note_count", "is_nsfw", F.array_join("tags", ",").alias("tags"),
        F.size("photos").cast("long").alias("n_photos"))


@query("search_posts", views="photo_rows", sql=f"""
SELECT post_id, blog, post_ts, url, array_to_string(tags, ',') AS tags FROM photo_rows
WHERE {SEARCH_WHERE} AND list_has_any(tags, ['portrait','smile','cosplay','自撮り'])""")
def search_posts(spark, d):
    params = search.SearchParams(tags=("portrait", "smile", "cosplay", "自撮り"), start=COLLECT.start,
                                 end=COLLECT.end, min_likes=5, min_notes=3)
    return search.search_posts(tables.posts(spark, d), params).select(
        "post_id", "blog", "post_ts", "url", F.array_join("tags", ",").alias("tags"))


@query("search_recent", views="photo_rows", sql="""
SELECT post_id, blog, post_ts, url FROM photo_rows WHERE type='photo' AND NOT is_nsfw AND coalesce(likes,0)>=0
 AND coalesce(note_count,0)>=0 AND post_ts>=TIMESTAMP '2024-01-11 00:00:00' AND post_ts<=TIMESTAMP '2024-02-10 00:00:00'
 AND blog IN ('src0','src1')""")
def search_recent(spark, d):
    """Without dates: the thirty days up to the given time; two blogs only."""
    params = search.SearchParams(blogs=("src0", "src1"), now="2024-02-10 00:00:00")
    return search.search_posts(tables.posts(spark, d), params).select("post_id", "blog", "post_ts", "url")


@query("make_filename", views="photo_rows", sql=f"""
SELECT post_id, url, concat(split_part(regexp_extract(url,'^https?://([^/]+)',1),'.',1),'_20240201_123000_',
  {h32('url')}%10000, '.', regexp_extract(url,'([^.]*)$',1)) AS filename FROM photo_rows""")
def make_filename(spark, d):
    photos = search.photo_rows(tables.posts(spark, d))
    return search.make_filename(photos, "2024-02-01 12:30:00").select("post_id", "url", "filename")


@query("skip_known", views="photo_rows", sql="""
SELECT post_id, url FROM photo_rows WHERE post_ts>=TIMESTAMP '2024-01-10 00:00:00'
 AND url NOT IN (SELECT url FROM photo_rows WHERE post_ts<TIMESTAMP '2024-01-10 00:00:00')""")
def skip_known(spark, d):
    photos = search.photo_rows(tables.posts(spark, d).select("post_id", "post_ts", "photos"))
    known = photos.where(F.col("post_ts") < search.ntz("2024-01-10 00:00:00"))
    return search.skip_known(photos.where(F.col("post_ts") >= search.ntz("2024-01-10 00:00:00")), known).select(
        "post_id", "url")


@query("translate_tags", views="post_tags expansion", sql="""
SELECT post_id, tag, expanded FROM post_tags JOIN expansion ON lower(tag)=word""")
def translate_tags(spark, d):
    return tags.translate_tags(tables.posts(spark, d))


@query("classify_by_tags", views="post_tags expansion", sql=f"""
SELECT post_id, coalesce(n,0)>0 AS is_person, coalesce(bad,0)>0 AS is_nsfw, coalesce(words,'') AS matched_tags,
  round(coalesce(n,0)/21.0,6) AS confidence
FROM posts LEFT JOIN (
 SELECT post_id, count(DISTINCT v) FILTER (v IN {tuple(PERSON_TAGS)}) AS n,
  count(*) FILTER (v IN {tuple(NSFW_TAGS)}) AS bad,
  string_agg(DISTINCT v, ',' ORDER BY v) FILTER (v IN {tuple(PERSON_TAGS)}) AS words
 FROM (SELECT post_id, lower(expanded) AS v FROM post_tags JOIN expansion ON lower(tag)=word) GROUP BY 1) USING (post_id)
""")
def classify_by_tags(spark, d):
    return rounded(tags.classify_by_tags(tables.posts(spark, d))
                   .withColumn("matched_tags", F.array_join("matched_tags", ",")))


@query("tag_counts", views="posts", sql="""
SELECT lower(tag) AS tag, count(*) AS n_posts, CAST(sum(n) AS BIGINT) AS n_images
FROM (SELECT unnest(tags) AS tag, len(photos) AS n FROM posts) GROUP BY 1""")
def tag_counts(spark, d):
    return tags.tag_counts(tables.posts(spark, d))


_COUNTED = """t AS (SELECT DISTINCT post_id, lower(tag) AS tag FROM post_tags),
c AS (SELECT tag, count(*) AS n_posts FROM t GROUP BY 1)"""


@query("tag_quota_sample", views="post_tags", sql=f"""
WITH {_COUNTED},
a AS (SELECT post_id, tag FROM t JOIN c USING (tag)
 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n_posts, tag)=1)
SELECT post_id, tag, row_number() OVER (PARTITION BY tag ORDER BY {h32('post_id')}, post_id) AS rank FROM a
QUALIFY rank<=10""")
def tag_quota_sample(spark, d):
    return tags.tag_quota_sample(tables.posts(spark, d))


@query("balanced_tags", views="post_tags", sql=f"""
WITH {_COUNTED}
SELECT post_id, tag, n_posts FROM t JOIN c USING (tag)
QUALIFY rank() OVER (PARTITION BY post_id ORDER BY n_posts)=1""")
def balanced_tags(spark, d):
    return tags.balanced_tags(tables.posts(spark, d))


SAMPLED = f"""s AS (SELECT post_id, tag FROM post_tags
 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY {h32('concat(post_id, tag)')}, tag)=1)"""


@query("sample_tag", views="post_tags", sql=f"WITH {SAMPLED} SELECT post_id, tag FROM s")
def sample_tag(spark, d):
    return tags.sample_tag(tables.posts(spark, d))


@query("tag_search", views="photo_rows", sql=f"""
SELECT post_id, url FROM photo_rows WHERE len(list_filter(tags, lambda t: lower(t) IN
 ('selfie','自撮り','セルフポートレート','セルフショット')))>0""")
def tag_search(spark, d):
    return tags.tag_search(tables.posts(spark, d), "selfie").select("post_id", "url")


@query("related_images", views="photo_rows post_tags", sql=f"""
WITH {SAMPLED},
p AS (SELECT post_id AS other_post_id, url, unnest(tags) AS tag FROM photo_rows),
k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {h32('url')}, url, other_post_id) AS o FROM p)
SELECT post_id, s.tag AS tag, row_number() OVER (PARTITION BY post_id ORDER BY o) AS rank, other_post_id, url
FROM s JOIN k ON s.tag=k.tag AND s.post_id<>k.other_post_id QUALIFY rank<=3""")
def related_images(spark, d):
    return tags.related_images(tables.posts(spark, d))
