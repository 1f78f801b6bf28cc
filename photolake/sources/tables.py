"""Catalogue views derived from the given tables.

The tables hold no posts or images, so posts come from ``events`` and images from ``documents``
(an image's bytes are the UTF-8 bytes of the whole text) and ``embeddings``. Every view reads its
whole table and only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from photolake.functions.fixed import STYLE_LABELS

# Values of the derived columns.
POST_TAGS = ["portrait", "自撮り", "Landscape", "cosplay", "Musician", "俳優",
             "art", "nsfw", "裸", "smile", "sunset", "表情"]
ERROR_TYPES = ["ConnectionError", "Timeout", "ProxyError", "SSLError", "HTTP429"]
FORMATS = ["jpg", "jpeg", "png", "gif", "webp", "bmp"]


def _sql_array(values) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per post: blog, type, time, counters, tags and photo urls; ``events`` may be a stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("blog"))
    n_docs = docs.count()  # one number, read from the file footers
    tags = _sql_array(POST_TAGS)
    events = table(spark, sf_dir, "events") if events is None else events
    events = events.withColumn("doc_id", F.col("event_id") % n_docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return events.join(docs, "doc_id").join(labels, "doc_id", "left").selectExpr(
        "event_id AS post_id", "blog",
        "CASE event_type WHEN 'signup' THEN 'text' WHEN 'error' THEN 'video' ELSE 'photo' END AS type",
        "ts AS post_ts", "CAST(floor(value) AS INT) AS likes",
        "CAST(get_json_object(props, '$.k') AS INT) AS note_count",
        "coalesce(toxic, 0) = 1 AS is_nsfw",
        f"array_distinct(array({tags}[CAST(event_id % 12 AS INT)], {tags}[CAST(user_id % 12 AS INT)])) AS tags",
        "CASE WHEN event_id % 17 = 0 THEN CAST(array() AS ARRAY<STRUCT<url: STRING>>) ELSE "
        "transform(sequence(0L, event_id % 3), i -> named_struct('url', concat('https://', blog, "
        "'.example.com/img/', doc_id, '_', i, '.jpg'))) END AS photos")


#: Size of the near-square bitmap that holds ``length`` bytes.
WIDTH = "CAST(greatest(1, ceil(sqrt(ceil(length / 3)))) AS INT)"
HEIGHT = "CAST(greatest(1, ceil(ceil(length / 3) / width)) AS INT)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stored image file: every document, with its bitmap's size and length; the class of its embedding, if any, is its folder."""
    fmt = f"{_sql_array(FORMATS)}[CAST(doc_id % 6 AS INT)]"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(coalesce(octet_length(text), 0) AS BIGINT) AS length")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return docs.join(labels, "doc_id", "left").withColumn("width", F.expr(WIDTH)).withColumn("height", F.expr(HEIGHT)).selectExpr(
        "doc_id AS image_id", f"concat('/img/', coalesce('class' || label, 'unlabelled'), '/', doc_id, '.', {fmt}) AS path",
        "width", "height", "length", f"{fmt} AS format", "doc_id * 7919 % 100003 AS atime")


def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecorated bitmaps: RGB bytes of the whole text on a near-square grid (bytes repeat to fill it).

    Decoding is the heavy part, so bitmaps that lie in fewer row groups than there are cores are dealt out first.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "doc_id")
    return (docs
            .select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("data"))
            .where(F.octet_length("data") > 0)
            .withColumn("length", F.octet_length("data")).withColumn("width", F.expr(WIDTH)).withColumn("height", F.expr(HEIGHT))
            .select("image_id", "width", "height", "data"))


def gray_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray rasters, one per embedding: value v becomes floor((v + 1) * 127.5) in all channels."""
    v = "CAST(floor((CAST(e AS DOUBLE) + 1.0D) * 127.5D) AS INT)"
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id", "8 AS width", "CAST(size(embedding) DIV 8 AS INT) AS height", "0 AS y0", "0 AS x0", "8 AS w",
        "CAST(size(embedding) DIV 8 AS INT) AS h",
        f"transform(transform(embedding, e -> {v}), g -> shiftleft(g, 24) | (g * 65793)) AS px")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit sign hashes, plus one planted near copy per image with image_id % 9 flipped bits."""
    base = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id",
        "aggregate(transform(embedding, (e, p) -> CASE WHEN e > 0 THEN shiftleft(1L, p) ELSE 0L END), 0L, "
        "(a, b) -> a | b) AS h")
    copies = base.selectExpr("image_id + 1000000000 AS image_id",
                             "h ^ (shiftleft(1L, CAST(image_id % 9 AS INT)) - 1L) AS h")
    return base.unionByName(copies)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection boxes, with the number of eyes found in each."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS image_id", "event_id AS box_id",
        "CAST(event_id * 7 % 40 AS INT) AS x", "CAST(event_id * 11 % 40 AS INT) AS y",
        "CAST(20 + get_json_object(props, '$.k') AS INT) AS w", "CAST(20 + event_id % 90 AS INT) AS h",
        "(event_id * 13 % 100) / 100.0D AS confidence",
        "CASE WHEN event_type IN ('view', 'click') THEN 'cascade' WHEN event_type = 'error' THEN 'haar' "
        "ELSE 'dnn' END AS method", "CAST(event_id % 3 AS INT) AS eyes")


def attempts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Download attempts with outcome and error type; ``events`` may be a stream."""
    events = table(spark, sf_dir, "events") if events is None else events
    return events.selectExpr(
        "event_id AS attempt_id",
        "concat('https://u', user_id, '.example.com/', event_id % 40, '.png') AS url", "ts",
        "CAST(event_id % 4 AS INT) AS attempt",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped_duplicate' ELSE 'success' END "
        "AS outcome",
        f"CASE WHEN event_type = 'error' THEN {_sql_array(ERROR_TYPES)}[CAST(event_id % 5 AS INT)] END "
        "AS error_type")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten class confidences per image, with the true class. A class's weight is the fourth power of the
    mean of 1 + z over the components whose position modulo 10 is the class."""
    labels = _sql_array(STYLE_LABELS)
    return (table(spark, sf_dir, "embeddings")
            .selectExpr("vec_id AS image_id", f"{labels}[label] AS true_label", "transform(sequence(0, 9), c -> aggregate("
                        "filter(embedding, (z, i) -> i % 10 = c), named_struct('s', 0.0D, 'n', 0L), "
                        "(a, z) -> named_struct('s', a.s + (1.0D + z), 'n', a.n + 1L), a -> a.s / a.n)) AS mean")
            .withColumn("part", F.expr("transform(mean, m -> (m * m) * (m * m))"))
            .withColumn("total", F.expr("aggregate(part, 0.0D, (a, z) -> a + z)"))
            .selectExpr("image_id", "true_label", "total", "posexplode(part) AS (p, e)")
            .selectExpr("image_id", f"{labels}[p] AS label", "e / total AS confidence", "true_label"))
