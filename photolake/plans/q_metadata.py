"""Filters, metadata records, predictions and evaluation queries.

The derived images are small (a text's bytes as pixels), so size limits are scaled down from their defaults.
"""

from pyspark.sql import functions as F

from photolake.functions.fixed import COLOR_NAMES, ORGANIZE_EXTENSIONS, STYLE_LABELS
from photolake.operators import boxes as bx, features, metadata as md, predictions as pred, ranking, search
from photolake.plans.oracle_views import lst
from photolake.plans.q_boxes import PHASH
from photolake.plans.q_images import (COLOR_RATIO, ENTROPY_BITS, ENTROPY_NATS, GLCM, HSV, MEAN_COLOR, QUALITY, kmeans_ctes,
                                      tiles)
from photolake.plans.registry import query, rounded
from photolake.sources import images as img, tables

MIN_SIDE = 24
BLUR = "blur AS (SELECT image_id, var_pop(lap) AS blur_score FROM stencil GROUP BY 1)"
PALETTE = ((110, 105, 110), (60, 60, 60), (90, 100, 95))
NEAR = " OR ".join(f"sqrt((r-{x})**2+(g-{y})**2+(b-{z})**2)<=30" for x, y, z in PALETTE)


@query("labels_from_path", views="images", sql="""
SELECT image_id, path, regexp_extract(path,'([^/]+)/[^/]+$',1) AS label,
 CAST(dense_rank() OVER (ORDER BY regexp_extract(path,'([^/]+)/[^/]+$',1))-1 AS INT) AS class_index FROM images""")
def labels_from_path(spark, d):
    return img.labels_from_path(tables.images(spark, d))


@query("advanced_filter", views="images pix", sql=f"""
WITH {ENTROPY_NATS}, {MEAN_COLOR}
SELECT image_id, width, height, round(entropy,6)+0.0 AS entropy, r, g, b FROM images JOIN e_nats USING (image_id)
 JOIN mean_color USING (image_id)
WHERE width>=24 AND height>=24 AND width/height BETWEEN 0.5 AND 2.0 AND entropy>=2.0 AND ({NEAR})""")
def advanced_filter(spark, d):
    params = md.FilterParams(min_resolution=(MIN_SIDE, MIN_SIDE), palette=PALETTE)
    kept = md.advanced_filter(tables.images(spark, d), tables.raw_images(spark, d), params)
    return rounded(kept.select("image_id", "width", "height", "entropy", "r", "g", "b"))


@query("valid_image", views="images stencil", sql=f"""
WITH {COLOR_RATIO}, {BLUR},
v AS (SELECT image_id, CASE WHEN length>10*1024*1024 THEN 'file_size' WHEN width<24 OR height<24 THEN 'too_small'
 WHEN NOT width/height BETWEEN 0.5 AND 2.0 THEN 'aspect_ratio'
 WHEN format NOT IN ('jpg','jpeg','png','gif','webp') THEN 'format' WHEN color_ratio IS NULL THEN 'undecodable'
 WHEN color_ratio<0.1 THEN 'low_color' WHEN blur_score<50 THEN 'blurry' WHEN coalesce(toxic,0)=1 THEN 'nsfw' END
 AS reject_reason FROM images LEFT JOIN color_ratio USING (image_id) LEFT JOIN blur USING (image_id)
 LEFT JOIN labels ON doc_id=image_id)
SELECT image_id, reject_reason IS NULL AS is_valid, reject_reason FROM v""")
def valid_image(spark, d):
    flags = tables.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), (F.col("toxic") == 1).alias("is_nsfw"))
    return md.valid_image(tables.images(spark, d), tables.raw_images(spark, d), flags, MIN_SIDE)


@query("palette_match", views="pix", sql=f"WITH {MEAN_COLOR} SELECT image_id, r, g, b, ({NEAR}) AS matches FROM mean_color")
def palette_match(spark, d):
    return md.palette_match(features.mean_color(tiles(spark, d)), PALETTE)


@query("evaluate_quality", views="images stencil", sql=f"""
WITH {ENTROPY_BITS}, {BLUR}
SELECT image_id, width>=32 AND height>=30 AS meets_minimum, round(entropy,6)+0.0 AS entropy,
 entropy>=4.0 AS meets_entropy, round(blur_score,6) AS laplacian_variance, blur_score>100 AS is_sharp,
 width>=32 AND height>=30 AND entropy>=4.0 AND blur_score>100 AS overall_quality
FROM images JOIN e_bits USING (image_id) JOIN blur USING (image_id)""")
def evaluate_quality(spark, d):
    return rounded(md.evaluate_quality(tables.images(spark, d), tables.raw_images(spark, d), (32, 30)))


def contents(spark, d):
    """File content per image: the bytes of the document with the image's number."""
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"),
                                                      F.col("text").cast("binary").alias("content"))


@query("thumbnail_plan", views="images", sql="""
WITH p AS (SELECT *, least(1.0::DOUBLE, 20.0::DOUBLE/width, 20.0::DOUBLE/height) AS k FROM images)
SELECT image_id, CAST(greatest(1,floor(width*k+0.5)) AS INT) AS thumb_width,
 CAST(greatest(1,floor(height*k+0.5)) AS INT) AS thumb_height,
 concat(regexp_extract(path,'([^/.]*)[.][^.]*$',1),'_thumb_',substr(md5(text),1,8),'.jpg') AS thumb_name
FROM p JOIN documents ON doc_id=image_id""")
def thumbnail_plan(spark, d):
    return md.thumbnail_plan(tables.images(spark, d), contents(spark, d), (20, 20))


TOP3 = """top3 AS (SELECT image_id, label, confidence, row_number() OVER (PARTITION BY image_id
 ORDER BY confidence DESC, label) AS rank FROM predictions QUALIFY rank<=3)"""
VERDICT = f"""{TOP3}, verdict AS (SELECT image_id, width>=24 AND height>=24 AS is_high_resolution,
 coalesce(bad,false) AS is_potentially_nsfw, width>=24 AND height>=24 AND NOT coalesce(bad,false) AS is_valid,
 top FROM images LEFT JOIN (SELECT image_id, bool_or(regexp_matches(lower(label),'nude|lingerie|bikini|underwear')) AS bad,
  string_agg(label, ',' ORDER BY rank) AS top FROM top3 GROUP BY 1) USING (image_id))"""


@query("classify_valid", views="images predictions", sql=f"""
WITH {VERDICT} SELECT image_id, is_valid, is_high_resolution, is_potentially_nsfw, top AS top_labels FROM verdict""")
def classify_valid(spark, d):
    return pred.classify_valid(tables.images(spark, d), tables.predictions(spark, d), MIN_SIDE).select(
        "image_id", "is_valid", "is_high_resolution", "is_potentially_nsfw",
        F.array_join("top_predictions.label", ",").alias("top_labels"))


@query("classification_stats", views="images predictions", sql=f"""
WITH {VERDICT} SELECT count(*) FILTER (is_valid) AS valid_images, count(*) FILTER (NOT is_valid) AS invalid_images,
 count(*) FILTER (is_high_resolution) AS high_resolution_images,
 count(*) FILTER (NOT is_high_resolution) AS low_resolution_images,
 count(*) FILTER (is_potentially_nsfw) AS potentially_nsfw_images FROM verdict""")
def classification_stats(spark, d):
    return pred.classification_stats(pred.classify_valid(tables.images(spark, d), tables.predictions(spark, d), MIN_SIDE))


BEST = """best AS (SELECT image_id, label, confidence, true_label FROM predictions
 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, label)=1)"""


@query("classification_types", views="predictions", sql=f"""
WITH {BEST} SELECT label, count(*) AS n_images, round(avg(confidence),6) AS mean_confidence FROM best GROUP BY 1""")
def classification_types(spark, d):
    return rounded(pred.type_distribution(tables.predictions(spark, d)))


@query("top3_predictions", views="predictions", sql=f"""
WITH {TOP3} SELECT image_id, label, round(confidence,6) AS confidence, rank, confidence>=0.125 AS is_confident FROM top3""")
def top3_predictions(spark, d):
    return rounded(pred.top_predictions(tables.predictions(spark, d), 3, 0.125).drop("true_label"))


@query("rank_style", views="predictions", sql=f"""
WITH {BEST} SELECT image_id, label, round(confidence,6) AS confidence FROM best""")
def rank_style(spark, d):
    return rounded(pred.rank_style(tables.predictions(spark, d)).drop("true_label"))


MATRIX = f"""{BEST}, cls AS (SELECT unnest({lst(STYLE_LABELS)}) AS c),
matrix AS (SELECT t.c AS true_label, p.c AS predicted, count(best.image_id) AS n FROM cls t CROSS JOIN cls p
 LEFT JOIN best ON best.true_label=t.c AND best.label=p.c GROUP BY 1, 2)"""


@query("confusion_matrix", views="predictions", sql=f"WITH {MATRIX} SELECT * FROM matrix")
def confusion_matrix(spark, d):
    return pred.confusion_matrix(pred.best_label(tables.predictions(spark, d)), STYLE_LABELS)


SCORES = """per AS (SELECT c AS label, sum(n) FILTER (true_label=c AND predicted=c) AS tp, sum(n) FILTER (true_label=c) AS act,
 sum(n) FILTER (predicted=c) AS cl FROM matrix JOIN cls ON c IN (true_label, predicted) GROUP BY 1),
sc AS (SELECT label, tp, act AS support, CASE WHEN cl>0 THEN tp/cl ELSE 0 END AS precision,
 CASE WHEN act>0 THEN tp/act ELSE 0 END AS recall, CASE WHEN act+cl>0 THEN 2*tp/(act+cl) ELSE 0 END AS f1 FROM per),
rep AS (SELECT label, precision, recall, f1, support FROM sc
 UNION ALL SELECT 'accuracy', sum(tp)/sum(support), sum(tp)/sum(support), sum(tp)/sum(support), sum(support) FROM sc
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM sc
 UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
  sum(f1*support)/sum(support), sum(support) FROM sc)"""


@query("classification_report", views="predictions", sql=f"""
WITH {MATRIX}, {SCORES} SELECT label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1,
 CAST(support AS BIGINT) AS support FROM rep""")
def classification_report(spark, d):
    matrix = pred.confusion_matrix(pred.best_label(tables.predictions(spark, d)), STYLE_LABELS)
    return rounded(pred.classification_report(matrix))


@query("eval_loss", views="predictions", sql=f"""
WITH {BEST} SELECT count(*) AS n_images, round(avg(CASE WHEN b.label=b.true_label THEN 1 ELSE 0 END),6) AS accuracy,
 round(avg(-ln(greatest(coalesce(p.confidence,0),1e-7))),6) AS loss
FROM best b LEFT JOIN predictions p ON p.image_id=b.image_id AND p.label=b.true_label""")
def eval_loss(spark, d):
    return rounded(pred.eval_loss(tables.predictions(spark, d)))


@query("stratified_split", views="images", sql="""
WITH l AS (SELECT image_id, path, regexp_extract(path,'([^/]+)/[^/]+$',1) AS label FROM images)
SELECT image_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY path)
 <= floor(0.2::DOUBLE*count(*) OVER (PARTITION BY label)) THEN 'validation' ELSE 'training' END AS part FROM l""")
def stratified_split(spark, d):
    return ranking.stratified_split(img.labels_from_path(tables.images(spark, d))).select("image_id", "label", "part")


EVICT = """f AS (SELECT *, regexp_extract(path,'^(/[^/]+)',1) AS cache_dir FROM images),
ev AS (SELECT image_id, cache_dir, path, length, sum(length) OVER (PARTITION BY cache_dir)
 - coalesce(sum(length) OVER (PARTITION BY cache_dir ORDER BY atime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)
 > 1600000 AS evict FROM f)"""


def cache_files(spark, d):
    return tables.images(spark, d).withColumn("cache_dir", F.regexp_extract("path", "^(/[^/]+)", 1))


@query("cache_eviction", views="images", sql=f"WITH {EVICT} SELECT image_id, cache_dir, evict FROM ev")
def cache_eviction(spark, d):
    return ranking.cache_eviction(cache_files(spark, d), max_bytes=2_000_000).select("image_id", "cache_dir", "evict")


@query("cache_cleanup", views="images", sql=f"""
WITH {EVICT} SELECT cache_dir, CAST(sum(length) AS BIGINT) AS bytes_before,
 CAST(coalesce(sum(length) FILTER (NOT evict),0) AS BIGINT) AS bytes_after, count(*) FILTER (evict) AS n_evicted,
 bool_or(evict) AS cleanup_performed FROM ev GROUP BY 1""")
def cache_cleanup(spark, d):
    return ranking.cleanup_performed(ranking.cache_eviction(cache_files(spark, d), max_bytes=2_000_000))


_NAMES = "(VALUES " + ",".join(f"('{n}',{r},{g},{b})" for n, (r, g, b) in COLOR_NAMES.items()) + ") t(name, x, y, z)"
TAGS = f"""tones AS (SELECT DISTINCT image_id, name || ' tone' AS tag FROM (SELECT image_id, cluster, name FROM palette, {_NAMES}
 QUALIFY row_number() OVER (PARTITION BY image_id, cluster ORDER BY (r-x)**2+(g-y)**2+(b-z)**2, name)=1)),
look AS (SELECT image_id, avg(gray)/255.0 AS light, any_value(width)/any_value(height) AS shape FROM stencil GROUP BY 1),
extra AS (SELECT image_id, CASE WHEN light<0.3 THEN 'dark' WHEN light>0.7 THEN 'bright' END AS tag FROM look
 UNION ALL SELECT image_id, CASE WHEN shape<0.75 THEN 'portrait' WHEN shape>1.33 THEN 'landscape' END FROM look
 UNION ALL SELECT image_id, CASE WHEN (sharpness_score+brightness_score+noise_score)/3>0.8 THEN 'high-quality'
  WHEN (sharpness_score+brightness_score+noise_score)/3<0.3 THEN 'low-quality' END FROM quality)"""


@query("recommend_tags", views="stencil pix100", sql=f"""
WITH {QUALITY}, {kmeans_ctes()}, {TAGS}
SELECT image_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT * FROM tones UNION SELECT * FROM extra)
WHERE tag IS NOT NULL GROUP BY 1""")
def recommend_tags(spark, d):
    return md.recommend_tags(tables.raw_images(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("basic_metadata", views="images stencil predictions", sql=f"""
WITH {PHASH}, {QUALITY}, {VERDICT}
SELECT image_id, width, height, length AS file_size, format, 'RGB' AS color_mode, lower(printf('%016X', h)) AS phash,
 round((sharpness_score+brightness_score+noise_score)/3,6) AS quality_score, is_valid, is_high_resolution,
 is_potentially_nsfw, top AS top_labels
FROM images JOIN ph USING (image_id) JOIN quality USING (image_id) JOIN verdict USING (image_id)""")
def basic_metadata(spark, d):
    full = md.basic_metadata(tables.images(spark, d), tables.raw_images(spark, d), tables.predictions(spark, d), min_side=MIN_SIDE)
    return rounded(full.select("*", "ai_classification.*").drop("ai_classification")
                   .withColumn("top_labels", F.array_join("top_predictions.label", ",")).drop("top_predictions"))


def image_posts(spark, d):
    """Tags of all posts that carry each image."""
    number = F.regexp_extract("url", r"/img/(\d+)_", 1).cast("long")
    tagged = search.photo_rows(tables.posts(spark, d).select("tags", "photos")).select(number.alias("image_id"), F.explode("tags").alias("tag"))
    # Repeats go by hash before the tags are collected; a set per image and task would be sorted.
    return tagged.distinct().groupBy("image_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


PERSON = """image_tags AS MATERIALIZED (SELECT DISTINCT CAST(regexp_extract(url,'/img/([0-9]+)_',1) AS BIGINT) AS image_id,
 unnest(tags) AS tag FROM photo_rows),
person AS (SELECT DISTINCT image_id AS post_id FROM image_tags JOIN expansion ON lower(tag)=word
 WHERE lower(expanded) IN (SELECT key FROM synonyms WHERE key NOT IN ('nsfw','adult','sexy','nude','provocative')))"""
POST_META = f"""{PERSON}, {QUALITY}, {kmeans_ctes()},
det AS (SELECT image_id, count(*) AS n FROM boxes WHERE method IN ('cascade','dnn') OR image_id NOT IN
 (SELECT image_id FROM boxes WHERE method IN ('cascade','dnn')) GROUP BY 1),
pal AS (SELECT image_id, string_agg(concat(r,' ',g,' ',b), ',' ORDER BY cluster) AS colors FROM palette GROUP BY 1),
meta AS (SELECT image_id, regexp_extract(path,'([^/]*)$',1) AS filename, length AS file_size,
 coalesce(tags,'') AS tags, coalesce(n,0) AS detected_faces, coalesce(colors,'') AS colors,
 coalesce((sharpness_score+brightness_score+noise_score)/3,0.0) AS image_quality, person.post_id IS NOT NULL AS is_person
 FROM images LEFT JOIN (SELECT image_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM image_tags GROUP BY 1) USING (image_id)
 LEFT JOIN person ON person.post_id=image_id
 LEFT JOIN det USING (image_id) LEFT JOIN pal USING (image_id) LEFT JOIN quality USING (image_id))"""


def post_meta(spark, d, images=None):
    return md.post_metadata(tables.images(spark, d) if images is None else images, tables.raw_images(spark, d), image_posts(spark, d),
                            bx.combine_detections(tables.boxes(spark, d)))


@query("post_metadata", views="images stencil pix100 photo_rows expansion boxes", sql=f"""
WITH {POST_META} SELECT * REPLACE (round(image_quality,6) AS image_quality) FROM meta""")
def post_metadata(spark, d):
    return rounded(post_meta(spark, d).withColumn("tags", F.array_join("tags", ","))
                   .withColumn("colors", F.coalesce(F.array_join(F.transform(
                       "dominant_colors", lambda c: F.concat_ws(" ", c["r"], c["g"], c["b"])), ","), F.lit("")))
                   .drop("dominant_colors"))


def organised_meta(spark, d):
    """Records of the files that get organised; only these are decoded."""
    return post_meta(spark, d, md.organisable(tables.images(spark, d)))


@query("organize_by_class", views="images photo_rows expansion", sql=f"""
WITH {PERSON} SELECT count(*) AS total_images, count(post_id) AS person_images, count(*)-count(post_id) AS non_person_images
FROM images LEFT JOIN person ON post_id=image_id WHERE format IN {tuple(ORGANIZE_EXTENSIONS)}""")
def organize_by_class(spark, d):
    return md.organize_by_class(organised_meta(spark, d))


@query("image_report", views="images stencil pix100 predictions", sql=f"""
WITH {PHASH}, {VERDICT}, {GLCM},
tone AS (SELECT image_id, var_pop(lap) AS blur, avg(sqrt(gx*gx+gy*gy)) AS edge, stddev_pop(gray) AS con, avg(gray) AS br
 FROM stencil GROUP BY 1),
gf AS (SELECT image_id, sum(p*(i-j)*(i-j)) AS contrast, sum(p*abs(i-j)) AS dissimilarity, sum(p/(1+(i-j)*(i-j))) AS homogeneity,
  sqrt(sum(p*p)) AS energy, sum(p*i) AS m FROM glcm WHERE angle='0' GROUP BY 1),
gc AS (SELECT image_id, CASE WHEN sum(p*(i-m)*(i-m))>1e-9 THEN sum(p*(i-m)*(j-m))/sum(p*(i-m)*(i-m)) ELSE 1.0 END AS correlation
 FROM glcm JOIN gf USING (image_id) WHERE angle='0' GROUP BY 1),
hc AS (SELECT image_id, c, bin, count(*) AS cnt FROM (SELECT image_id, 'r' AS c, r AS bin FROM pix
 UNION ALL SELECT image_id, 'g', g FROM pix UNION ALL SELECT image_id, 'b', b FROM pix) GROUP BY ALL),
hist AS (SELECT image_id, string_agg(concat(c,bin,'=',cnt), ',' ORDER BY c DESC, bin) AS histogram FROM hc GROUP BY 1),
{HSV}, skin AS (SELECT image_id, least(1.0::DOUBLE, 2.0*count(*) FILTER (hue<=20 AND sat>=48 AND mx>=80)/count(*)) AS score
 FROM hsv GROUP BY 1),
conf AS (SELECT image_id, string_agg(concat(label,' ',CAST(round(confidence*1e6) AS BIGINT)), ',' ORDER BY rank) AS confidences FROM top3 GROUP BY 1),
{kmeans_ctes()},
pal AS (SELECT image_id, string_agg(concat(r,' ',g,' ',b), ',' ORDER BY cluster) AS colors FROM palette GROUP BY 1)
SELECT image_id, path, length AS size_bytes, round(width/height,6) AS aspect_ratio, lower(printf('%016X', h)) AS phash,
 is_valid, round(blur,6) AS blur_score, round(edge,6) AS edge_density, round(con,6) AS contrast,
 round(br,6) AS mean_brightness, round(gf.contrast,6) AS glcm_contrast, round(dissimilarity,6) AS dissimilarity,
 round(homogeneity,6) AS homogeneity, round(energy,6) AS energy, round(correlation,6) AS correlation, histogram,
 round(skin.score,6) AS nsfw_score, 3 AS channels, coalesce(confidences,'') AS confidences, colors
FROM images JOIN ph USING (image_id) JOIN verdict USING (image_id) JOIN tone USING (image_id) JOIN gf USING (image_id)
 JOIN gc USING (image_id) JOIN hist USING (image_id) JOIN skin USING (image_id) LEFT JOIN conf USING (image_id) JOIN pal USING (image_id)""")
def image_report(spark, d):
    full = md.image_report(tables.images(spark, d), tables.raw_images(spark, d), tables.predictions(spark, d), MIN_SIDE)
    def nonzero(channel):
        counts = F.transform(f"advanced_analysis.color_analysis.histogram.{channel}", lambda c, i: F.when(
            c > 0, F.concat(F.lit(channel[0]), i.cast("string"), F.lit("="), c.cast("string"))))
        return F.array_compact(counts)

    bins = F.array_join(F.concat(*[nonzero(c) for c in ("red", "green", "blue")]), ",")
    tops = F.transform("basic_metadata.ai_classification.top_predictions", lambda t: F.concat_ws(
        " ", t["label"], F.floor(t["confidence"] * 1e6 + 0.5).cast("string")))
    confidences = F.coalesce(F.array_join(tops, ","), F.lit(""))
    return rounded(full.select(
        "image_id", "file_info.path", "file_info.size_bytes", "advanced_analysis.dimensions.aspect_ratio",
        "basic_metadata.phash", "basic_metadata.ai_classification.is_valid", "advanced_analysis.quality_metrics.*",
        F.col("advanced_analysis.texture.contrast").alias("glcm_contrast"), "advanced_analysis.texture.dissimilarity",
        "advanced_analysis.texture.homogeneity", "advanced_analysis.texture.energy", "advanced_analysis.texture.correlation",
        bins.alias("histogram"), "advanced_analysis.nsfw_score", "advanced_analysis.channels", confidences.alias("confidences"),
        F.array_join(F.transform("advanced_analysis.color_analysis.dominant_colors",
                                 lambda c: F.concat_ws(" ", c["r"], c["g"], c["b"])), ",").alias("colors")))
