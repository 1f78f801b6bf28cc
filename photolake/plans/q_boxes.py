"""Box, crop and duplicate queries."""

from pyspark.sql import functions as F

from photolake.operators import boxes as bx, hashing, raster
from photolake.plans.q_images import tiles
from photolake.plans.registry import query, rounded
from photolake.sources import tables

IOU = """(greatest(0,least({0}.x+{0}.w,{1}.x+{1}.w)-greatest({0}.x,{1}.x))*greatest(0,least({0}.y+{0}.h,{1}.y+{1}.h)-greatest({0}.y,{1}.y)))
 /({0}.w*{0}.h+{1}.w*{1}.h-greatest(0,least({0}.x+{0}.w,{1}.x+{1}.w)-greatest({0}.x,{1}.x))*greatest(0,least({0}.y+{0}.h,{1}.y+{1}.h)-greatest({0}.y,{1}.y)))::DOUBLE"""
SCORE = "least(1.0::DOUBLE, w*h/90000.0::DOUBLE)*(1.0-abs(w/h::DOUBLE-1.0))"


@query("detection_filter", views="boxes", sql="""
SELECT image_id, box_id, x, y, w, h, confidence, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS rank
FROM boxes WHERE confidence>0.5 AND w BETWEEN 30 AND 300 AND h BETWEEN 30 AND 300 QUALIFY rank<=10""")
def detection_filter(spark, d):
    return bx.detection_filter(tables.boxes(spark, d)).drop("method", "eyes")


@query("box_rank", views="boxes", sql=f"""
SELECT image_id, box_id, round({SCORE},9) AS score,
 row_number() OVER (PARTITION BY image_id ORDER BY {SCORE} DESC, box_id) AS rank FROM boxes""")
def box_rank(spark, d):
    return rounded(bx.box_rank(tables.boxes(spark, d)).select("image_id", "box_id", "score", "rank"), 9)


def _nms_sql(rounds: int = 5) -> str:
    """One CTE per round: drop boxes near a kept one, then keep each image's best."""
    parts = [f"s AS (SELECT *, {SCORE} AS score FROM boxes)"]
    for i in range(1, rounds + 1):
        kept = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(1, i))
        alive = "s" if i == 1 else f"""(SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM ({kept}) k
            WHERE k.image_id=s.image_id AND (k.box_id=s.box_id OR {IOU.format('s', 'k')}>0.3)))"""
        parts.append(f"""k{i} AS MATERIALIZED (SELECT *, {i} AS rank FROM {alive}
            QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id)=1)""")
    union = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(1, rounds + 1))
    return "WITH " + ",\n".join(parts) + f"""
        SELECT image_id, rank, box_id, x, y, w, h, round(score,9) AS score FROM ({union})"""


@query("box_nms", views="boxes", sql=_nms_sql())
def box_nms(spark, d):
    return rounded(bx.box_nms(tables.boxes(spark, d)), 9)


@query("iou_pairs", views="boxes", sql=f"""
WITH r AS (SELECT image_id, x, y, w, h, min(box_id) AS box_id FROM boxes GROUP BY ALL)
SELECT a.image_id, a.box_id AS box_1, b.box_id AS box_2, round({IOU.format('a', 'b')},9) AS iou
FROM r a JOIN r b ON a.image_id=b.image_id AND a.box_id<b.box_id WHERE {IOU.format('a', 'b')}>0.3
UNION ALL SELECT b.image_id, r.box_id, b.box_id, 1.0 FROM boxes b JOIN r USING (image_id, x, y, w, h)
WHERE b.box_id<>r.box_id""")
def iou_pairs(spark, d):
    return rounded(bx.iou_pairs(tables.boxes(spark, d)), 9)


@query("combine_detections", views="boxes", sql="""
SELECT image_id, box_id, method FROM boxes WHERE method IN ('cascade','dnn') UNION ALL
SELECT image_id, box_id, method FROM boxes WHERE method='haar'
 AND image_id NOT IN (SELECT image_id FROM boxes WHERE method IN ('cascade','dnn'))""")
def combine_detections(spark, d):
    return bx.combine_detections(tables.boxes(spark, d)).select("image_id", "box_id", "method")


@query("detection_metrics", views="boxes images", sql="""
SELECT format, CASE WHEN width*height>=900 THEN 'large' WHEN width*height>=600 THEN 'medium' ELSE 'small' END
 AS size_class, count(*) AS n_images, CAST(sum(coalesce(n,0)) AS BIGINT) AS n_boxes,
 count(*) FILTER (coalesce(n,0)>0) AS n_with_boxes
FROM images LEFT JOIN (SELECT image_id, count(*) AS n FROM boxes GROUP BY 1) USING (image_id) GROUP BY 1, 2""")
def detection_metrics(spark, d):
    return bx.detection_metrics(tables.boxes(spark, d), tables.images(spark, d), large=900, medium=600)


# --- crops ----------------------------------------------------------------------------------

ROI = """roi AS MATERIALIZED (SELECT b.image_id, b.box_id, eyes, b.x AS bx, b.y AS by_, p.y, p.x, p.gray, p.r, p.g, p.b FROM {0} b
 JOIN pix p ON p.image_id=b.image_id AND p.x>=b.x AND p.x<b.x+b.w AND p.y>=b.y AND p.y<b.y+b.h)"""
ROI_STENCIL = """roi_s AS (SELECT *, rs-ls AS gx, dt-ut AS gy FROM (
 SELECT *, coalesce(lag(s) OVER cx, lead(s) OVER cx, s) AS ls, coalesce(lead(s) OVER cx, lag(s) OVER cx, s) AS rs,
  coalesce(lag(t) OVER cy, lead(t) OVER cy, t) AS ut, coalesce(lead(t) OVER cy, lag(t) OVER cy, t) AS dt FROM (
  SELECT *, u+d+l+rt-4*gray AS lap, u+2*gray+d AS s, l+2*gray+rt AS t FROM (
   SELECT *, coalesce(lag(gray) OVER wx, lead(gray) OVER wx, gray) AS l,
    coalesce(lead(gray) OVER wx, lag(gray) OVER wx, gray) AS rt,
    coalesce(lag(gray) OVER wy, lead(gray) OVER wy, gray) AS u,
    coalesce(lead(gray) OVER wy, lag(gray) OVER wy, gray) AS d
   FROM roi WINDOW wx AS (PARTITION BY image_id, box_id, y ORDER BY x), wy AS (PARTITION BY image_id, box_id, x ORDER BY y)))
  WINDOW cx AS (PARTITION BY image_id, box_id, y ORDER BY x), cy AS (PARTITION BY image_id, box_id, x ORDER BY y))),
tone AS (SELECT image_id, box_id, any_value(eyes) AS eyes, avg(gray) AS brightness, stddev_pop(gray) AS contrast,
 var_pop(lap) AS sharpness, avg(sqrt(gx*gx+gy*gy)) AS magnitude,
 avg(CASE WHEN atan2(gy,gx)<0 THEN atan2(gy,gx)+2*pi() ELSE atan2(gy,gx) END) AS angle FROM roi_s GROUP BY 1, 2)"""
FACE_QUALITY = """greatest(0.0::DOUBLE, least(1.0::DOUBLE,
 1.0/(1.0+contrast)*(sharpness/100.0)*CASE WHEN eyes>0 THEN 1.0 ELSE 0.5 END))"""
EQUALISED = """hist AS (SELECT image_id, box_id, gray, count(*)::BIGINT AS cnt FROM roi GROUP BY ALL),
cdf AS (SELECT *, sum(cnt) OVER o AS up, first_value(cnt) OVER o AS low, sum(cnt) OVER i AS total FROM hist
 WINDOW o AS (PARTITION BY image_id, box_id ORDER BY gray), i AS (PARTITION BY image_id, box_id)),
eq AS (SELECT image_id, box_id, CASE WHEN total=low THEN gray ELSE (510*(up-low)+total-low)//(2*(total-low)) END::BIGINT AS v,
 cnt FROM cdf),
eqc AS (SELECT image_id, box_id, v, sum(cnt)::BIGINT AS cnt FROM eq GROUP BY ALL),
eqp AS (SELECT *, cnt/sum(cnt) OVER (PARTITION BY image_id, box_id) AS p FROM eqc),
top AS (SELECT image_id, box_id, color FROM (SELECT image_id, box_id, r//16*256+g//16*16+b//16 AS color, count(*) AS c
 FROM roi GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id, box_id ORDER BY c DESC, color)=1),
feat AS (SELECT image_id, box_id, sum(v*cnt)/sum(cnt) AS mean_intensity,
 sqrt((sum(cnt)*sum(v*v*cnt)-sum(v*cnt)*sum(v*cnt))/(sum(cnt)*sum(cnt))) AS std_intensity, -sum(p*ln(p)) AS entropy
 FROM eqp GROUP BY 1, 2)"""


def crops(spark, d, halo=True):
    return raster.roi_tiles(tables.boxes(spark, d), tables.raw_images(spark, d), halo=halo)


@query("roi_pixels", views="boxes pix", sql=f"""
WITH {ROI.format('boxes')} SELECT image_id, box_id, y, x, gray FROM roi""")
def roi_pixels(spark, d):
    return raster.roi_pixels(tables.boxes(spark, d), tables.raw_images(spark, d))


@query("face_orientation", views="boxes pix", sql=f"""
WITH {ROI.format('boxes')}, {ROI_STENCIL}
SELECT image_id, box_id, round(angle,6) AS dominant_angle, round(magnitude,6) AS gradient_magnitude FROM tone""")
def face_orientation(spark, d):
    return rounded(bx.face_orientation(crops(spark, d)))


@query("face_quality", views="boxes pix", sql=f"""
WITH {ROI.format('boxes')}, {ROI_STENCIL} SELECT image_id, box_id, round({FACE_QUALITY},6) AS quality FROM tone""")
def face_quality(spark, d):
    return rounded(bx.face_quality(crops(spark, d)))


@query("face_features", views="boxes pix", sql=f"""
WITH {ROI.format('boxes')}, {EQUALISED}
SELECT image_id, box_id, round(mean_intensity,6) AS mean_intensity, round(std_intensity,6) AS std_intensity,
 round(entropy,6)+0.0 AS entropy, CAST(color AS BIGINT) AS top_color FROM feat JOIN top USING (image_id, box_id)""")
def face_features(spark, d):
    return rounded(bx.face_features(crops(spark, d, halo=False)))


@query("face_details", views="boxes pix", sql=f"""
WITH fb AS (SELECT * FROM boxes WHERE confidence>0.5 AND w BETWEEN 30 AND 300 AND h BETWEEN 30 AND 300
 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY box_id)<=10),
{ROI.format('fb')}, {ROI_STENCIL}, {EQUALISED},
loc AS (SELECT image_id, box_id, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h FROM roi GROUP BY 1, 2)
SELECT image_id, box_id, CAST(count(*) OVER i AS INT) AS face_count,
 string_agg(concat(x,' ',y,' ',w,' ',h), ',' ORDER BY box_id) OVER i AS face_locations,
 CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h,
 round(brightness,6) AS brightness, round(contrast,6) AS contrast, eyes AS eyes_count,
 round({FACE_QUALITY},6) AS quality_score, round(mean_intensity,6) AS mean_intensity,
 round(std_intensity,6) AS std_intensity, round(entropy,6)+0.0 AS entropy, CAST(color AS BIGINT) AS top_color,
 round(angle,6) AS dominant_angle, round(magnitude,6) AS gradient_magnitude
FROM tone JOIN feat USING (image_id, box_id) JOIN top USING (image_id, box_id) JOIN loc USING (image_id, box_id)
WINDOW i AS (PARTITION BY image_id)""")
def face_details(spark, d):
    full = bx.face_details(tables.boxes(spark, d), tables.raw_images(spark, d))
    places = F.array_join(F.transform("face_locations", lambda p: F.concat_ws(" ", p["x"], p["y"], p["w"], p["h"])), ",")
    return rounded(full.select("image_id", "box_id", "face_count", places.alias("face_locations"), "location.*", "brightness", "contrast", "eyes_count",
                               "quality_score", "features.*", "orientation.*"))


# --- hashes and duplicates ------------------------------------------------------------------

PHASH = """basis AS (SELECT f, p, CAST(round(cos(pi()*f*(2*p+1)/64.0::DOUBLE)*16384) AS BIGINT) AS c FROM range(0,8) a(f), range(0,32) b(p)),
-- weight of each place of an axis of n pixels: cosine of each of 32 cells times the overlap with it
axis AS MATERIALIZED (SELECT n, y, f, sum(c*greatest(0, least((p+1)*n,(y+1)*32)-greatest(p*n,y*32)))::BIGINT AS a FROM (
  SELECT n, unnest(range(0,n)) AS y FROM (SELECT DISTINCT width AS n FROM pix UNION SELECT DISTINCT height FROM pix)), basis GROUP BY ALL),
rw AS (SELECT image_id, height, pix.y, f AS u, sum(gray*a)::HUGEINT AS s FROM pix JOIN axis ON n=width AND axis.y=x GROUP BY ALL),
cf AS (SELECT image_id, f AS k, u, sum(s*a)::HUGEINT AS c FROM rw JOIN axis ON n=height AND axis.y=rw.y GROUP BY ALL),
m AS (SELECT image_id, list_sort(list(c)) AS l FROM cf GROUP BY 1),
ph AS (SELECT image_id, CAST(sum(CASE WHEN NOT 2*c>l[32]+l[33] THEN 0::HUGEINT WHEN k*8+u=0 THEN -(1::HUGEINT << 63)
 ELSE 1::HUGEINT << (63-(k*8+u))::INT END) AS BIGINT) AS h FROM cf JOIN m USING (image_id) GROUP BY 1)"""


@query("phash", views="pix", sql=f"WITH {PHASH} SELECT image_id, h FROM ph")
def phash(spark, d):
    return hashing.phash(tiles(spark, d))


@query("median_hash", views="gray8", sql="""
WITH m AS (SELECT image_id, median(gray) AS mid FROM gray8 GROUP BY 1)
SELECT image_id, CAST(sum(CASE WHEN NOT gray>mid THEN 0::HUGEINT WHEN y*8+x=0 THEN -(1::HUGEINT << 63)
 ELSE 1::HUGEINT << (63-(y*8+x))::INT END) AS BIGINT) AS h FROM gray8 JOIN m USING (image_id) GROUP BY 1""")
def median_hash(spark, d):
    return hashing.median_hash(tables.gray_rasters(spark, d))


REPS = "rep AS MATERIALIZED (SELECT h, min(image_id) AS id FROM hashes GROUP BY 1)"


@query("hash_similarity_join", views="hashes", sql=f"""
WITH {REPS}
SELECT least(a.id,b.id) AS image_1, greatest(a.id,b.id) AS image_2, CAST(bit_count(xor(a.h,b.h)) AS INT) AS hamming
FROM rep a JOIN rep b ON a.h<b.h AND bit_count(xor(a.h,b.h))<=6
UNION ALL SELECT id, image_id, 0 FROM hashes JOIN rep USING (h) WHERE image_id<>id""")
def hash_similarity_join(spark, d):
    return hashing.hash_similarity_join(tables.hashes(spark, d))


@query("existing_duplicates", views="hashes", sql="""
SELECT image_id FROM hashes a WHERE image_id>=1000000000 AND EXISTS (
 SELECT 1 FROM hashes b WHERE b.image_id<1000000000 AND bit_count(xor(a.h,b.h))<=5)""")
def existing_duplicates(spark, d):
    h = tables.hashes(spark, d)
    first_copy = 1_000_000_000  # the planted copies are the incoming images
    return hashing.existing_duplicates(h.where(F.col("image_id") >= first_copy),
                                       h.where(F.col("image_id") < first_copy)).select("image_id")


@query("duplicate_groups", views="hashes", sql=f"""
WITH RECURSIVE {REPS},
e AS MATERIALIZED (SELECT a.id AS lo, b.id AS hi FROM rep a JOIN rep b ON a.id<b.id AND bit_count(xor(a.h,b.h))<=6),
-- visit hashes in id order; state = leaders so far, as a list
o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM rep),
nb AS MATERIALIZED (SELECT o.id, n, list(lo) FILTER (lo IS NOT NULL) AS smaller FROM o LEFT JOIN e ON e.hi=o.id GROUP BY 1, 2),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders UNION ALL
 SELECT nb.n, CASE WHEN smaller IS NOT NULL AND list_has_any(leaders, smaller) THEN leaders
  ELSE list_append(leaders, id) END FROM walk JOIN nb ON nb.n=walk.n+1),
lead AS (SELECT unnest(leaders) AS id FROM walk WHERE n=(SELECT max(n) FROM walk)),
boss AS (SELECT rep.h, rep.id, coalesce(min(lead.id), rep.id) AS leader FROM rep
 LEFT JOIN e ON e.hi=rep.id AND rep.id NOT IN (SELECT id FROM lead) LEFT JOIN lead ON lead.id=e.lo GROUP BY 1, 2)
SELECT leader, image_id, count(*) OVER (PARTITION BY leader) AS n FROM hashes JOIN boss USING (h)
QUALIFY n>1""")
def duplicate_groups(spark, d):
    return hashing.duplicate_groups(tables.hashes(spark, d))


@query("exact_duplicates", sql="""
SELECT min(doc_id) OVER (PARTITION BY text) AS kept, doc_id AS image_id, count(*) OVER (PARTITION BY text) AS n
FROM documents QUALIFY n>1""")
def exact_duplicates(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("content"))
    return hashing.exact_duplicates(docs)
