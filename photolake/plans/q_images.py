"""Raster, colour and texture queries."""

from pyspark.sql import functions as F

from photolake.operators import features, raster, texture
from photolake.plans.registry import query, rounded
from photolake.sources import images, tables


def tiles(spark, d, halo=False, size=None):
    """Tiles of every document image, whole unless ``size`` resamples them."""
    return images.image_tiles(tables.raw_images(spark, d), halo=halo, size=size)


@query("explode_pixels", views="pix", sql="SELECT image_id, y, x, r, g, b, gray FROM pix")
def explode_pixels(spark, d):
    return raster.explode_pixels(tiles(spark, d))


@query("explode_pixels_gray", views="gray8", sql="SELECT image_id, y, x, gray FROM gray8")
def explode_pixels_gray(spark, d):
    return raster.explode_pixels(tables.gray_rasters(spark, d)).select("image_id", "y", "x", "gray")


@query("thumbnail_raster", views="pix", sql="""
WITH s AS (SELECT *, least(1.0::DOUBLE, 24.0::DOUBLE/w, 16.0::DOUBLE/h) AS k FROM pix),
t AS (SELECT *, greatest(1,floor(w*k)::INT) AS tw, greatest(1,floor(h*k)::INT) AS th FROM s)
SELECT image_id, CAST(y*th//h AS INT) AS y, CAST(x*tw//w AS INT) AS x, round(avg(r),6) AS r, round(avg(g),6) AS g,
 round(avg(b),6) AS b FROM t GROUP BY 1, 2, 3""")
def thumbnail_raster(spark, d):
    return rounded(raster.thumbnail_raster(tiles(spark, d), 24, 16))


@query("augment_raster", views="pix", sql="""
WITH v AS (SELECT image_id, 'original' AS variant, y, x, w, h, r, g, b FROM pix
 UNION ALL SELECT image_id, 'flip', y, w-1-x, w, h, r, g, b FROM pix
 UNION ALL SELECT image_id, 'shift', y+1, x+1, w, h, r, g, b FROM pix)
SELECT image_id, variant, y, x, round(r/255.0::DOUBLE,6) AS r, round(g/255.0::DOUBLE,6) AS g,
 round(b/255.0::DOUBLE,6) AS b FROM v WHERE x>=0 AND x<w AND y>=0 AND y<h""")
def augment_raster(spark, d):
    return rounded(raster.augment_raster(tiles(spark, d)))


@query("color_histogram", views="pix", sql="""
SELECT image_id, channel, bin, count(*) AS cnt FROM (
 SELECT image_id, 'r' AS channel, r AS bin FROM pix UNION ALL SELECT image_id, 'g', g FROM pix
 UNION ALL SELECT image_id, 'b', b FROM pix) GROUP BY ALL""")
def color_histogram(spark, d):
    return features.color_histogram(tiles(spark, d))


ENTROPY_NATS = """e_nats AS (SELECT image_id, -sum(p*ln(p)) AS entropy FROM (
 SELECT image_id, cnt/sum(cnt) OVER (PARTITION BY image_id) AS p FROM (
  SELECT image_id, bin, count(*) AS cnt FROM (SELECT image_id,
   CASE WHEN hi>lo THEN least((s-lo)*256//(hi-lo),255) ELSE 0 END AS bin FROM (
    SELECT image_id, r+g+b AS s, min(r+g+b) OVER i AS lo, max(r+g+b) OVER i AS hi FROM pix
    WINDOW i AS (PARTITION BY image_id))) GROUP BY ALL)) GROUP BY 1)"""
ENTROPY_BITS = """e_bits AS (SELECT image_id, -sum(p*log2(p)) AS entropy FROM (
 SELECT image_id, cnt/sum(cnt) OVER (PARTITION BY image_id) AS p FROM (
  SELECT image_id, gray, count(*) AS cnt FROM pix GROUP BY ALL)) GROUP BY 1)"""
JOINT = """joint AS (SELECT image_id, -sum(p*log2(p+1e-10)) AS entropy FROM (
 SELECT image_id, cnt/sum(cnt) OVER (PARTITION BY image_id) AS p FROM (
  SELECT image_id, rb, gb, bb, count(*) AS cnt FROM (SELECT image_id,
   CASE WHEN r1>r0 THEN least((r-r0)*16//(r1-r0),15) ELSE 0 END AS rb,
   CASE WHEN g1>g0 THEN least((g-g0)*16//(g1-g0),15) ELSE 0 END AS gb,
   CASE WHEN b1>b0 THEN least((b-b0)*16//(b1-b0),15) ELSE 0 END AS bb FROM (
    SELECT image_id, r, g, b, min(r) OVER i AS r0, max(r) OVER i AS r1, min(g) OVER i AS g0, max(g) OVER i AS g1,
     min(b) OVER i AS b0, max(b) OVER i AS b1 FROM pix WINDOW i AS (PARTITION BY image_id))) GROUP BY ALL)) GROUP BY 1)"""
MODE = """mode_color AS (SELECT image_id, packed//65536 AS r, packed//256%256 AS g, packed%256 AS b, cnt FROM (
 SELECT image_id, packed, count(*) AS cnt FROM pix GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, packed)=1)"""
VARIANCE = """variance AS (SELECT image_id, var_pop(v) AS variance FROM (SELECT image_id, r AS v FROM pix
 UNION ALL SELECT image_id, g FROM pix UNION ALL SELECT image_id, b FROM pix) GROUP BY 1)"""
HSV = """hsv AS (SELECT *, CASE WHEN mx=0 THEN 0 ELSE (510*d+mx)//(2*mx) END AS sat,
 CASE WHEN d=0 THEN 0 ELSE ((CASE WHEN mx=r THEN 60*(g-b) WHEN mx=g THEN 60*(b-r)+120*d ELSE 60*(r-g)+240*d END)
  +d+360*d)//(2*d)%180 END AS hue FROM (
 SELECT *, greatest(r,g,b) AS mx, greatest(r,g,b)-least(r,g,b) AS d FROM pix))"""


@query("gray_entropy_nats", views="pix",
       sql=f"WITH {ENTROPY_NATS} SELECT image_id, round(entropy,6)+0.0 AS entropy FROM e_nats")
def gray_entropy_nats(spark, d):
    return rounded(features.gray_entropy_nats(tiles(spark, d)))


@query("gray_entropy_bits", views="pix",
       sql=f"WITH {ENTROPY_BITS} SELECT image_id, round(entropy,6)+0.0 AS entropy FROM e_bits")
def gray_entropy_bits(spark, d):
    return rounded(features.gray_entropy_bits(tiles(spark, d)))


@query("joint_color_entropy", views="pix",
       sql=f"WITH {JOINT} SELECT image_id, round(entropy,6)+0.0 AS entropy FROM joint")
def joint_color_entropy(spark, d):
    return rounded(features.joint_color_entropy(tiles(spark, d)))


@query("color_uniformity", views="pix", sql=f"""
WITH {HSV}
SELECT image_id, round(-sum(cnt*log2(cnt+1e-7))/2,6) AS uniformity FROM (
 SELECT image_id, c, bin, count(*) AS cnt FROM (SELECT image_id, 'h' AS c, hue AS bin FROM hsv
  UNION ALL SELECT image_id, 's', sat FROM hsv) GROUP BY ALL) GROUP BY 1""")
def color_uniformity(spark, d):
    return rounded(features.color_uniformity(tiles(spark, d)))


@query("dominant_color_mode", views="pix", sql=f"""
WITH {MODE} SELECT image_id, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, cnt FROM mode_color""")
def dominant_color_mode(spark, d):
    return features.dominant_color_mode(tiles(spark, d))


MEAN_COLOR = """mean_color AS (SELECT image_id, CAST(sum(r)//count(*) AS INT) AS r, CAST(sum(g)//count(*) AS INT) AS g,
 CAST(sum(b)//count(*) AS INT) AS b FROM pix GROUP BY 1)"""


@query("mean_color", views="pix", sql=f"WITH {MEAN_COLOR} SELECT * FROM mean_color")
def mean_color(spark, d):
    return features.mean_color(tiles(spark, d))


def kmeans_ctes(k: int = 3, rounds: int = 10) -> str:
    """Chained rounds of weighted k-means in exact integers."""
    parts = ["""q AS MATERIALIZED (SELECT image_id, r//16*256+g//16*16+b//16 AS q, count(*)::BIGINT AS cnt
                FROM pix100 GROUP BY ALL)""",
             """col AS MATERIALIZED (SELECT *, (q//256*16+8)::BIGINT AS r, (q//16%16*16+8)::BIGINT AS g,
                (q%16*16+8)::BIGINT AS b, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, q)-1 AS o FROM q)""",
             f"""k0 AS MATERIALIZED (SELECT image_id, o AS c, r*1000000 AS r, g*1000000 AS g, b*1000000 AS b FROM col
                WHERE o<{k})"""]
    for i in range(1, rounds + 1):
        dist = " + ".join(f"(col.{c}*1000000-k.{c})*(col.{c}*1000000-k.{c})" for c in "rgb")
        mean = ", ".join(f"coalesce((sum(col.{c}*cnt)*1000000//sum(cnt))::BIGINT, any_value(k.{c})) AS {c}" for c in "rgb")
        parts.append(f"""n{i} AS MATERIALIZED (SELECT col.image_id, q, k.c FROM col JOIN k{i - 1} k USING (image_id)
            QUALIFY row_number() OVER (PARTITION BY col.image_id, q ORDER BY {dist}, k.c)=1)""")
        parts.append(f"""k{i} AS MATERIALIZED (SELECT k.image_id, k.c, {mean} FROM k{i - 1} k
            LEFT JOIN n{i} n ON n.image_id=k.image_id AND n.c=k.c
            LEFT JOIN col ON col.image_id=n.image_id AND col.q=n.q GROUP BY 1, 2)""")
    parts.append(f"""palette AS (SELECT image_id, CAST(c AS INT) AS cluster, CAST(r//1000000 AS INT) AS r,
        CAST(g//1000000 AS INT) AS g, CAST(b//1000000 AS INT) AS b FROM k{rounds})""")
    return ",\n".join(parts)


@query("palette_kmeans", views="pix100", sql=f"WITH {kmeans_ctes()} SELECT * FROM palette")
def palette_kmeans(spark, d):
    return features.palette_kmeans(tiles(spark, d, size=images.squeezed))


@query("palette_topk", views="pix", sql="""
SELECT image_id, color, cnt, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, color) AS rank FROM (
 SELECT image_id, CAST(r//16*256+g//16*16+b//16 AS BIGINT) AS color, count(*) AS cnt FROM pix GROUP BY ALL)
QUALIFY rank<=5""")
def palette_topk(spark, d):
    return features.palette_topk(tiles(spark, d))


@query("color_variance", views="pix",
       sql=f"WITH {VARIANCE} SELECT image_id, round(variance,6) AS variance FROM variance")
def color_variance(spark, d):
    return rounded(features.color_variance(tiles(spark, d)))


@query("contrast_brightness", views="pix", sql="""
SELECT image_id, round(stddev_pop(gray),6) AS contrast, round(avg(gray),6) AS brightness FROM pix GROUP BY 1""")
def contrast_brightness(spark, d):
    return rounded(features.contrast_brightness(tiles(spark, d)))


@query("skin_ratio_score", views="pix", sql=f"""
WITH {HSV} SELECT image_id, round(least(1.0::DOUBLE,
 2.0*count(*) FILTER (hue<=20 AND sat>=48 AND mx>=80)/count(*)),6) AS score FROM hsv GROUP BY 1""")
def skin_ratio_score(spark, d):
    return rounded(features.skin_ratio_score(tiles(spark, d)))


COLOR_RATIO = """color_ratio AS (SELECT image_id, avg(abs(r-gray)+abs(g-gray)+abs(b-gray))/255.0 AS color_ratio
 FROM pix GROUP BY 1)"""


@query("color_ratio", views="pix",
       sql=f"WITH {COLOR_RATIO} SELECT image_id, round(color_ratio,6) AS color_ratio FROM color_ratio")
def color_ratio(spark, d):
    return rounded(features.color_ratio(tiles(spark, d)))


@query("thirds_composition", views="pix", sql="""
WITH s AS (SELECT *, CASE WHEN h>=3 THEN least(y//(h//3),2) ELSE 2 END*3
  + CASE WHEN w>=3 THEN least(x//(w//3),2) ELSE 2 END AS section FROM pix),
m AS (SELECT image_id, section, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b,
  sum(r+g+b)/(3*count(*)) AS m, any_value(width)/any_value(height) AS ar FROM s GROUP BY 1, 2)
SELECT image_id, CAST(section AS INT) AS section, round(mean_r,6) AS mean_r, round(mean_g,6) AS mean_g,
 round(mean_b,6) AS mean_b, round(ar,6) AS aspect_ratio,
 CAST(first_value(section) OVER (PARTITION BY image_id ORDER BY m DESC, section) AS INT) AS dominant_section FROM m""")
def thirds_composition(spark, d):
    return rounded(features.thirds_composition(tiles(spark, d)))


@query("color_profile", views="pix", sql=f"""
WITH {JOINT}, {MODE}, {VARIANCE},
hc AS (SELECT image_id, c, bin, count(*) AS cnt FROM (SELECT image_id, 'r' AS c, r AS bin FROM pix
 UNION ALL SELECT image_id, 'g', g FROM pix UNION ALL SELECT image_id, 'b', b FROM pix) GROUP BY ALL),
hist AS (SELECT ids.image_id, ids.c, string_agg(coalesce(cnt,0)::VARCHAR, ',' ORDER BY k) AS t
 FROM (SELECT DISTINCT image_id, c, unnest(range(0,256)) AS k FROM hc) ids
 LEFT JOIN hc ON hc.image_id=ids.image_id AND hc.c=ids.c AND hc.bin=ids.k GROUP BY 1, 2)
SELECT image_id, round(j.entropy,6)+0.0 AS color_entropy, round(variance,6) AS color_variance,
 CAST(m.r AS INT) AS r, CAST(m.g AS INT) AS g, CAST(m.b AS INT) AS b,
 max(t) FILTER (c='r') AS hist_r, max(t) FILTER (c='g') AS hist_g, max(t) FILTER (c='b') AS hist_b
FROM joint j JOIN mode_color m USING (image_id) JOIN variance USING (image_id) JOIN hist USING (image_id) GROUP BY ALL""")
def color_profile(spark, d):
    return rounded(features.color_profile(tiles(spark, d)).withColumnRenamed("variance", "color_variance")
                   .withColumns({f"hist_{c}": F.array_join(f"hist_{c}", ",") for c in "rgb"}))


# --- stencils and texture -------------------------------------------------------------------

@query("laplacian", views="stencil", sql="SELECT image_id, y, x, gray AS v, lap FROM stencil")
def laplacian(spark, d):
    return raster.laplacian(tiles(spark, d, halo=True))


@query("sobel", views="stencil", sql="""
SELECT image_id, y, x, gx, gy, round(sqrt(gx*gx+gy*gy),6) AS magnitude,
 round(CASE WHEN atan2(gy,gx)<0 THEN atan2(gy,gx)+2*pi() ELSE atan2(gy,gx) END,6) AS angle FROM stencil""")
def sobel(spark, d):
    return rounded(raster.sobel(tiles(spark, d, halo=True)))


@query("blur_score", views="stencil",
       sql="SELECT image_id, round(var_pop(lap),6) AS blur_score FROM stencil GROUP BY 1")
def blur_score(spark, d):
    return rounded(texture.blur_score(tiles(spark, d, halo=True)))


@query("quality_basic", views="stencil", sql="""
SELECT image_id, round(var_pop(lap),6) AS sharpness, round(avg(sqrt(gx*gx+gy*gy)),6) AS edge_density,
 max(gray)-min(gray) AS dynamic_range FROM stencil GROUP BY 1""")
def quality_basic(spark, d):
    return rounded(texture.quality_basic(tiles(spark, d, halo=True)))


QUALITY = """quality AS (SELECT image_id, least(var_pop(lap)/1000.0,1.0::DOUBLE) AS sharpness_score,
  1.0-abs(avg(gray)/255.0-0.5)*2 AS brightness_score, 1.0-stddev_pop(gray)/255.0 AS noise_score
 FROM stencil GROUP BY 1)"""


@query("quality_score", views="stencil", sql=f"""
WITH {QUALITY} SELECT image_id, round(sharpness_score,6) AS sharpness_score,
 round(brightness_score,6) AS brightness_score, round(noise_score,6) AS noise_score,
 round((sharpness_score+brightness_score+noise_score)/3,6) AS quality FROM quality""")
def quality_score(spark, d):
    return rounded(texture.quality_score(tiles(spark, d, halo=True, size=images.lowered)))


GLCM = """pairs AS (
 SELECT a.image_id, '0' AS angle, a.gray AS i, b.gray AS j FROM pix a JOIN pix b
  ON a.image_id=b.image_id AND b.y=a.y AND b.x=a.x+1
 UNION ALL SELECT a.image_id, '45', a.gray, b.gray FROM pix a JOIN pix b
  ON a.image_id=b.image_id AND b.y=a.y+1 AND b.x=a.x+1
 UNION ALL SELECT a.image_id, '90', a.gray, b.gray FROM pix a JOIN pix b
  ON a.image_id=b.image_id AND b.y=a.y+1 AND b.x=a.x
 UNION ALL SELECT a.image_id, '135', a.gray, b.gray FROM pix a JOIN pix b
  ON a.image_id=b.image_id AND b.y=a.y+1 AND b.x=a.x-1),
glcm AS (SELECT image_id, angle, i, j, c/sum(c) OVER (PARTITION BY image_id, angle) AS p
 FROM (SELECT image_id, angle, i, j, count(*) AS c
  FROM (SELECT * FROM pairs UNION ALL SELECT image_id, angle, j, i FROM pairs) GROUP BY ALL))"""


@query("glcm", views="pix", sql=f"WITH {GLCM} SELECT image_id, angle, i, j, round(p,9) AS p FROM glcm")
def glcm(spark, d):
    return rounded(texture.glcm(tiles(spark, d, halo=True)), 9)


@query("glcm_features", views="pix", sql=f"""
WITH {GLCM},
s AS (SELECT image_id, sum(p*(i-j)*(i-j)) AS contrast, sum(p*abs(i-j)) AS dissimilarity,
  sum(p/(1+(i-j)*(i-j))) AS homogeneity, sqrt(sum(p*p)) AS energy, sum(p*i) AS m FROM glcm WHERE angle='0' GROUP BY 1),
c AS (SELECT image_id, sum(p*(i-m)*(j-m)) AS cov, sum(p*(i-m)*(i-m)) AS var FROM glcm JOIN s USING (image_id)
  WHERE angle='0' GROUP BY 1)
SELECT image_id, round(contrast,6) AS contrast, round(dissimilarity,6) AS dissimilarity,
 round(homogeneity,6) AS homogeneity, round(energy,6) AS energy,
 round(CASE WHEN var>1e-9 THEN cov/var ELSE 1.0 END,6) AS correlation FROM s JOIN c USING (image_id)""")
def glcm_features(spark, d):
    return rounded(texture.glcm_features(texture.glcm(tiles(spark, d, halo=True), angles=("0",))))


@query("edge_orientation_hist", views="stencil", sql="""
SELECT image_id, CAST(least(floor(a/(pi()/8)),7) AS INT) AS bin, count(*) AS cnt
FROM (SELECT image_id, atan2(gy,gx) AS a FROM stencil WHERE gy>=0) GROUP BY ALL""")
def edge_orientation_hist(spark, d):
    return texture.edge_orientation_hist(tiles(spark, d, halo=True))
