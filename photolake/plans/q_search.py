"""Similarity search, trainable head and attempt statistics."""

import uuid

from pyspark.sql import functions as F

from photolake.operators import features, models, predictions as pred, ranking, similarity, stats
from photolake.plans.q_images import MEAN_COLOR, tiles
from photolake.plans.q_metadata import BEST, SCORES
from photolake.plans.registry import query, rounded
from photolake.session import ensure_checkpoint_dir
from photolake.sources import images, tables

QUERY_ID = 0  # the vector or image that is searched for
CLASSES = [f"class{i}" for i in range(10)]

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("semantic_search", sql=f"""
SELECT vec_id, round(s,9) AS similarity FROM (SELECT a.vec_id, {COSINE} AS s FROM embeddings a
 JOIN embeddings b ON b.vec_id={QUERY_ID}) ORDER BY s DESC, vec_id LIMIT 100""")
def semantic_search(spark, d):
    emb = tables.table(spark, d, "embeddings")
    vector = emb.where(F.col("vec_id") == QUERY_ID).first()["embedding"]  # the query itself: one vector
    return rounded(similarity.semantic_search(emb, vector), 9)


@query("batch_neighbors", sql=f"""
SELECT a.vec_id AS query_id, b.vec_id, round({COSINE},9) AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE},12) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id QUALIFY rank<=10""")
def batch_neighbors(spark, d):
    emb = tables.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(similarity.batch_neighbors(emb, emb, 10), 9)


@query("color_search", views="pix", sql=f"""
WITH {MEAN_COLOR}
SELECT a.image_id, round(sqrt((a.r-q.r)**2+(a.g-q.g)**2+(a.b-q.b)**2),6) AS distance FROM mean_color a
JOIN mean_color q ON q.image_id={QUERY_ID} ORDER BY distance, a.image_id LIMIT 100""")
def color_search(spark, d):
    own = tables.raw_images(spark, d).where(F.col("image_id") == QUERY_ID)  # decoded alone
    q = features.mean_color(images.image_tiles(own)).first()  # the query: one colour
    return rounded(similarity.color_search(features.mean_color(tiles(spark, d)), (q["r"], q["g"], q["b"])))


@query("style_search", views="predictions", sql=f"""
WITH {BEST} SELECT image_id, round(confidence,6) AS confidence FROM best WHERE label='sketch' ORDER BY image_id LIMIT 100""")
def style_search(spark, d):
    return rounded(similarity.style_search(tables.predictions(spark, d), "sketch"))


# --- trainable head -------------------------------------------------------------------------

def labelled(spark, d):
    """Embeddings with class and stratified part."""
    items = tables.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding", F.col("label").alias("class_index"),
        F.concat(F.lit("class"), "label").alias("label"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("path"))
    return ranking.stratified_split(items)


#: A short run, so that SQL can repeat it.
TRAIN = {"epochs": 5, "patience": 2, "rate": 40.0}


def head(spark, d):
    return models.train_head(labelled(spark, d), len(CLASSES), **TRAIN)


def _training_sql() -> str:
    """Weights of every epoch, the validation losses, and the epoch whose weights are kept."""
    epochs, n = TRAIN["epochs"], len(CLASSES)
    parts = [f"""items AS (SELECT vec_id AS image_id, label AS y, embedding, CASE WHEN row_number() OVER (PARTITION BY label
  ORDER BY lpad(vec_id::VARCHAR, 12, '0')) <= floor(0.2::DOUBLE*count(*) OVER (PARTITION BY label)) THEN 'validation' ELSE 'training' END AS part
  FROM embeddings)""",
             """x AS MATERIALIZED (SELECT image_id, y, part, unnest(range(0, len(embedding)+1)) AS d, unnest(list_append(list_transform(embedding,
  lambda z: floor(z::DOUBLE*1e6+0.5)::BIGINT), 1000000)) AS v FROM items)""",
             f"w0 AS (SELECT k, d, 0::BIGINT AS w FROM range(0,{n}) a(k), (SELECT DISTINCT d FROM x))"]
    scores = """SELECT image_id, y, part, k, e/sum(e) OVER (PARTITION BY image_id) AS p FROM (
  SELECT *, exp(l-max(l) OVER (PARTITION BY image_id)) AS e FROM (
   SELECT image_id, any_value(y) AS y, any_value(part) AS part, k, sum(v*w)::DOUBLE/1e15 AS l FROM x JOIN {0} USING (d) GROUP BY image_id, k))"""
    for i in range(epochs + 1):
        parts.append(f"p{i} AS MATERIALIZED ({scores.format(f'w{i}')})")
        if i < epochs:
            parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT k, d, (w-{round(TRAIN['rate'] * 1000)}*g//(1000000*n))::BIGINT AS w FROM w{i} JOIN (
  SELECT k, d, count(*)::HUGEINT AS n, sum((floor(p*1e6+0.5)::BIGINT-CASE WHEN x.y=k THEN 1000000 ELSE 0 END)::HUGEINT*v) AS g
  FROM p{i} JOIN x USING (image_id) WHERE x.part='training' GROUP BY k, d) USING (k, d))""")
    losses = " UNION ALL ".join(f"SELECT {i} AS e, sum(floor(-ln(greatest(p,1e-7))*1e6+0.5)::BIGINT)/count(*) AS loss FROM p{i} "
                                "WHERE part='validation' AND y=k" for i in range(1, epochs + 1))
    parts += [f"losses AS MATERIALIZED ({losses})",
              "upto AS (SELECT a.e, arg_min(b.e, (b.loss, b.e)) AS best FROM losses a JOIN losses b ON b.e<=a.e GROUP BY a.e)",
              f"""kept AS MATERIALIZED (SELECT best FROM upto
  WHERE e=(SELECT coalesce(min(e) FILTER (e-best>={TRAIN['patience']}), max(e)) FROM upto))""",
              "weights AS (" + " UNION ALL ".join(f"SELECT k, d, w FROM w{i} WHERE (SELECT best FROM kept)={i}" for i in range(1, epochs + 1)) + ")",
              f"scored AS MATERIALIZED ({scores.format('weights')})",
              "top AS (SELECT image_id, part, y, 'class'||k AS label, p, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, 'class'||k) AS rank FROM scored)"]
    return ",\n".join(parts)


TRAINING = _training_sql()


@query("train_head", sql=f"""
WITH {TRAINING}
SELECT CAST(k AS INT) AS class_index, round(max(w) FILTER (d=64)/1e9,6) AS intercept, round(min(w) FILTER (d<64)/1e9,6) AS min_weight,
 round(max(w) FILTER (d<64)/1e9,6) AS max_weight, CAST((SELECT best FROM kept) AS INT) AS best_epoch,
 round((SELECT loss FROM losses WHERE e=(SELECT best FROM kept))/1e6,6) AS validation_loss FROM weights GROUP BY k""")
def train_head(spark, d):
    """Intercept, smallest and largest weight per class of the fitted head, and the epoch that was kept."""
    model = head(spark, d)
    bias = len(model.weights[0]) - 1
    table = models.model_table(spark, model).groupBy("class_index").agg(
        (F.max(F.when(F.col("dim") == bias, F.col("weight"))) / models.WEIGHT).alias("intercept"),
        (F.min(F.when(F.col("dim") < bias, F.col("weight"))) / models.WEIGHT).alias("min_weight"),
        (F.max(F.when(F.col("dim") < bias, F.col("weight"))) / models.WEIGHT).alias("max_weight"))
    return rounded(table.withColumn("best_epoch", F.lit(model.best_epoch)).withColumn(
        "validation_loss", F.lit(model.losses[model.best_epoch - 1])))


@query("predict_batch", sql=f"""
WITH {TRAINING} SELECT image_id, label, round(p,6) AS confidence, rank, p>=0.2 AS is_confident FROM top WHERE rank<=3""")
def predict_batch(spark, d):
    scored = models.predict_batch(head(spark, d), labelled(spark, d).drop("label"), CLASSES, 0.2)
    return rounded(pred.top_predictions(scored.drop("is_confident"), 3, 0.2))


@query("evaluate_model", sql=f"""
WITH {TRAINING}, cls AS (SELECT unnest({CLASSES}) AS c),
best AS (SELECT 'class'||y AS true_label, label FROM top WHERE rank=1 AND part='validation'),
matrix AS (SELECT t.c AS true_label, p.c AS predicted, count(best.label) AS n FROM cls t CROSS JOIN cls p
 LEFT JOIN best ON best.true_label=t.c AND best.label=p.c GROUP BY 1, 2),
{SCORES} SELECT label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, CAST(support AS BIGINT) AS support FROM rep""")
def evaluate_model(spark, d):
    held = labelled(spark, d).where("part = 'validation'").withColumnRenamed("label", "true_label")
    scored = models.predict_batch(head(spark, d), held, CLASSES, keys=("image_id", "true_label"))
    return rounded(pred.classification_report(pred.confusion_matrix(pred.best_label(scored), CLASSES)))


@query("save_load_model", sql=f"""
WITH {TRAINING} SELECT image_id, label AS original, label AS reloaded FROM top WHERE rank=1""")
def save_load_model(spark, d):
    """Predictions of the reloaded head next to those of the original."""
    model, path = head(spark, d), f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(spark, model, path)

    def best(m, name):
        scored = models.predict_batch(m, labelled(spark, d).drop("label"), CLASSES)
        return pred.best_label(scored).select("image_id", F.col("label").alias(name))

    return best(model, "original").join(best(models.load_model(spark, path), "reloaded"), "image_id")


# --- attempt log ----------------------------------------------------------------------------

_RATE = """count(*) AS total_attempts, count(*) FILTER (outcome='success') AS successful_downloads,
 count(*) FILTER (outcome='failed') AS failed_downloads,
 count(*) FILTER (outcome='skipped_duplicate') AS skipped_duplicates,
 round(100.0::DOUBLE*count(*) FILTER (outcome='success')/count(*),6) AS success_rate"""


@query("download_stats", views="attempts", sql=f"SELECT {_RATE} FROM attempts")
def download_stats(spark, d):
    return rounded(stats.download_stats(tables.attempts(spark, d)))


@query("batch_stats", views="attempts", sql=f"""
SELECT attempt_id//20 AS batch, {_RATE}, count(*)-count(*) FILTER (outcome='success') AS skipped_images
FROM attempts GROUP BY 1""")
def batch_stats(spark, d):
    return rounded(stats.batch_stats(tables.attempts(spark, d)))


@query("rate_limit_flag", views="attempts", sql="""
SELECT attempt_id//20 AS batch, count(*) AS n, count(*) FILTER (outcome='failed') AS n_failed,
 count(*) FILTER (outcome='failed')>count(*)//2 AS rate_limited FROM attempts GROUP BY 1""")
def rate_limit_flag(spark, d):
    return stats.rate_limit_flag(tables.attempts(spark, d))


@query("failure_log", views="attempts", sql="""
SELECT url, count(*) AS n_failures, arg_max(error_type, (ts, attempt_id)) AS last_error, max(ts) AS last_ts
FROM attempts WHERE outcome='failed' GROUP BY 1""")
def failure_log(spark, d):
    return stats.failure_log(tables.attempts(spark, d))


@query("failures_by_type", views="attempts", sql="""
SELECT error_type, count(*) AS n_failures, max(ts) AS last_ts FROM attempts WHERE outcome='failed' GROUP BY 1""")
def failures_by_type(spark, d):
    return stats.failures_by_type(tables.attempts(spark, d))


@query("retry_cost", views="attempts", sql="""
SELECT url, count(*) AS n_attempts, sum(least(pow(2.0::DOUBLE,attempt),30.0::DOUBLE)) AS wait_seconds
FROM attempts GROUP BY 1""")
def retry_cost(spark, d):
    return stats.retry_cost(tables.attempts(spark, d))
