"""Language identification by fusion of evidence.

log posterior(l) = log prior(l | host) + text evidence(l) + log P(declared | l) + log P(suffix | l).

* Text: naive Bayes over byte trigrams, hashed to BUCKETS cells. Cell counts per declared language come from one
  grouped aggregation over all texts. As trigrams overlap, the evidence of a text of any length is scaled to that of
  at most EVIDENCE independent trigrams.
* Declared markup language and address suffix: tables P(value | language) counted over all documents against the
  language that their text alone suggests, smoothed.
* Other languages: one more class, under which all trigrams are alike. A text in one of the languages, or in several of them
  by turns, is likelier under its best language; one in none of them is mostly made of trigrams that are rare in each.
* Host prior: counts of text languages per host, smoothed towards the registered domain, that towards the suffix, that
  towards all documents. Every level is a grouped aggregation; documents get their host's row by a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import text_batches, written
from photolake.llm.words import slices, utf8

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 8192
EVIDENCE = 60
#: Documents' worth of the parent's distribution in a host's, domain's or suffix's.
STRENGTH = 20.0
MIN_POSTERIOR = 0.5
OTHER = "other"
#: Least prior of the class of other languages on any host.
OTHER_PRIOR = 0.01

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each trigram with a letter, and the n + 1 places where texts begin in that list."""
    raw, bounds = utf8(texts)
    b = _FOLD[raw]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    good = (b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)
    for cut in bounds[1:-1]:  # none over the end of a text
        good[max(cut - 2, 0):cut] = False
    upto = np.concatenate([[0], np.cumsum(good)])
    cells = (h[good] >> np.uint32(19)).astype(np.int64)
    return cells, upto[np.minimum(bounds, len(good))]


def trigram_counts(texts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(declared, text) -> (language, cell, n) over all texts declared to be in one of ``languages``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            index = np.asarray([languages.index(x) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for first, part in slices(batch.column(1)):
                cells, bounds = _cells(part)
                lang = np.repeat(index[first:first + len(part)], np.diff(bounds))
                total += np.bincount(lang * BUCKETS + cells, minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[lang, cell], pa.int64())],
            names=["language", "cell", "n"])

    text_batches(texts.sparkSession)
    known = texts.where(F.col("declared").isin(list(languages)) & F.col("text").isNotNull()).select("declared", "text")
    return (known.mapInArrow(count, "language int, cell int, n long")
            .groupBy("language", "cell").agg(F.sum("n").alias("n")))


def trigram_model(texts: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """log P(cell | language), add-one smoothed, and the uniform model last. At most languages x BUCKETS numbers reach the driver."""
    counts = np.ones((len(languages) + 1, BUCKETS))
    for row in trigram_counts(texts, languages).collect():
        counts[row.language, row.cell] += row.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(texts: DataFrame, model: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, n_grams and the scaled log likelihood of each language."""
    names = [*keep, "n_grams", "evidence"]
    n_langs = len(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(len(keep))):
                cells, bounds = _cells(part)
                sizes = np.diff(bounds)
                out = np.zeros((len(part), n_langs))
                for k in range(n_langs):
                    upto = np.concatenate([[0.0], np.cumsum(model[k][cells], dtype=np.float64)])
                    out[:, k] = upto[bounds[1:]] - upto[bounds[:-1]]
                out *= (np.minimum(sizes, EVIDENCE) / np.maximum(sizes, 1))[:, None]
                out = np.round(out, 6)
                own = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [own.column(i) for i in range(len(keep))] + [
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * n_langs, pa.int32()),
                                                 pa.array(out.reshape(-1)))], names=names)

    text_batches(texts.sparkSession)
    source = texts.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(score, f"{schema}, n_grams long, evidence array<double>")


def _host_parts(df: DataFrame) -> DataFrame:
    labels = "split(host, '[.]')"
    return df.withColumn("suffix", F.expr(f"CASE WHEN host LIKE '%.%' THEN element_at({labels}, -1) END")).withColumn(
        "domain", F.expr(f"CASE WHEN host LIKE '%.%' THEN array_join(slice({labels}, -2, 2), '.') ELSE host END"))


def _counted(scores: DataFrame, by: str, n_langs: int) -> DataFrame:
    """(by, counts array) of text languages; nulls of ``by`` are left out."""
    counts = F.array(*[F.count_if(F.col("text_language") == k).cast("double") for k in range(n_langs)])
    return scores.where(F.col(by).isNotNull()).groupBy(by).agg(counts.alias(f"n_{by}"))


def identify(texts: DataFrame, languages: Sequence[str] = LANGUAGES, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(id, text, declared, host) -> one row per row: id, language, posterior, text_language, n_grams, accepted.

    ``declared`` and ``host`` may be null (no evidence) or unknown values. A text without letters, null and empty
    texts among them, has no language: language 'und', posterior 0, not accepted. A text unlike all of ``languages`` gets the
    language 'other', and is not accepted, as is one whose best language is below ``min_posterior``. Ties go to the first of
    ``languages``, the other class last. Texts of any length count whole. Repeated rows are judged one by one, further columns are
    ignored, an empty table gives an empty table.
    """
    n_langs = len(languages) + 1
    texts = texts.select("id", F.lower(F.col("declared")).alias("declared"), F.lower(F.col("host")).alias("host"), "text")
    model = trigram_model(texts, languages)
    scores = written(_host_parts(text_evidence(texts, model, ["id", "declared", "host"])).withColumn(
        "text_language", F.when(F.col("n_grams") > 0, F.expr("array_position(evidence, array_max(evidence)) - 1"))))
    counted = scores.where("n_grams > 0")
    ones = "array_repeat(1.0D, {0})".format(n_langs)
    total = counted.agg(F.array(*[F.count_if(F.col("text_language") == k).cast("double") for k in range(n_langs)])
                        .alias("n_all"))

    def smooth(counts: str, parent: str) -> str:
        """(counts + STRENGTH * parent) / sum; no counts: the parent's."""
        return (f"CASE WHEN {counts} IS NULL THEN {parent} ELSE zip_with({counts}, {parent}, (n, p) -> "
                f"(n + {STRENGTH}D * p) / (aggregate({counts}, 0.0D, (a, x) -> a + x) + {STRENGTH}D)) END")

    def share(counts: str) -> str:
        """P(value | language) by language, up to a factor that all languages share; no counts: no evidence."""
        return f"coalesce(zip_with({counts}, n_all, (n, t) -> (n + 1.0D) / (t + {n_langs}.0D)), {ones})"

    joined = scores
    for by in ("declared", "suffix", "domain", "host"):
        joined = joined.join(_counted(counted, by, n_langs), by, "left")
    joined = (joined.crossJoin(F.broadcast(total))  # one row
              .withColumn("p_all", F.expr("transform(n_all, n -> (n + 1.0D) / (aggregate(n_all, 0.0D, (a, x) -> a + x) "
                                          f"+ {n_langs}.0D))"))
              .withColumn("p_suffix", F.expr(smooth("n_suffix", "p_all")))
              .withColumn("p_domain", F.expr(smooth("n_domain", "p_suffix")))
              .withColumn("p_seen", F.expr(smooth("n_host", "p_domain")))
              .withColumn("p_host", F.expr(f"transform(p_seen, (p, k) -> {1 - OTHER_PRIOR}D * p + IF(k = {n_langs - 1}, {OTHER_PRIOR}D, 0.0D))"))
              .withColumn("d", F.expr(share("n_declared"))).withColumn("s", F.expr(share("n_suffix"))))
    logs = joined.withColumn("logs", F.expr(
        f"transform(sequence(0, {n_langs - 1}), k -> evidence[k] + ln(p_host[k]) + ln(d[k]) + ln(s[k]))"))
    best = "array_position(logs, array_max(logs))"
    names = "array(" + ", ".join(f"'{x}'" for x in (*languages, OTHER)) + ")"
    return (logs.withColumn("posterior", F.expr(
                "CASE WHEN n_grams > 0 THEN 1.0D / aggregate(logs, 0.0D, (a, x) -> a + exp(x - array_max(logs))) ELSE 0.0D END"))
            .selectExpr("id", f"CASE WHEN n_grams > 0 THEN element_at({names}, CAST({best} AS INT)) ELSE 'und' END AS language",
                        "round(posterior, 4) AS posterior", f"get({names}, CAST(text_language AS INT)) AS text_language",
                        "n_grams", f"n_grams > 0 AND {best} < {n_langs} AND posterior >= {min_posterior} AS accepted"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (id, text, declared, host): visible text, the html tag's lang, the address's host."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.nullif(lang, F.lit("")).alias("declared"),
                        F.nullif(host, F.lit("")).alias("host"))


def document_texts(docs: DataFrame) -> DataFrame:
    """documents: the declared language is ``lang``; a source stands for a host."""
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
