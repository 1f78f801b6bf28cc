"""Quality rules whose limits come from the data.

Each text gets counts (one map in Arrow batches) and integer metrics made of them. For every metric, language
and source a quantile sketch is kept: counts in buckets whose width grows with the value, so that a quantile
is read within 1/64 of its value. Sketches merge by adding counts: partial aggregation, and the sketches of a
language or of all documents are sums of those below. Documents that the base rules reject are not in them.

A limit is q + FENCE * (q - median), where q is the metric's tail quantile: it follows how far a group's own values
spread, and no floor but the sketch's resolution enters. Groups of few documents shrink towards their language, languages towards
all documents: a quantile is the mean of the group's, weighted by its documents, and of its parent's, weighted by WEIGHT. So a group
gains its own limits bit by bit as it grows. Verdicts are a join of documents' metrics with their group's limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from photolake.llm.base import bounded, text_batches, written
from photolake.llm.words import mix, ngram_hashes, ngram_places, slices, utf8, word_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents' worth of the parent's quantiles in a group's.
WEIGHT = 200
FENCE = 2
#: Least distance of a tail from the median: a bucket of small values in the sketch.
RESOLUTION = 1
#: Per metric: SQL over the counts, the tail quantile in percent, and whether small values fail too. Rates that a single line or
#: window of a short text makes large are read further out.
METRICS = {
    "symbol_rate": ("n_symbols * 1000 DIV greatest(word_chars, 1)", 90, False),
    "dup_line_rate": ("n_dup_lines * 1000 DIV greatest(n_lines, 1)", 99, False),
    "repeat_rate": ("n_repeat_words * 1000 DIV greatest(n_words, 1)", 99, False),
    "word_length": ("word_chars * 100 DIV greatest(n_words, 1)", 95, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.arange(256) != 10


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _counts(texts: pa.Array) -> dict[str, np.ndarray]:
    raw, bounds = utf8(texts)
    n = len(texts)
    words, starts, _, first = word_hashes(raw, bounds, lower=False, is_word=~_SPACE)
    in_word = ~_SPACE[raw]
    word_chars = _per_text(in_word & ((raw & 0xC0) != 0x80), bounds)
    lines, begins, ends, line_first = word_hashes(raw, bounds, lower=False, is_word=_NOT_NEWLINE)
    text_of_line = np.repeat(np.arange(n), np.diff(line_first))
    seen = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    full = seen[ends] > seen[begins]
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    keys = lines[full] ^ salt[text_of_line[full]]
    _, earliest = np.unique(keys, return_index=True)
    again = np.ones(len(keys), dtype=bool)
    again[earliest] = False
    places, text_of_gram = ngram_places(first, WINDOW, len(words))
    repeated = places[_repeated(ngram_hashes(words, WINDOW)[places] ^ salt[text_of_gram])]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + WINDOW, -1)
    return {
        "n_words": np.diff(first), "word_chars": word_chars, "n_symbols": _per_text(_SYMBOL[raw], bounds),
        "n_lines": np.bincount(text_of_line[full], minlength=n),
        "n_dup_lines": np.bincount(text_of_line[full][again], minlength=n),
        "n_repeat_words": _per_text(np.cumsum(cover[:-1]) > 0, first),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text) -> doc_id, lang, source and the counts; a null text counts as empty."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(3)):
                own = batch.slice(first, len(texts))
                counts = _counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [own.column(i) for i in range(3)] + [pa.array(counts[c], pa.int64()) for c in COUNTS],
                    names=["doc_id", "lang", "source", *COUNTS])

    text_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(lang AS STRING) AS lang",
                           "CAST(source AS STRING) AS source", "CAST(text AS STRING) AS text").mapInArrow(
        count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


#: Bucket of a value: itself below 128, then 64 buckets for each doubling. And the smallest value of a bucket.
BUCKET = ("CASE WHEN v < 128 THEN v ELSE (length(bin(v)) - 7) * 64L + shiftright(v, length(bin(v)) - 7) END")
LEAST_OF = ("CASE WHEN bucket < 128 THEN bucket ELSE shiftleft(bucket % 64 + 64, "
            "CAST(bucket DIV 64 - 1 AS INT)) END")


def sketches(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches of all groups; null language or source: ''."""
    stacked = ", ".join(f"'{m}', {m}" for m in METRICS)
    return (metrics.selectExpr("lang", "source", f"stack({len(METRICS)}, {stacked}) AS (metric, v)")
            .groupBy("lang", "source", "metric", F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n")))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``by``, metric, n_docs, median and both tails (low, high) from merged sketches. A group has as many rows as filled buckets."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "metric")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    tail = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, (_, t, _) in METRICS.items()) + " END"
    ranked = (merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
              .withColumn("least", F.expr(LEAST_OF)).withColumn("tail", F.expr(tail)))
    at = {"low": "upto * 100 >= total * (100 - tail)", "median": "upto * 2 >= total", "high": "upto * 100 >= total * tail"}
    return ranked.groupBy(*by, "metric").agg(
        *[F.expr(f"min(CASE WHEN {test} THEN least END)").alias(q) for q, test in at.items()],
        F.max("total").alias("n_docs"))


def limits(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) in ``sketch``: lower and upper limit of every metric, and ``own_share``, the weight of the
    group's own documents in them."""
    def level(by: list[str], name: str) -> DataFrame:
        return quantiles(sketch, by).select(*by, "metric", *[F.col(c).alias(f"{c}_{name}") for c in ("low", "median", "high", "n_docs")])

    def shrunk(name: str, parent: str) -> dict:
        return {f"{q}_{name}": F.expr(f"(n_docs_{name} * {q}_{name} + {WEIGHT} * {q}_{parent}) DIV (n_docs_{name} + {WEIGHT})")
                for q in ("low", "median", "high")}

    joined = (level(["lang", "source"], "own").join(level(["lang"], "lang"), ["lang", "metric"])
              .join(F.broadcast(level([], "all")), "metric")  # one row a metric
              .withColumns(shrunk("lang", "all")).withColumns(shrunk("own", "lang"))
              .withColumn("lo", F.expr(f"low_own - {FENCE} * greatest(median_own - low_own, {RESOLUTION})"))
              .withColumn("hi", F.expr(f"high_own + {FENCE} * greatest(high_own - median_own, {RESOLUTION})")))
    return joined.groupBy("lang", "source").agg(
        *[F.expr(f"max(CASE WHEN metric = '{m}' THEN {end} END)").alias(f"{end}_{m}") for m in METRICS for end in ("lo", "hi")],
        F.expr(f"round(max(n_docs_own / (n_docs_own + {WEIGHT})), 4)").alias("own_share"))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text) -> one row per row of ``docs``: counts, base_failed, own_share, failed_metrics, kept.

    Base rules: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of the words in repeated 8-word windows.
    Null or empty texts have no words and fail. Null languages and sources are groups of their own. Repeated rows are
    judged one by one, and each counts in its group's sketch; rows without doc_id are judged like others. Other columns are ignored; an
    empty table gives an empty table. Texts of any length are read whole. A value at its limit passes. Groups whose documents all
    fail the base rules have no limits: ``own_share`` and failed metrics are empty there.
    """
    counts = written(text_counts(docs))
    metrics = counts.selectExpr(
        "*", f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed",
        *[f"{sql} AS {m}" for m, (sql, _, _) in METRICS.items()]
    ).withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    fails = []
    for m, (_, _, both) in METRICS.items():
        fails.append(f"CASE WHEN {m} > hi_{m}" + (f" OR {m} < lo_{m}" if both else "") + f" THEN '{m}' END")
    own_limits = bounded(written(limits(sketches(metrics.where("NOT base_failed")))))
    return (metrics.join(own_limits, ["lang", "source"], "left")
            .withColumn("failed_metrics", F.expr(f"concat_ws(',', {', '.join(fails)})"))
            .selectExpr("doc_id", "lang", "source", *COUNTS, "base_failed", "own_share", "failed_metrics",
                        "NOT base_failed AND failed_metrics = '' AS kept"))
