"""Benchmark decontamination: rare word n-grams are seeds, local alignment of words is the verdict.

1. The n-grams of all benchmark items, plain ones and ones with gaps (SEEDS), fill a Bloom filter, the only thing that is
   broadcast. One map over the documents hashes their words and keeps documents with n-grams that pass, their words and those
   n-grams. Gaps let copies seed in which every third or fourth word is replaced.
2. An n-gram costs as many meetings as documents' places times items hold it. Of each item the costliest n-grams, dearer than
   the item's median, are left out while those left out cover at most two thirds of the words that the least score takes
   as matches; the rest, the rare ones, are its seeds. So a leak always matches words that rare n-grams cover. Rarity is
   relative to the item: a leak, however popular, makes all its n-grams dear alike and keeps its seeds.
3. Seeds join documents to items by a shuffle, salted. Hits of a document and an item are merged by diagonal into passages of
   at most a few item lengths; nothing is gathered per document, and per item no more than its own n-grams.
4. Smith-Waterman alignment of words scores each passage, batches of passages at a time. The score is a share of the
   score of the whole item found word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import text_batches, text_mark, without, written
from photolake.llm.words import BASE, mix, ngram_places, slices, utf8, word_hashes

#: Places of the words in a plain or gapped n-gram. Those of three words are taken from items of fewer than SHORT words only.
SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 3, 5), (0, 2, 3, 5), (0, 1, 4, 5),
         (0, 1, 2), (0, 1, 3), (0, 2, 3))
SHORT = 12
#: Words that the n-grams left out may cover, as a share of those that a leak has to match at least.
COMMON = 2 / 3
#: Ways that the hits of one n-gram, and the passages of one item, are split.
SALT = 16
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Bits of the Bloom filter, as a power of two: 16 an n-gram, within these limits (2 and 32 MB).
FILTER_BITS = (24, 28)
#: Passages aligned at a time.
BATCH = 512
_PAD_ITEM, _PAD_TEXT = np.uint64(1), np.uint64(2)


def _seeds(words: np.ndarray, first: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, text, seed) of every n-gram inside a text; ``first``: where the texts' words begin. Seeds of ``size``
    words only, if given."""
    out = []
    for k, offsets in enumerate(SEEDS):
        if size and len(offsets) != size:
            continue
        places, text = ngram_places(first, offsets[-1] + 1, len(words))
        h = np.full(len(places), k + 1, dtype=np.uint64)
        for o in offsets:
            h = h * np.uint64(BASE) + words[places + o]
        out.append((mix(h), places, text, np.full(len(places), k, dtype=np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _item_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, seed) of an item's n-grams."""
    first = np.array([0, len(words)])
    sizes = (3, 4) if len(words) < SHORT else (4,)
    found = [_seeds(words, first, n) for n in sizes]
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1, 3))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) -> item_id, words (little-endian uint64 hashes), n_words and grams (hash, item_pos, seed)."""
    gram = pa.struct([("hash", pa.int64()), ("item_pos", pa.int32()), ("seed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in slices(batch.column(1)):
                raw, bounds = utf8(part)
                hashes, _, _, first = word_hashes(raw, bounds)
                words = [hashes[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                found = [_item_grams(w) for w in words]
                grams = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found]).astype(kind)) for i, kind in enumerate((np.int64, np.int32, np.int32))],
                    fields=list(gram))
                offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(part)), pa.array([w.astype("<u8").tobytes() for w in words], pa.binary()),
                    pa.array([len(w) for w in words], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), grams)],
                    names=["item_id", "words", "n_words", "grams"])

    text_batches(benchmark.sparkSession)
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "item_id long, words binary, n_words int, grams array<struct<hash: long, item_pos: int, seed: int>>")


def _probes(h: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << log_bits) - 1)
    return h & mask, (h >> np.uint64(log_bits)) & mask


def bloom_filter(grams: DataFrame, log_bits: int) -> np.ndarray:
    """Bits of a filter over the column ``hash``: at most 2**log_bits / 64 words reach the driver, 32 MB at the limit."""
    mask = (1 << log_bits) - 1
    probes = F.array(F.col("hash").bitwiseAND(F.lit(mask)),
                     F.shiftrightunsigned("hash", log_bits).bitwiseAND(F.lit(mask)))
    words = (grams.select(F.explode(probes).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")))
    out = np.zeros(1 << (log_bits - 6), dtype=np.uint64)
    for row in words.toLocalIterator():
        out[row.word] = np.int64(row.bits).view(np.uint64)
    return out


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for p in _probes(h, 6 + len(bits).bit_length() - 1):
        at = np.flatnonzero(out)
        p = p[at]
        out[at] = (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def _hits(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Documents with n-grams that pass the filter: doc_id, mark, words, hits (pos, hash)."""
    schema = "doc_id long, mark long, words binary, pos array<int>, hash array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in slices(batch.column(2)):
                raw, bounds = utf8(part)
                words, _, _, first = word_hashes(raw, bounds)
                found = []
                for size in (3, 4):
                    grams, places, text, _ = _seeds(words, first, size)
                    good = np.flatnonzero(_passes(grams, bits))
                    found.append((grams[good], places[good], text[good]))
                grams, places, text = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(text, kind="stable")
                grams, places, text = grams[order], places[order], text[order]
                some, cuts = np.unique(text, return_index=True)
                cuts = np.append(cuts, len(text))
                own = batch.slice(begin, len(part)).take(pa.array(some))
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(1),
                    pa.array([words[first[i]:first[i + 1]].astype("<u8").tobytes() for i in some.tolist()], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array((places - first[text]).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))],
                    names=["doc_id", "mark", "words", "pos", "hash"])

    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text_mark().alias("mark"), text.alias("text")).mapInArrow(run, schema)


def rare(places: np.ndarray, seeds: np.ndarray, costs: np.ndarray, most: float) -> np.ndarray:
    """Which n-grams of an item stay: the costliest go while those gone cover at most ``most`` words."""
    stays = np.ones(len(costs), dtype=bool)
    covered: set[int] = set()
    middle = np.median(costs) if len(costs) else 0
    for i in np.lexsort((seeds, places, -costs)).tolist():
        if costs[i] <= middle:
            break
        more = covered | {int(places[i]) + o for o in SEEDS[seeds[i]]}
        if len(more) <= most:
            covered = more
            stays[i] = False
    return stays


def _rare(grams: DataFrame, places: DataFrame, min_score: float) -> DataFrame:
    """(item, n_words, hash, item_pos, seed), (hash, n_places) -> the seeds among the n-grams that documents hold."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["grams"]
                at, seeds, costs = (np.array([g[k] for g in own], dtype=np.int64) for k in ("item_pos", "seed", "cost"))
                keep = np.flatnonzero(rare(at, seeds, costs, COMMON * min_score * row["n_words"])).tolist()
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([row["item"]] * len(keep), pa.int64()), "n_words": pa.array([row["n_words"]] * len(keep), pa.int32()),
                    "hash": pa.array([own[i]["hash"] for i in keep], pa.int64()),
                    "item_pos": pa.array([own[i]["item_pos"] for i in keep], pa.int32())})

    owners = grams.groupBy("hash").agg(F.count_distinct("item").alias("n_items")).join(places, "hash")
    found = grams.join(owners.selectExpr("hash", "n_items * n_places AS cost"), "hash", "left")
    each = found.groupBy("item", "n_words").agg(F.collect_list(F.struct(
        "hash", "item_pos", "seed", F.coalesce("cost", F.lit(0)).alias("cost"))).alias("grams"))
    return each.mapInArrow(choose, "item long, n_words int, hash long, item_pos int")


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage."""
    n, length, width = len(items), max(map(len, items)), max(map(len, passages))
    a = np.full((n, length), _PAD_ITEM)
    b = np.full((n, width), _PAD_TEXT)
    for k in range(n):
        a[k, :len(items[k])] = items[k]
        b[k, :len(passages[k])] = passages[k]
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    row = np.zeros((n, width + 1), dtype=np.int32)
    best = np.zeros(n, dtype=np.int32)
    for i in range(length):
        diagonal = row[:, :-1] + np.where(b == a[:, i:i + 1], np.int32(MATCH), np.int32(MISMATCH))
        new = np.zeros_like(row)
        np.maximum(diagonal, row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps inside the row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _scores(passages: DataFrame) -> DataFrame:
    """(row, doc_id, mark, item_id, item, passage) -> with the score in place of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, "<u8") for x in batch.column(4).to_pylist()]
            texts = [np.frombuffer(x, "<u8") for x in batch.column(5).to_pylist()]
            order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(texts[k])))
            scores = np.zeros(len(items))
            while order:
                # As many as fit a bounded table: one very long item is aligned alone.
                take, order = order[:BATCH], order[BATCH:]
                while len(take) > 1 and len(take) * len(texts[take[-1]]) > 1 << 20:
                    half = len(take) // 2
                    take, order = take[:half], take[half:] + order
                found = align([items[k] for k in take], [texts[k] for k in take])
                scores[take] = found / [MATCH * len(items[k]) for k in take]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores)],
                                             names=["row", "doc_id", "mark", "item_id", "score"])

    text_batches(passages.sparkSession, 2000)
    return passages.mapInArrow(run, "row long, doc_id long, mark long, item_id long, score double")


def _candidates(found: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Passages to align: row, item, begin, stop."""
    grams = items.select("item", "n_words", F.explode("grams").alias("g")).select("item", "n_words", "g.*")
    hits = found.select("row", F.explode(F.arrays_zip("pos", "hash")).alias("h")).select("row", "h.pos", "h.hash")
    seeds = _rare(grams, hits.groupBy("hash").agg(F.count("*").alias("n_places")), min_score)
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = (hits.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"])
           .withColumn("diagonal", F.col("pos") - F.col("item_pos")))
    slack = "greatest(8, n_words DIV 4)"
    return (met.groupBy("row", "item", "n_words", F.expr("floor(diagonal / n_words)").alias("cell"))
            .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
            .selectExpr("row", "item", f"greatest(low - {slack}, 0) AS begin", f"high + n_words + {slack} AS stop"))


def _prepare(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with hits (row, doc_id, mark, words, pos, hash) and items (item, item_id, words, n_words, grams)."""
    items = written(_items(benchmark).where(F.size("grams") > 0).withColumn("item", F.monotonically_increasing_id()))
    n_grams = items.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    low, high = FILTER_BITS
    bits = bloom_filter(items.select(F.explode("grams.hash").alias("hash")), min(max((16 * n_grams).bit_length(), low), high))
    return written(_hits(docs, bits).withColumn("row", F.monotonically_increasing_id())), items


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, score, mark: items found in documents, scores up to 1.

    ``mark`` is the hash of the document's text, for documents without an id or with a repeated one. Null and empty texts and
    items of fewer than three words find nothing. Repeated documents are reported once for each different text, repeated items
    with one id once. Texts of any length are searched whole. Other columns are ignored; empty tables give an empty table.
    """
    found, items = _prepare(docs, benchmark)
    salted = items.select("item", "item_id", F.col("words").alias("item_words"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    cut = (_candidates(found, items, min_score).join(found.select("row", "doc_id", "mark", F.col("words").alias("text_words")), "row")
           .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["item", "salt"])
           .selectExpr("row", "doc_id", "mark", "item_id", "item_words",
                       "substring(text_words, CAST(begin * 8 + 1 AS INT), CAST((stop - begin) * 8 AS INT)) AS passage"))
    return (_scores(cut).where(F.col("score") >= min_score).groupBy("doc_id", "mark", "item_id")
            .agg(F.round(F.max("score"), 4).alias("score")).select("doc_id", "item_id", "score", "mark"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    return without(docs, leaks(docs, benchmark, min_score))
