"""Near-duplicate join on sets of word n-grams by MinHash banding.

Texts with equal n-gram sets are collapsed to one first. Each set has a MinHash signature, cut into bands; sets that agree
in a band meet in a bucket. Bands and rows are chosen so that a pair at the wanted similarity is missed with at most
1 - TARGET_RECALL. Buckets with the same members are used once. Members of a bucket are dealt to blocks, pairs of blocks
are compared in a task each, on the full sets, and a pair counts only where its bands first agree. Tasks return what
they found per member (number of links, least member of its cluster), never rows per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import bounded, nested, text_batches, text_mark, without, written
from photolake.llm.graph import components
from photolake.llm.words import mix, ngram_hashes, ngram_places, slices, utf8, word_hashes

N = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.99999
MAX_HASHES = 96
#: Members of a block; a task compares two blocks at most.
BLOCK = 1024
#: Bytes of n-gram sets dealt to one task.
BIN_BYTES = 16 << 20


def bands_and_rows(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows per band, and the fewest bands with them, that reach the recall with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach the recall with so few hashes")
    return best


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and the places where texts begin. A text of fewer than n words has
    one n-gram, all its words; a text without words has none."""
    raw, bounds = utf8(texts)
    words, _, _, first = word_hashes(raw, bounds)
    places, text = ngram_places(first, n, len(words))
    grams = ngram_hashes(words, n)[places]
    sizes = np.diff(first)
    for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        own = words[first[i]:first[i + 1]]
        short = np.full(1, len(own), dtype=np.uint64)
        for w in own:
            short = short * np.uint64(0x9E3779B97F4A7C15) + w
        grams = np.append(grams, mix(short))
        text = np.append(text, i)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(texts) + 1))


def _digests(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each set: two sums over its members."""
    starts = first[:-1]
    out = np.zeros((len(starts), 2), dtype=np.uint64)
    for k, salt in enumerate((1, 2)):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams + np.uint64(salt)), dtype=np.uint64)])
        out[:, k] = total[first[1:]] - total[starts]
    return [row.tobytes() for row in out]


def _signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes [text, band]; texts without n-grams get zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, bands), dtype=np.uint64)
    if not len(full):
        return out
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for band in range(bands):
        joint = np.full(len(full), band + 1, dtype=np.uint64)
        for row in range(rows):
            ranks = (grams * seeds[band * rows + row]) >> np.uint64(32)
            joint = mix(joint * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(ranks, first[full]))
        out[full, band] = joint
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, text) -> doc_id, mark, key (digest of the n-gram set), n_grams, bands."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(2)):
                grams, first = _sets(texts, n)
                values = _signatures(grams, first, bands, rows).view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)),
                    pa.array(_digests(grams, first), pa.binary()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(values))],
                    names=["doc_id", "mark", "key", "n_grams", "bands"])

    text_batches(docs.sparkSession)
    return docs.select("doc_id", text_mark().alias("mark"), "text").mapInArrow(
        sign, "doc_id long, mark long, key binary, n_grams long, bands array<long>")


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) -> key, grams (sorted little-endian uint64)."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(1)):
                grams, first = _sets(texts, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_digests(grams, first), pa.binary()),
                    pa.array([grams[a:b].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                    names=["key", "grams"])

    text_batches(docs.sparkSession)
    return docs.mapInArrow(collect, "key binary, grams binary")


def _intersections(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left[i] and right[i]."""
    m = len(grams)
    values, code, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(m), [len(g) for g in grams])
    shared = often > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, member = number[code[keep]], member[keep]
    order = np.argsort(code, kind="stable")
    code, member = code[order], member[order]
    n_codes = int(shared.sum())
    dense = len(left) > m * m // 16
    total = np.zeros((m, m) if dense else len(left), dtype=np.float32 if dense else np.int64)
    for begin in range(0, n_codes, 2048):
        a, b = np.searchsorted(code, [begin, begin + 2048])
        width = min(2048, n_codes - begin)
        if dense:
            part = np.zeros((m, width), dtype=np.float32)
            part[member[a:b], code[a:b] - begin] = 1
            total += part @ part.T
        else:
            part = np.zeros((m, width), dtype=bool)
            part[member[a:b], code[a:b] - begin] = True
            for i in range(0, len(left), 4096):
                total[i:i + 4096] += np.count_nonzero(part[left[i:i + 4096]] & part[right[i:i + 4096]], axis=1)
    return total[left, right].astype(np.int64) if dense else total


def compare(keys: list, grams: list[np.ndarray], copies: np.ndarray, bands: np.ndarray, band: int, block: np.ndarray,
            similarity: float) -> list[tuple]:
    """Links of one bucket, or of two of its blocks: (key, least key of its cluster here, links, linked copies).

    A pair that agrees in an earlier band is another bucket's.
    """
    m = len(keys)
    if block[0] == block[-1]:
        left, right = np.triu_indices(m, 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0]),
                                                      indexing="ij"))
    sizes = np.array([len(g) for g in grams])
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fit = small >= similarity * large
    left, right = left[fit], right[fit]
    for earlier in range(band):
        if not len(left):
            return []
        fit = bands[left, earlier] != bands[right, earlier]
        left, right = left[fit], right[fit]
    if not len(left):
        return []
    both = _intersections(grams, left, right)
    fit = both >= similarity * (sizes[left] + sizes[right] - both) - 1e-9
    left, right = left[fit], right[fit]
    if not len(left):
        return []
    links = np.bincount(left, minlength=m) + np.bincount(right, minlength=m)
    linked = np.bincount(left, copies[right], m) + np.bincount(right, copies[left], m)
    label = np.argsort(np.argsort(np.array(keys, dtype=object)))  # rank of each key
    at_rank = np.argsort(label)
    while True:
        before = label.copy()
        np.minimum.at(label, left, before[right])
        np.minimum.at(label, right, label[left])
        if (label == before).all():
            break
    return [(keys[i], keys[at_rank[label[i]]], int(links[i]), int(linked[i])) for i in np.flatnonzero(links).tolist()]


def links(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = TARGET_RECALL,
          block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their keys, distinct texts, links found per member of a bucket)."""
    bands, rows = bands_and_rows(similarity, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = written(signed(docs.where("doc_id IS NOT NULL"), n, bands, rows))
    texts = written(keyed.where("n_grams > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"),
        F.first("bands").alias("bands")))
    entries = texts.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = (entries.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("key").alias("lead"),
                                                   F.bit_xor(F.xxhash64("key")).alias("mark"))
               .where("n > 1").groupBy("n", "lead", "mark").agg(F.min(F.struct("band", "hash")).alias("b"))
               .select("b.band", "b.hash", "n"))
    members = written(entries.join(buckets, ["band", "hash"]))
    ids = bounded(members.select("key").distinct().join(texts, "key").select(F.col("first_id").alias("doc_id")).distinct())
    grams = sets(docs.join(ids, "doc_id", "left_semi"), n).groupBy("key").agg(F.first("grams").alias("grams"))
    n_blocks = F.ceil(F.col("n") / block)
    dealt = (members.withColumn("block", F.pmod(F.xxhash64("key"), n_blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
             .selectExpr("key", "band", "hash", "block", "least(block, other) AS i", "greatest(block, other) AS j"))
    total = members.join(texts.select("key", "n_grams"), "key").agg(
        F.sum(F.col("n_grams") * 8 * F.ceil(F.col("n") / block))).first()[0] or 0
    n_bins = max(1, -(-int(total) // BIN_BYTES))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        part = part.sort_values(["band", "hash", "i", "j", "block", "key"], ignore_index=True)
        change = (part[["band", "hash", "i", "j"]].ne(part[["band", "hash", "i", "j"]].shift())).any(axis=1)
        starts = [*np.flatnonzero(change.to_numpy()).tolist(), len(part)]
        key, band, gram = part["key"].tolist(), part["band"].tolist(), part["grams"].tolist()
        i, j, blocks, copies = (part[c].to_numpy() for c in ("i", "j", "block", "copies"))
        for a, b in zip(starts, starts[1:]):
            if b - a < 2 or (i[a] != j[a] and blocks[a] == blocks[b - 1]):
                continue
            out += compare(key[a:b], [np.frombuffer(g, "<u8") for g in gram[a:b]], copies[a:b],
                           np.stack(part["bands"].iloc[a:b].to_list()), band[a], blocks[a:b], similarity)
        return pd.DataFrame(out, columns=["key", "lead", "links", "linked"])

    found = (dealt.join(texts.select("key", "copies", "bands"), "key").join(grams, "key")
             .withColumn("bin", F.pmod(F.xxhash64("band", "hash", "i", "j"), F.lit(n_bins)))
             .groupBy("bin").applyInPandas(search, "key binary, lead binary, links long, linked long"))
    return keyed, texts, written(found)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = TARGET_RECALL,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> one row per row of ``docs``: doc_id, class_id, n_links, n_text_links, n_copies,
    is_first, mark.

    class_id is the least doc_id of those reached over links (similarity of n-gram sets at least ``similarity``), n_links the
    number of other rows linked to this one, copies included, n_text_links the number of different texts linked, n_copies the
    rows with this very n-gram set; is_first marks the row that may stand for its class, mark is a hash of its text. Null and empty texts and texts without words have no n-grams and no links; they are classes of
    their own, as are rows without doc_id (class_id null). Texts of fewer than ``n`` words are linked to copies only. Repeated rows
    are copies. Other columns are ignored; an empty table gives an empty table.
    """
    keyed, texts, found = links(docs, similarity, n, recall, block)
    degree = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    roots = components(found.selectExpr("key AS u", "lead AS v")).withColumnRenamed("node", "key")
    grouped = roots.join(texts.select("key", "first_id"), "key")
    least = grouped.groupBy("root").agg(F.min(F.struct("first_id", "key")).alias("least"))
    classes = grouped.join(least, "root").selectExpr("key", "least.first_id AS class_id", "least.key = key AS leads")
    info = written(texts.select("key", "first_id", "copies").join(degree, "key", "left").join(classes, "key", "left")
                   .where("copies > 1 OR links > 0")
                   .selectExpr("key", "first_id", "coalesce(class_id, first_id) AS class_id", "coalesce(leads, true) AS leads",
                               "coalesce(links, 0) AS links", "coalesce(linked, 0) AS linked", "copies"))
    rows = keyed.select("doc_id", "mark", "key", "n_grams").join(info, "key", "left").selectExpr(
        "doc_id", "CASE WHEN n_grams > 0 THEN coalesce(class_id, doc_id) ELSE doc_id END AS class_id",
        "coalesce(linked + copies - 1, 0) AS n_links", "coalesce(links, 0) AS n_text_links", "coalesce(copies, 1) AS n_copies",
        "n_grams = 0 OR coalesce(leads AND doc_id = first_id, true) AS is_first", "mark")
    lone = docs.where("doc_id IS NULL").selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id", "CAST(NULL AS BIGINT) AS class_id", "0L AS n_links", "0L AS n_text_links",
        "1L AS n_copies", "true AS is_first", "xxhash64(coalesce(CAST(text AS STRING), '')) AS mark")
    return rows.unionByName(lone)


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each class; rows without doc_id stay."""
    found = written(near_duplicates(docs, **params))
    kept = without(docs, found.where("NOT is_first"))
    twice = written(found.where("is_first AND doc_id IS NOT NULL").groupBy("doc_id", "mark").count().where("count > 1"))
    if twice.isEmpty():
        return kept
    # Rows equal in id and text: one of them stays.
    bad = twice.selectExpr("doc_id AS bad_id", "mark AS bad_mark")
    again = nested(kept).join(bad, (F.col("id") == F.col("bad_id")) & (F.col("mark") == F.col("bad_mark")), "left_semi")
    return without(kept, twice).unionByName(again.dropDuplicates(["id", "mark"]).select("row.*"))
