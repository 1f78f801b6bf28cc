"""SimHash near-duplicates found by pigeonhole blocks.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Fingerprints are cut into ``BLOCKS`` blocks;
two that differ in at most ``distance`` bits agree in all blocks but ``distance`` of them, so they share the key made of the other
blocks for at least one choice. Equal fingerprints are collapsed, fingerprints are joined on these keys, and every pair of a bucket
is verified by its Hamming distance. Members of a large bucket are dealt to chunks and a task compares two chunks; it
returns a spanning forest of the links it saw (at most one row per member), so no pair is ever written. Connected components of the
forests are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from photolake.llm.base import bounded, written
from photolake.llm.graph import components
from photolake.llm.words import slices, utf8

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Keys hold BLOCKS - DISTANCE blocks, about 32 of 64 bits, so that buckets of unrelated texts stay small at billions of rows.
BLOCKS = 6
#: Members of a chunk; a task compares two chunks at a time.
CHUNK = 1024
#: Rows dealt to one task.
BIN_ROWS = 1 << 17
#: Shingles hashed at a time, whatever the length of a text.
STEP = 1 << 17

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words, lower-cased (A-Z) and joined by single spaces; where each begins and ends; each text's first word."""
    raw, bounds = utf8(texts)
    inside = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    letters = raw[inside]
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = np.where(
        (letters >= 65) & (letters <= 90), letters + np.uint8(32), letters)
    return joined.tobytes(), begin, begin + sizes, np.searchsorted(starts, bounds)


def text_fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text (null: as empty)."""
    joined, begin, end, first = _words(texts)
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(texts)), n_shingles)
    left = first[:-1][text] + np.arange(len(text)) - (np.cumsum(n_shingles) - n_shingles)[text]
    right = np.minimum(left + size, first[1:][text]) - 1
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    for at in range(0, len(text), STEP):
        own = text[at:at + STEP]
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(begin[left[at:at + STEP]].tolist(), end[right[at:at + STEP]].tolist())),
                             dtype="<u8", count=len(own))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    majority = (2 * counts > n_shingles[:, None]).astype(np.uint64)
    return (majority << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (64 bits as a long), one row per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(text_fingerprints(texts, size).view(np.int64))],
                    names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of blocks that may be all equal, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in masks])


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``label`` (least known member of each member's cluster) after linking left[i] with right[i]."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def forest(group: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """For each place the least place linked to it inside its group (equal values of ``group`` are adjacent)."""
    label, at, step = np.arange(len(prints)), np.arange(len(prints)), 1
    while True:
        at = at[at + step < len(prints)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return label
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= distance]
        label = _merge(label, near, near + step)
        step += 1


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(fp), no repeats -> u, v: links between fingerprints with the same components as all pairs within ``distance``."""
    if not 0 <= distance < blocks:
        raise ValueError("more blocks than differing bits are needed")
    entries = distinct.select("fp", F.posexplode(_keys(F.col("fp"), block_masks(blocks, distance))).alias("t", "key"))
    # A bucket with the same members as another is compared once.
    buckets = (entries.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lead"),
                                               F.bit_xor(F.xxhash64("fp")).alias("mark"))
               .where("n > 1").groupBy("n", "lead", "mark").agg(F.min(F.struct("t", "key")).alias("b"))
               .select("b.t", "b.key", "n"))
    members = written(entries.join(buckets, ["t", "key"]))
    n_chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = (members.withColumn("chunks", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .where("chunks = 1 OR chunk <> other")
             .selectExpr("t", "key", "least(chunk, other) AS i", "greatest(chunk, other) AS j", "fp"))
    total = members.agg(F.sum(n_chunks)).first()[0] or 0
    n_bins = max(1, -(-int(total) // BIN_ROWS))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "key", "i", "j", "fp"], ignore_index=True)
        same = part[["t", "key", "i", "j"]]
        group = same.ne(same.shift()).any(axis=1).cumsum().to_numpy()
        fp = part["fp"].to_numpy()
        label = forest(group, fp.view(np.uint64), distance)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": fp[tied], "v": fp[label[tied]]})

    return (dealt.withColumn("bin", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(n_bins)))
            .groupBy("bin").applyInPandas(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, size: int = SHINGLE,
                    chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) -> one row per row of ``docs``: doc_id, fp, component_id, n_copies (rows with this very fingerprint).

    component_id is the least doc_id reachable over links (fingerprints that differ in at most ``distance`` bits), the row's own
    included. Words are runs of anything but space and U+0009 to U+000D, A-Z lower-cased; a text of fewer than ``size`` words has one
    shingle, all its words; a text without words, an empty and a null text have fingerprint 0 and are linked like any
    other. Whole texts count, whatever their length; they are hashed a bounded step at a time. Repeated rows and ties are copies. A row without
    doc_id is linked too, its component_id is null if nothing it reaches has a doc_id. Other columns are ignored, whatever
    their names; an empty table gives an empty table.
    """
    prints = written(fingerprints(docs, size))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")))
    roots = components(links(distinct.select("fp"), distance, blocks, chunk)).withColumnRenamed("node", "fp")
    tied = roots.join(distinct.select("fp", "first_id"), "fp")
    least = tied.groupBy("root").agg(F.min("first_id").alias("least_id"))
    info = written(distinct.join(tied.join(least, "root").select("fp", "least_id"), "fp", "left")
                   .where("n_copies > 1 OR least_id IS NOT NULL")
                   .selectExpr("fp", "coalesce(least_id, first_id) AS least_id", "n_copies"))
    return prints.join(bounded(info), "fp", "left").selectExpr(
        "doc_id", "fp", "coalesce(least_id, doc_id) AS component_id", "coalesce(n_copies, 1L) AS n_copies")
