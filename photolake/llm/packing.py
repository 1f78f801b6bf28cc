"""Packing of token ids into windows of fixed capacity by multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at most PIECE ids. Pieces are
dealt to groups of bounded size. Inside a group every piece begins as a partial partition of k window sums (its length
and zeros). The two partial partitions with the widest differences merge, the largest sums of one with the smallest of
the other, until one is left: k windows of near-equal sums. k starts at the least number that can hold the group, and
rises until no window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import text_batches, written
from photolake.llm.bpe import FILE, KEEP, encoder
from photolake.llm.words import slices

CAPACITY = 1024
PIECE = 256
#: Pieces in a group; a group's partitioning costs this times its windows.
GROUP = 512
END_ID = 0


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    full, rest = divmod(n, capacity)
    lengths = [capacity] * full + [piece] * (rest // piece)
    return lengths + ([rest % piece] if rest % piece else [])


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the window (0 .. k-1) of each length, sums near equal."""
    n = len(lengths)
    # A set of items is a leaf (an item) or a node that joins two sets; -1 is the empty set.
    left, right = [0] * n, [0] * n
    heap = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        sums, sets = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[-1], sets[-1] = lengths[i], i
        heap.append((-int(lengths[i]) if k > 1 else 0, i, sums, sets))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, tie, other, others = heapq.heappop(heap)
        sums, others = sums + other[::-1], others[::-1]  # sums are kept in ascending order
        joint = np.where(sets < 0, others, sets)
        for j in np.flatnonzero((sets >= 0) & (others >= 0)).tolist():
            left.append(int(sets[j]))
            right.append(int(others[j]))
            joint[j] = made
            made += 1
        order = np.argsort(sums, kind="stable")
        sums, joint = sums[order], joint[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tie, sums, joint))
    window = np.zeros(n, dtype=np.int64)
    for w, node in enumerate(heap[0][3].tolist()):
        stack = [node] if node >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += [left[node], right[node]]
    return window


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each length, with as few windows as differencing needs to stay within the capacity."""
    total, k = int(lengths.sum()), -(-int(lengths.sum()) // capacity)
    while True:
        found = difference(lengths, k)
        over = int(np.bincount(found, weights=lengths).max()) - capacity
        if over <= 0:
            return found
        k += max(1, k * over // (capacity + over))
        assert k <= max(len(lengths), 2 * total // capacity + 2)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, file: str = FILE, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """(doc_id, text) -> the pieces of every document, ``ids`` too if asked for."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, keep)
        for batch in batches:
            for first, texts in slices(batch.column(1), 1 << 20):
                ids, bounds = coder.encode(texts.to_pylist(), END_ID)
                raw = memoryview(ids.astype("<u4").tobytes())
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, a, b in zip(batch.column(0).slice(first, len(texts)).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    at = a
                    for size in cut(b - a):
                        for column, value in zip(out, (doc, at - a, size, zlib.crc32(raw[4 * at:4 * (at + size)]), b - a)):
                            column.append(value)
                        if with_ids:
                            out[5].append(ids[at:at + size])
                        at += size
                arrays = [pa.array(c, pa.int64()) for c in out[:5]]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array([x.astype(np.int32) for x in out[5]], pa.list_(pa.int32()))] * with_ids,
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tokens, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, file: str = FILE, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """(doc_id, text) -> pieces with sequence_id and offset: which part of which document stands where.

    Null and empty texts are one piece, the end id. Repeated rows and null ids are packed like any others; other columns
    are ignored; an empty table gives an empty table. A full window is a sequence of its own; a packed sequence holds at
    most CAPACITY ids, offsets run from 0 without gaps. Only (length, place) of pieces meet in a group, never ids. ``keep``
    bounds the encoder's memory, about 300 bytes for each kept word.
    """
    cut_up = written(pieces(docs, file, with_ids, keep).withColumn("__row", F.monotonically_increasing_id()))
    n_groups = max(1, -(-cut_up.where(F.col("length") < CAPACITY).count() // GROUP))
    full = cut_up.where(F.col("length") == CAPACITY).withColumn("sequence_id", F.col("__row") * 2).withColumn(
        "offset", F.lit(0).cast("long"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__row", ignore_index=True)
        lengths = group["length"].to_numpy()
        group["__window"] = windows(lengths)
        inside = group.groupby("__window")["length"].cumsum() - group["length"]
        return pd.DataFrame({"__row": group["__row"], "offset": inside,
                             "sequence_id": (group["__group"] * GROUP * 2 + group["__window"]) * 2 + 1})

    rest = cut_up.where(F.col("length") < CAPACITY)
    dealt = (rest.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(n_groups)).alias("__group"))
             .repartition(F.col("__group")).groupBy("__group").applyInPandas(
                 place, "__row long, offset long, sequence_id long"))
    packed = rest.join(dealt, "__row")
    return full.unionByName(packed).drop("__row")
