"""Removal of bytes covered by long strings that also start earlier in the corpus.

Documents are UTF-8 bytes; a string of LENGTH bytes counts as repeated if it starts earlier, in a document with a smaller id or
before in the same one. The order is exact and global; the work is split by content:

1. Whole copies of an earlier document are settled by digest.
2. Every LENGTH-byte window has an anchor, the least-hashed K-gram in it. Runs of windows with one anchor are a stretch, so equal
   windows lie in stretches with equal anchors. Anchors are counted; stretches whose anchor occurs once repeat nothing.
3. Stretches with equal bytes are settled by their hash: all but the earliest are repeated throughout.
4. Different stretches with one anchor meet in blocks of bounded size, where equal windows are found from the block's
   Burrows-Wheeler transform (``suffixes.py``). An anchor with very many stretches is split: a window holds at least half
   of the bytes beside the anchor on one side, so stretches that share a window share these bytes, and so on, exactly.
   Many stretches that share one whole window need no block: all but the window's earliest place are repeats.
5. Repeated runs are merged per document and the remaining bytes digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import text_batches, written
from photolake.llm.suffixes import repeats
from photolake.llm.words import BASE, BASE_INVERSE, mix, ngram_places, powers, slices, utf8

LENGTH = 100
K = 24
#: Stretches with one anchor that are compared together, bytes of a block, rows in a broadcast.
TOGETHER = 2048
BLOCK_BYTES = 1 << 19
BROADCAST_ROWS = 500_000
_SLICE = 1 << 19
_NULL_ID = -(1 << 63)

# A stretch's place in one number, in the order of the text: 15 bits of the text's hash (they tell repeated ids apart),
# 33 of the start, 7 of the number of further windows, 8 of the anchor's distance from the start.
_TIE = "CAST(shiftright(pos, 48) AS INT)"
_START = "(shiftright(pos, 15) & 8589934591)"
_SIZE = f"((shiftright(pos, 8) & 127) + {LENGTH})"
_ANCHOR = "CAST(pos & 255 AS INT)"


def _stretches(texts: pa.Array, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, further windows, anchor's distance, anchor's hash, hash of the bytes) of all stretches."""
    raw, bounds = utf8(texts)
    n, w = len(raw), length - k + 1
    places, text = ngram_places(bounds, length, n)
    if not len(places):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),) * 2
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    back = powers(BASE_INVERSE, n)
    hashes = mix((total[k:] - total[:-k]) * back[:n - k + 1])
    m = len(hashes)
    # The upper bits order K-grams, the lower ones hold the place: ties go to the left.
    ranked = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    bits = np.uint64(max(int(n).bit_length(), 1))
    ranked[:m] = ((hashes >> bits) << bits) | np.arange(m, dtype=np.uint64)
    grid = ranked.reshape(-1, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    anchor = (np.minimum(ahead[places], behind[places + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begin = np.ones(len(places), dtype=bool)
    begin[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(begin)
    last = np.append(at[1:] - 1, len(places) - 1)
    more, distance, begin = last - at, anchor[at] - places[at], places[at]
    content = mix((total[begin + more + length] - total[begin]) * back[begin]) ^ mix(((more << 8) | distance).astype(np.uint64))
    return text[at], begin - bounds[text[at]], more, distance, hashes[anchor[at]], content


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(id, tie, text) -> key (the anchor's hash), id, pos, content (hash of the stretch)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ties = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, part in slices(batch.column(2), _SLICE):
                text, start, more, distance, key, content = _stretches(part, length, k)
                pos = (ties[first + text] << 48) | (start << 15) | (more << 8) | distance
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[first + text]), pa.array(pos),
                                                  pa.array(content.view(np.int64))], names=["key", "id", "pos", "content"])

    text_batches(docs.sparkSession)
    return docs.select("id", "tie", "text").mapInArrow(find, "key long, id long, pos long, content long")


def _split(stretches: DataFrame, length: int, k: int, together: int) -> tuple[DataFrame, DataFrame, int]:
    """(key, id, pos, bytes) -> the same, split where a key has more than ``together`` stretches, until none has or a key
    stands for one window; the runs (id, tie, a, b) of windows with more; and the bytes of the split rows. Keys with a single
    stretch are left out."""
    beside = length - k
    now = stretches.withColumns({"l": F.lit(0), "r": F.lit(0)})
    same = ["key", "l", "r"]
    few, whole = f"n > 1 AND n <= {together}", f"n > {together} AND l + r = {beside}"
    rest, windows, n_bytes = [], [], 0
    while True:
        sizes = written(now.groupBy(*same).agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size")))
        total = sizes.select(
            F.sum(F.expr(f"CASE WHEN {few} THEN size END")), F.max(F.expr(whole)),
            F.max(F.expr(f"n > {together} AND l + r < {beside}"))).first()
        n_bytes += total[0] or 0
        rest.append(now.join(sizes.where(few), same, "left_semi"))
        if total[1]:
            windows.append(now.join(sizes.where(whole), same, "left_semi").selectExpr(
                "id", "pos", f"substring(bytes, {_ANCHOR} - l + 1, {length}) AS window", f"{_START} + {_ANCHOR} - l AS a"))
        if not total[2]:
            break
        hot = now.join(sizes.where(f"n > {together} AND l + r < {beside}"), same, "left_semi")
        half = f"CAST(ceil(({beside} - l - r) / 2) AS INT)"
        after = f"({_SIZE} - {_ANCHOR} - {k})"
        sides = hot.withColumn("side", F.expr(
            f"explode(filter(array(CASE WHEN {_ANCHOR} >= l + {half} THEN named_struct('l', l + {half}, 'r', r) END, "
            f"CASE WHEN {after} >= r + {half} THEN named_struct('l', l, 'r', r + {half}) END), x -> x IS NOT NULL))"))
        now = written(sides.selectExpr(
            f"xxhash64(key, side.l, side.r, substring(bytes, {_ANCHOR} - side.l + 1, side.l + {k} + side.r)) AS key",
            "id", "pos", "bytes", "side.l AS l", "side.r AS r"))
    out = rest[0]
    for part in rest[1:]:
        out = out.unionByName(part)
    return out.select("key", "id", "pos", "bytes"), _late_windows(windows, stretches, length), n_bytes


def _late_windows(windows: list[DataFrame], stretches: DataFrame, length: int) -> DataFrame:
    """Runs (id, tie, a, b) of all places of each window but the earliest. Partial aggregation: no window meets in one task."""
    if not windows:
        return stretches.where("false").selectExpr("id", f"{_TIE} AS tie", f"{_START} AS a", f"{_START} AS b")
    places = windows[0]
    for part in windows[1:]:
        places = places.unionByName(part)
    places = written(places)
    firsts = places.groupBy("window").agg(F.min(F.struct("id", "pos")).alias("f"))
    return places.join(firsts, "window").where("id <> f.id OR pos <> f.pos").selectExpr(
        "id", f"{_TIE} AS tie", "a", f"a + {length} AS b")


def _rest(docs: DataFrame) -> DataFrame:
    """(id, tie, text, runs) -> id, tie, n_removed, n_spans, kept_sha256."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, runs in zip(batch.column(2), batch.column(3).to_pylist()):
                data, at, n, k = text.as_buffer(), 0, 0, 0
                hashed = hashlib.sha256()
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in runs):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    hashed.update(memoryview(data)[at:a])
                    at, n, k = b, n + b - a, k + 1
                hashed.update(memoryview(data)[at:])
                removed.append(n)
                spans.append(k)
                kept.append(hashed.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
                                             names=["id", "tie", "n_removed", "n_spans", "kept_sha256"])

    text_batches(docs.sparkSession)
    return docs.select("id", "tie", "text", "runs").mapInArrow(
        digest, "id long, tie int, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, together: int = TOGETHER,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) -> one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; a null doc_id comes before all others. Rows with one doc_id are ordered by a hash of their text, and of
    rows equal in both one is kept. Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text").bitwiseAND(F.lit(0x7FFF)).cast("int"))
    narrow = written(rows.select("id", "tie", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    distinct = narrow.groupBy("id", "tie", "digest").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"))
    earliest = narrow.groupBy("digest").agg(F.min("id").alias("first_id"))
    placed = written(distinct.join(earliest, "digest").withColumn("is_first", F.col("id") == F.col("first_id")))
    copies = placed.where("NOT is_first").select("id", "tie").distinct()
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    texts = rows.join(copies, ["id", "tie"], "left_anti")

    anchors = written(_anchors(texts, length, k))
    counted = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = written(anchors.join(counted, "key", "left_semi"))
    contents = written(found.groupBy("key", "content").agg(F.min(F.struct("id", "pos")).alias("f"), F.count("*").alias("n")))
    late = (found.join(contents.where("n > 1").select("key", "content", "f"), ["key", "content"])
            .where("id <> f.id OR pos <> f.pos").selectExpr("id", f"{_TIE} AS tie", f"{_START} AS a", f"{_START} + {_SIZE} AS b"))
    several = contents.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    wanted = contents.join(several, "key", "left_semi").select("key", "f.id", "f.pos").withColumn("tie", F.expr(_TIE))
    stretches = written(wanted.join(texts, ["id", "tie"]).selectExpr(
        "key", "id", "pos", f"substring(text, CAST({_START} AS INT) + 1, CAST({_SIZE} AS INT)) AS bytes"))
    split, late_windows, n_bytes = _split(stretches, length, k, together)
    n_blocks = max(1, -(-n_bytes // block_bytes))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["id", "pos"]).sort_values(["id", "pos"], ignore_index=True)
        pos = block["pos"].to_numpy()
        which, begin, end = np.array(repeats(block["bytes"].tolist(), length), dtype=np.int64).reshape(-1, 3).T
        start = (pos[which] >> 15) & 0x1FFFFFFFF
        return pd.DataFrame({"id": block["id"].to_numpy()[which], "tie": (pos[which] >> 48).astype(np.int32),
                             "a": start + begin, "b": start + end})

    inside = (split.withColumn("block", F.pmod("key", F.lit(n_blocks)))
              .groupBy("block").applyInPandas(search, "id long, tie int, a long, b long"))
    runs = written(late.select("id", "tie", "a", "b").unionByName(late_windows).unionByName(inside))
    per_text = runs.groupBy("id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    cut = written(_rest(texts.join(per_text, ["id", "tie"]))).dropDuplicates(["id", "tie"])
    doc_id = f"nullif(id, CAST({_NULL_ID} AS BIGINT)) AS doc_id"
    firsts = placed.where("is_first").join(cut, ["id", "tie"], "left").selectExpr(
        doc_id, "n_bytes", "coalesce(n_removed, 0) AS n_removed", "coalesce(n_spans, 0) AS n_spans",
        "coalesce(kept_sha256, digest) AS kept_sha256")
    whole = f"n_bytes >= {length}"
    again = (placed.withColumn("n", F.col("n") - F.col("is_first").cast("int")).where("n > 0")
             .withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))
    return firsts.unionByName(again.selectExpr(
        doc_id, "n_bytes", f"CASE WHEN {whole} THEN n_bytes ELSE 0L END AS n_removed",
        f"CASE WHEN {whole} THEN 1L ELSE 0L END AS n_spans",
        f"CASE WHEN {whole} THEN '{hashlib.sha256().hexdigest()}' ELSE digest END AS kept_sha256"))
