"""Token ids of documents in grammar-compressed binary shards.

Documents are placed in ascending doc_id order over range partitions; each partition cuts its documents into shards of
about SHARD ids. In a shard frequent pairs of adjacent symbols are replaced by new symbols (nonterminals), again and
again, until no pair is
frequent or a round gains little; pairs never reach over a document's end. A shard is one row of a Parquet table:

* ``rules``: little-endian uint32 pairs; rule r stands for symbol FIRST_RULE + r,
* ``expansions``: uint32, ids that each rule expands to,
* ``symbols``: uint32, the compressed sequence,
* ``doc_ids``, ``doc_symbols`` (symbols before each document, and their number at last), ``doc_ids_count``.

So a document, or any range of its ids, is decoded from its own symbols alone: expansion lengths tell where a
position lies. Spark writes the shards, so a lost task leaves nothing half written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from photolake.llm.base import text_batches, written
from photolake.llm.bpe import FILE, encoder
from photolake.llm.words import slices

SHARD = 1 << 20
FIRST_RULE = 1 << 17
END_ID = 0
#: A pair is frequent if it occurs this often in its shard.
FREQUENT = 128
#: Pairs replaced at a time; they are counted in 2**HASH_BITS cells first.
AT_ONCE = 4096
#: The last round is one that shortens the sequence by less than this share.
MIN_GAIN = 0.02
HASH_BITS = 20


def compress(ids: np.ndarray, is_last: np.ndarray, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, is_last of symbols, rules) for ids; ``is_last`` marks each document's last id."""
    seq, last, cells = ids.astype(np.uint32), is_last.copy(), 1 << HASH_BITS
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq) > 1:
        cell = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - HASH_BITS)
        at = np.flatnonzero((np.bincount(cell, minlength=cells) >= frequent)[cell] & ~last[:-1])
        cell, pairs = cell[at], (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        # A cell stands for the pair that comes last in it; other pairs of the cell wait for a later round.
        owner = np.zeros(cells, dtype=np.uint64)
        owner[cell] = pairs
        own = owner[cell] == pairs
        at, cell = at[own], cell[own]
        often = np.bincount(cell, minlength=cells)
        top = np.flatnonzero(often >= frequent)
        if not len(top):
            break
        top = top[np.argsort(-often[top], kind="stable")[:AT_ONCE]]
        rank_of = np.full(cells, -1, dtype=np.int64)
        rank_of[top] = np.arange(len(top))
        rank = rank_of[cell]
        at, rank = at[rank >= 0], rank[rank >= 0]
        # Of neighbouring occurrences, every second one from the first is replaced.
        begin = np.diff(at, prepend=-2) != 1
        run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        good = (np.arange(len(at)) - run) % 2 == 0
        at, rank = at[good], rank[good]
        pair = owner[top]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[at] = (FIRST_RULE + n_rules + rank).astype(np.uint32)
        last[at] = last[at + 1]
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        seq, last = seq[stays], last[stays]
        n_rules += len(top)
        if len(at) < MIN_GAIN * len(last):
            break
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule only uses rules before it."""
    out = [1] * len(rules)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - FIRST_RULE] if a >= FIRST_RULE else 1) + (out[b - FIRST_RULE] if b >= FIRST_RULE else 1)
    return np.array(out, dtype=np.uint32)


class Grammar:
    """A shard's rules, ready to expand symbols."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        self.lengths = np.concatenate([np.ones(FIRST_RULE, dtype=np.int64), lengths.astype(np.int64)])
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.flat = np.zeros(int(ends[-1]), dtype=np.uint32)
        self.flat[:FIRST_RULE] = np.arange(FIRST_RULE)
        for r, pair in enumerate(rules.tolist()):
            at = int(self.starts[FIRST_RULE + r])
            for x in pair:
                n = int(self.lengths[x])
                self.flat[at:at + n] = self.flat[self.starts[x]:self.starts[x] + n]
                at += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        upto = np.cumsum(sizes)
        index = np.repeat(self.starts[symbols] - upto + sizes, sizes)
        index += np.arange(len(index))
        return self.flat[index]

    def part(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the expansion; only the symbols that hold them are expanded."""
        upto = np.cumsum(self.lengths[symbols])
        a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left") + 1
        before = int(upto[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before:stop - before]


_FIELDS = [("part", pa.int32()), ("shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
           ("doc_symbols", pa.list_(pa.int64())), ("doc_n_ids", pa.list_(pa.int64())), ("rules", pa.binary()),
           ("expansions", pa.binary()), ("symbols", pa.binary())]
_SCHEMA = ("part int, shard long, n_ids long, doc_ids array<long>, doc_symbols array<long>, doc_n_ids array<long>, "
           "rules binary, expansions binary, symbols binary")


def token_shards(docs: DataFrame, file: str = FILE) -> DataFrame:
    """(doc_id, text) -> shard rows, numbered in doc_id order inside each ``part``, parts being in order.

    Null and empty texts have the end id alone. A null doc_id stands first; repeated rows stay, equal ids ordered by a
    hash of their text. Other columns are ignored; an empty table gives no shard.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file)
        shard, waiting, n_waiting, part = 0, [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal shard, waiting, n_waiting
            ids = np.concatenate([x[1] for x in waiting])
            sizes = np.concatenate([x[2] for x in waiting])
            doc_ids = [d for x in waiting for d in x[0]]
            is_last = np.zeros(len(ids), dtype=bool)
            is_last[np.cumsum(sizes) - 1] = True
            symbols, last, rules = compress(ids, is_last)
            row = [part, shard, len(ids), doc_ids, [0, *(np.flatnonzero(last) + 1).tolist()], sizes.tolist(),
                   rules.astype("<u4").tobytes(), expansion_lengths(rules).astype("<u4").tobytes(),
                   symbols.astype("<u4").tobytes()]
            shard, waiting, n_waiting = shard + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FIELDS)],
                                              names=[n for n, _ in _FIELDS])

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for first, texts in slices(batch.column(1), 1 << 20):
                ids, bounds = coder.encode(texts.to_pylist(), END_ID)
                waiting.append((batch.column(0).slice(first, len(texts)).to_pylist(), ids, np.diff(bounds)))
                n_waiting += len(ids)
                if n_waiting >= SHARD:
                    yield close()
        if waiting:
            yield close()

    text_batches(docs.sparkSession)
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
              .sortWithinPartitions("doc_id", "tie"))
    return placed.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, _SCHEMA)


def write(docs: DataFrame, path: str, file: str = FILE) -> None:
    token_shards(docs, file).write.mode("overwrite").parquet(path)


def read(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Shard rows -> one row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    asked for, ids. Starts come from the counts alone: per part, then over parts, then inside the part."""
    names = ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar(np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expansions"], "<u4"))
                ids = grammar.expand(np.frombuffer(row["symbols"], "<u4")).astype("<u4")
                ends = np.cumsum(row["doc_n_ids"])
                raw = memoryview(ids.tobytes())
                starts = (ends - row["doc_n_ids"]).tolist()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends.tolist())]
                n = len(starts)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int64()),
                           pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                           pa.array(row["doc_n_ids"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([*starts, len(ids)], pa.int32()),
                                                            pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spark = shards.sparkSession
    text_batches(spark, 4)
    docs = shards.mapInArrow(decode, "part int, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"
                             + ", ids array<int>" * with_ids)
    counts = shards.select("part", "shard", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = (counts.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
              .select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base")))
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_and_read(docs: DataFrame, file: str = FILE) -> DataFrame:
    """Write the shards in the shared folder and read the documents back from them."""
    return read(written(token_shards(docs, file)))
