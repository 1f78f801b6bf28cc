"""Spelling variants by permuterm rotations.

A word with its end marked, ``word$``, is rotated to every place. Two words that differ by one replaced character have a common rotation
but for its last character; a word and the same word with one more character share a rotation and a rotation but for its last character.
So each rotation is sorted under itself and under itself without its last character, and words that meet under one key are
neighbours. A key's group holds at most one word per character and the one without it, so groups are bounded by the alphabet. The scan
of a group gives each member its number of neighbours there and the best of them, never a row per pair; every
pair meets under exactly one counted key.

A rotation is as long as its word, so words of more than ``LONG`` code points meet under hashes of what stands before and
after the gap, which take one pass over the word; their pairs are verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A word is a variant of a neighbour at least so many times as frequent.
RATIO = 10
END = "$"
#: Longer words are keyed by hashes of both sides of the gap.
LONG = 256
#: Two moduli and multipliers of the polynomial hashes of long words.
MODULI = ((2147483647, 1103515245), (2147483629, 69069))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text) -> doc_id, run: maximal runs of letters (A-Z lower-cased) of at least ``min_length`` code points."""
    return docs.select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER),
                                                 F.lit(f"([a-zÀ-ÿ]{{{min_length},}})"), 1)).alias("run"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word), one row per occurrence -> word, n for words long and frequent enough."""
    return (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """(word, n) -> key, c, n: each rotation whole (c empty) and without its last character c."""
    size = "char_length(word)"
    whole = (f"transform(sequence(0, {size}), k -> named_struct('key', concat(substring(word, k + 1), '{END}', "
             "substring(word, 1, k)), 'c', ''))")
    short = (f"transform(sequence(0, {size} - 1), k -> named_struct('key', concat(substring(word, k + 2), '{END}', "
             "substring(word, 1, k)), 'c', substring(word, k + 1, 1)))")
    return words.where("word <> ''").selectExpr("n", f"inline(concat({whole}, {short}))").select("key", "c", "n")


def _neighbours(rows: pa.Table) -> pa.RecordBatch:
    """Sorted whole groups -> word, near (neighbours in the group), best_n, best."""
    key = rows["key"].combine_chunks()
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(fresh) - 1
    rows = rows.append_column("g", pa.array(group)).filter(pa.array(np.bincount(group, minlength=1)[group] > 1))
    halves = pc.split_pattern(rows["key"].combine_chunks(), END).flatten()
    tail, head = halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2)))
    c = rows["c"].combine_chunks()
    word = pc.binary_join_element_wise(head, c, tail, "")
    # The same character before the gap: the pair with the shorter word is counted where that run of characters begins.
    again = pc.and_(pc.not_equal(c, ""), pc.equal(pc.utf8_slice_codeunits(head, -1, 2**31 - 1), c))
    t = pa.table({"g": rows["g"], "n": rows["n"], "word": word, "base": pc.equal(c, ""), "again": again})
    t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("n", "descending"), ("word", "ascending")]))
    g, base, again, n = (t[x].to_numpy() for x in ("g", "base", "again", "n"))
    m = len(g)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if m else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, m))
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    count = lambda x: np.repeat(np.add.reduceat(x.astype(np.int64), first) if m else np.zeros(0, np.int64), sizes)
    near = size - 1 - np.where(base, count(again), np.where(again, count(base), 0))
    best = np.full(m, -1)
    place = np.arange(m)
    for k in range(3):  # of the first three at least one is allowed, if any is
        other = np.minimum(start + k, m - 1)
        fits = (k < size) & (other != place) & ~(base & again[other]) & ~(again & base[other]) & (best < 0)
        best[fits] = other[fits]
    some = np.flatnonzero(near > 0)
    return pa.RecordBatch.from_arrays(
        [t["word"].take(pa.array(some)).combine_chunks(), pa.array(near[some], pa.int64()), pa.array(n[best[some]], pa.int64()),
         t["word"].take(pa.array(best[some])).combine_chunks()], names=["word", "near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal keys, over the edges of batches; what is kept back is one group."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
        if not rows.num_rows:
            continue
        keys = rows["key"].combine_chunks()
        edge = pc.index(keys, keys[-1]).as_py()  # keys are sorted: the last group begins here
        kept = rows.slice(edge)
        if edge:
            yield _neighbours(rows.slice(0, edge))
    if kept is not None and kept.num_rows:
        yield _neighbours(kept)


def _sides(word: str) -> Iterator[np.ndarray]:
    """Keys of a long word: length without the gap, place of the gap, hashes of the characters before and after it."""
    x = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size, before, after = len(x), [], []
    for p, base in MODULI:
        power = np.ones(1, dtype=np.uint64)
        while len(power) <= size:
            power = np.concatenate([power, power * np.uint64(pow(base, len(power), p)) % np.uint64(p)])
        inverse = np.ones(1, dtype=np.uint64)
        while len(inverse) <= size:
            inverse = np.concatenate([inverse, inverse * np.uint64(pow(base, -len(inverse), p)) % np.uint64(p)])
        total = np.concatenate([[0], np.cumsum(x * power[:size] % np.uint64(p))]).astype(np.uint64) % np.uint64(p)
        before.append(total)
        after.append((total[size] + np.uint64(p) - total) % np.uint64(p) * inverse[:size + 1] % np.uint64(p))
    place = np.arange(size + 1, dtype=np.uint64)
    for drop, n in ((0, size + 1), (1, size)):
        yield np.stack([np.full(n, size - drop, dtype=np.uint64), place[:n], *[b[:n] for b in before], *[a[drop:] for a in after]], axis=1)


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) -> (key, id) for every place of the gap, a word at a time."""
    for batch in batches:
        for word_id, word in zip(batch.column(0), batch.column(1).to_pylist()):
            for keys in _sides(word):
                for at in range(0, len(keys), 10_000):
                    part = np.ascontiguousarray(keys[at:at + 10_000])
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(48), len(part), [None, pa.py_buffer(part)])
                    yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()), pa.array([word_id.as_py()] * len(part), pa.binary())],
                                                     names=["key", "id"])


def _long_neighbours(words: DataFrame) -> DataFrame:
    """Like ``neighbours`` before the last sum, for pairs with a word of more than ``LONG`` code points."""
    words = words.where(F.char_length("word") >= LONG).withColumn("id", F.unhex(F.sha2("word", 256)))
    groups = (words.select("id", "word").mapInArrow(_long_keys, "key binary, id binary").groupBy("key")
              .agg(F.collect_set("id").alias("ids")).where("size(ids) > 1"))  # as many as there are characters, at most
    pairs = (groups.select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("other"))
             .where("id <> other").distinct())
    far = words.selectExpr("id AS other", "word AS best", "n AS best_n")
    return (pairs.join(words.select("id", "word"), "id").join(far, "other")
            .where((F.greatest(F.char_length("word"), F.char_length("best")) > LONG) & (F.levenshtein("word", "best", 1) == 1))
            .selectExpr("word", "1L AS near", "best_n", "best"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n), words distinct -> word, n_near, best (the most frequent near word; ties: the first in code-point order), best_n.

    Words without a near word have no row.
    """
    met = (rotations(words.where(F.char_length("word") <= LONG)).repartition("key").sortWithinPartitions("key")
           .mapInArrow(_scan, "word string, near long, best_n long, best string").unionByName(_long_neighbours(words)))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best"))).alias("b"))
    return found.selectExpr("word", "n_near", "b.best AS best", "-b.neg AS best_n")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> one row per distinct word: word, form, root, n, n_near, form_n; counts of a repeated word are added.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. form is the near word of largest n
    (ties: smallest in code-point order) if that is at least ``ratio`` times the word's n, else null; root follows forms to the last.
    Null and empty words and words with a ``$`` have no neighbours; a null count is 0. Words may be of any length.
    Other columns are ignored; an empty table gives an empty table.
    """
    words = words.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    near = neighbours(words.where(f"word IS NOT NULL AND instr(word, '{END}') = 0"))
    rows = written(words.join(near, "word", "left").selectExpr(
        "word", f"CASE WHEN best_n >= {ratio} * n THEN best END AS form", "n", "coalesce(n_near, 0L) AS n_near",
        f"CASE WHEN best_n >= {ratio} * n THEN best_n END AS form_n"))
    chain = rows.where("form IS NOT NULL").selectExpr("word", "form AS root")
    while True:  # a form is ``ratio`` times as frequent, so chains are short; each round doubles the step
        ahead = chain.selectExpr("word AS at", "root AS next")
        chain = written(chain.join(ahead, F.col("root") == F.col("at"), "left").selectExpr(
            "word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"))
        moved = not chain.where("moved").isEmpty()
        chain = chain.select("word", "root")
        if not moved:
            break
    chain = chain.withColumnRenamed("word", "at")
    return rows.join(chain, F.col("word") == F.col("at"), "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
