"""Search by embedding, colour and style."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from photolake.functions.columns import color_distance, dot, norm
from photolake.operators.predictions import best_label
from photolake.session import ensure_checkpoint_dir, small_batches

QUERY_BLOCK = 8192
CORPUS_BLOCK = 8192
#: Queries whose similarities to a block are in memory at a time, and pairs that are computed in full at a time.
STRIP = 1024
PAIRS = 1 << 16
#: Centres that reach every task, and vectors per centre that the driver chooses them from: fixed numbers, whatever the corpus.
MAX_CENTRES = 512
CANDIDATES = 8
#: Angles closer than this count as equal, so that rounded similarities tie as they do without pruning.
SLACK = 1e-5


def semantic_search(embeddings: DataFrame, vector: Sequence[float], n: int = 100) -> DataFrame:
    """The n vectors nearest to ``vector`` by cosine; one narrow pass, then a distributed top-n.

    A zero vector has no direction and is left out.
    """
    q = F.array(*[F.lit(float(v)) for v in vector])
    length = float(np.sqrt(np.sum(np.square(np.asarray(vector, dtype=np.float64)))))
    return (embeddings.withColumn("norm", norm(F.col("embedding"))).where("norm > 0")
            .select("vec_id", (dot(F.col("embedding"), q) / (F.col("norm") * length)).alias("similarity"))
            .orderBy(F.desc("similarity"), "vec_id").limit(n))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _rows(column: pa.ListArray) -> np.ndarray:
    """Vectors as the rows of a matrix; a missing value is NaN."""
    sizes = pc.list_value_length(column).to_numpy()
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    values = pc.fill_null(column.flatten().cast(pa.float64()), math.nan).to_numpy()
    return values.reshape(len(column), int(sizes[0]) if len(sizes) else 0)


#: Stands for a missing id, which no id equals and which comes first in order.
MISSING = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), MISSING).to_numpy()


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b) & (a != MISSING)


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles to all centres and, last, to a zero vector, whose cosine with anything is 0."""
    sims = unit @ centres.T if len(centres) else np.zeros((len(unit), 0))
    return np.arccos(np.clip(np.concatenate([sims, np.zeros((len(unit), 1))], axis=1), -1, 1))


def _spread(unit: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the furthest from those before it."""
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _home(unit: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The cell of the nearest centre; zero vectors have the last cell to themselves."""
    last = angles.shape[1] - 1
    return np.where(unit.any(axis=1), angles[:, :last].argmin(axis=1) if last else last, last)


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vector) with cell and angle to its centre. Vectors with a value that is no number have no similarity and are left out."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1))
            kept = np.isfinite(rows).all(axis=1)
            unit = _unit(rows[kept])
            if len(unit):
                angles = _angles(unit, centres)
                cell = _home(unit, angles)
                angle = angles[np.arange(len(unit)), cell] * (cell < len(centres))
                some = batch.filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*some.schema.names, "cell", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(place, f"{kinds}, cell int, angle double")


class Cells(NamedTuple):
    """A stored corpus: of each cell the centre, the greatest angle to it, the vectors and their files. ``copies``: the most rows of one id."""

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    files: list[list[str]]
    folder: str
    copies: int


def store_cells(corpus: DataFrame, k: int, block: int = CORPUS_BLOCK) -> Cells:
    """Write (vec_id, vector) once to the shared folder, in blocks of at most ``block`` vectors of one cell, in order of vec_id.

    Vectors belong to the cell of the nearest centre. Of equal vectors in a block only the first k (and as many as an id may have rows)
    are kept: all have the same similarity to a query, and vec_id decides.
    """
    spark = corpus.sparkSession
    n_centres = min(MAX_CENTRES, max(1, -(-corpus.count() // block)))
    some = (corpus.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CANDIDATES * n_centres)
            .select("vector").collect())
    usable = [v for v in (np.array(r.vector, dtype=np.float64) for r in some) if np.isfinite(v).all()]
    centres = _spread(_unit(np.array(usable)), n_centres) if usable else np.zeros((0, 0))
    copies = corpus.where("vec_id IS NOT NULL").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    folder = f"{ensure_checkpoint_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"

    def write(cell: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        radius = pc.max(table["angle"]).as_py()
        ids = _ids(table["vec_id"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        rows = np.ascontiguousarray(_rows(table["vector"].combine_chunks())[order])
        if rows.shape[1]:
            equal = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
            by_value = np.argsort(equal, kind="stable")
            place = np.empty(len(order), np.int64)
            place[by_value] = np.arange(len(order)) - np.searchsorted(equal[by_value], equal[by_value])
            order = order[place < k + copies]
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        table, name = table.select(["vec_id", "vector"]).take(pa.array(order)).combine_chunks(), f"{uuid.uuid4().hex}.arrow"
        with target.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([name]), pa.array([len(order)], pa.int64()), pa.array([radius])],
                                          names=["cell", "name", "n", "radius"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cell = [], 0, -1
        for batch in batches:
            cells, a = batch.column("cell").to_numpy(), 0
            while a < len(cells):
                if n and (n == block or cells[a] != cell):
                    yield write(cell, held)
                    held, n = [], 0
                cell = int(cells[a])
                b = min(a + block - n, int(np.searchsorted(cells, cell, side="right")))  # in order of cell
                held.append(batch.slice(a, b - a))
                n, a = n + b - a, b
        if n:
            yield write(cell, held)

    small_batches(spark, block)
    dealt = _placed(corpus, centres).repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    radius, size = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, dtype=np.int64)
    files: list[list[str]] = [[] for _ in size]
    for r in dealt.mapInArrow(store, "cell int, name string, n bigint, radius double").collect():  # a row a block
        radius[r.cell], size[r.cell] = max(radius[r.cell], r.radius), size[r.cell] + r.n
        files[r.cell].append(r.name)
    return Cells(centres, radius, size, files, folder, copies)


def _lower(unit: np.ndarray, angles: np.ndarray, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(no vector of a cell is at a smaller angle to a query than this, which cells a query has to meet).

    By the triangle inequality for angles no vector of a cell is nearer to a query than the centre's angle less the radius, and none
    is further than their sum. The sums of the nearest cells that hold k vectors besides the query's own bound the k-th
    neighbour, so cells whose difference is above that bound are not met.
    """
    # A zero vector's cosine is 0 with all, whatever the cell's radius.
    reach = np.where(unit.any(axis=1)[:, None], cells.radius[None, :], 0.0)
    furthest = np.where(cells.size > 0, angles + reach, np.inf)
    order = np.argsort(furthest, axis=1)
    enough = np.cumsum(cells.size[order], axis=1) >= k + cells.copies
    bound = np.where(enough.any(axis=1), np.take_along_axis(
        furthest, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0], np.inf)
    return angles - reach, (angles - reach <= bound[:, None] + SLACK) & (cells.size > 0)


class _Block(NamedTuple):
    ids: np.ndarray
    unit: np.ndarray
    low: np.ndarray


def _reader(folder: str) -> Callable[[str], _Block]:
    def read(name: str) -> _Block:
        with source.open_input_file(f"{base}/{name}") as file:
            table = pa.ipc.open_file(file).read_all().combine_chunks()
        unit = _unit(_rows(table["vector"].combine_chunks()))
        return _Block(_ids(table["vec_id"].combine_chunks()), unit, unit.astype(np.float32))

    source, base = fs.FileSystem.from_uri(folder)
    return read


def _true(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a large mask that is nearly empty: eight places at a time."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class _Nearest:
    """The k nearest so far of a number of queries: ``sims`` and ``ids``, best first, -inf where there is none yet."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, copies: int):
        self.of, self.unit, self.k, self.copies = ids, unit, k, copies
        self.low, self.zero = unit.astype(np.float32), ~unit.any(axis=1)
        self.sims, self.ids = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.least = np.full(len(ids), -np.inf)
        #: More than what rounding to 32 bits can add to a product of unit vectors or take from it.
        self.error = (unit.shape[1] + 8) * 2.0 ** -23

    def meet(self, q: np.ndarray, block: _Block) -> None:
        """Queries ``q`` with a block: products in 32 bits leave few pairs that may be among the k best; these are computed in full."""
        sims = self.low[q] @ block.low.T
        first = min(self.k + self.copies, len(block.ids))
        sims[self.zero[q], first:] = -3  # all are at 0: vec_id decides
        bar = np.maximum(self.least[q] - 2 * self.error, -2)
        new = np.flatnonzero(np.isneginf(self.least[q]))
        if len(new) and len(block.ids) > self.k + self.copies:
            others = np.where(_same(self.of[q[new]][:, None], block.ids[None, :]), np.float32(-3), sims[new])
            bar[new] = np.maximum(np.partition(others, -self.k, axis=1)[:, -self.k] - 3 * self.error, -2)
        hits = _true(sims >= bar.astype(np.float32)[:, None])
        for a in range(0, len(hits), PAIRS):
            row, col = np.divmod(hits[a:a + PAIRS], len(block.ids))
            row = q[row]
            other = ~_same(self.of[row], block.ids[col])
            row, col = row[other], col[other]
            exact = np.einsum("ij,ij->i", self.unit[row], block.unit[col])
            near = exact >= self.least[row] - self.error
            if near.any():
                self._add(row[near], exact[near], block.ids[col[near]])

    def _add(self, row: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        there = np.unique(row)
        row = np.concatenate([np.repeat(there, self.k), row])
        sims, ids = np.concatenate([self.sims[there].ravel(), sims]), np.concatenate([self.ids[there].ravel(), ids])
        # Twelve digits decide the order, so equal vectors tie whatever the summation order.
        digits = np.round(sims, 12)
        order = np.lexsort((ids, -digits, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.sims[row[order], rank], self.ids[row[order], rank] = sims[order], ids[order]
        self.least[there] = np.round(self.sims[there, -1], 12)


def _nearest(ids: np.ndarray, unit: np.ndarray, cells: Cells, k: int, read: Callable[[str], _Block]) -> _Nearest:
    """The k nearest of each query, cell by cell, the near ones first: a cell that can hold none better is not met."""
    found = _Nearest(ids, unit, k, cells.copies)
    angles = _angles(unit, cells.centres)
    lower, met = _lower(unit, angles, cells, k)
    for cell in np.argsort(angles.mean(axis=0), kind="stable"):
        for name in cells.files[cell]:
            q = np.flatnonzero(met[:, cell] & (lower[:, cell] <= np.arccos(np.clip(found.least, -1, 1)) + SLACK))
            if not len(q):
                break
            block = read(name)
            for a in range(0, len(q), STRIP):
                found.meet(q[a:a + STRIP], block)
    return found


def _asking(queries: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, target) with cell and angle."""
    return _placed(queries.where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target")), cells.centres)


def _stored(corpus: DataFrame, k: int, block: int) -> Cells:
    return store_cells(corpus.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("vector")), k, block)


def neighbor_blocks(queries: DataFrame, corpus: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK,
                    corpus_block: int = CORPUS_BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``batch_neighbors`` has to read: (query_id, qcell, cell) before any similarity is known, and (cell, name) of the stored blocks."""
    cells = _stored(corpus, k, corpus_block)
    asking = _asking(queries, cells)
    kind = asking.schema["query_id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_rows(batch.column(1)))
            row, cell = np.nonzero(_lower(unit, _angles(unit, cells.centres), cells, k)[1])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(cell.astype(np.int32))],
                                             names=["query_id", "qcell", "cell"])

    left = asking.mapInArrow(meet, f"query_id {kind}, qcell int, cell int")
    blocks = [(cell, name) for cell, names in enumerate(cells.files) for name in names]
    return left, queries.sparkSession.createDataFrame(blocks, "cell int, name string")


def batch_neighbors(queries: DataFrame, corpus: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK,
                    corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """The k nearest corpus vectors of every query (itself left out), exact.

    The corpus is stored once, in blocks by cell (``store_cells``). Queries are dealt out by cell; a task keeps the k best of its queries
    and reads the blocks that may hold better ones, one at a time. So neither vectors nor pairs are multiplied by
    the blocks they meet: disk grows with the tables, memory with the blocks.
    """
    cells = _stored(corpus, k, corpus_block)
    asking = _asking(queries, cells)
    tasks = max(1, -(-queries.count() // query_block))

    def answer(held: list[pa.RecordBatch], read: Callable[[str], _Block]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = _ids(table["query_id"].combine_chunks())
        found = _nearest(ids, _unit(_rows(table["target"].combine_chunks())), cells, k, read)
        row, rank = np.nonzero(found.sims > -np.inf)
        of, near = ids[row], found.ids[row, rank]
        return pa.RecordBatch.from_arrays([pa.array(of, mask=of == MISSING), pa.array(near, mask=near == MISSING), pa.array(found.sims[row, rank])],
                                          names=["query_id", "vec_id", "similarity"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held, n = _reader(cells.folder), [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= query_block:
                yield answer(held, read)
                held, n = [], 0
        if n:
            yield answer(held, read)

    dealt = asking.repartitionByRange(tasks, "cell", F.xxhash64("query_id"))
    tops = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, similarity double")
    # An id may have several rows.
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def color_search(colors: DataFrame, color: tuple[int, int, int], n: int = 100) -> DataFrame:
    """Images whose mean colour is nearest to ``color``."""
    d = color_distance((F.col("r"), F.col("g"), F.col("b")), color)
    return colors.select("image_id", d.alias("distance")).orderBy("distance", "image_id").limit(n)


def style_search(predictions: DataFrame, style: str, n: int = 100) -> DataFrame:
    """The first n images, by id, whose most likely style is ``style``."""
    return best_label(predictions).where(F.col("label") == style).select("image_id", "confidence").orderBy(
        "image_id").limit(n)
