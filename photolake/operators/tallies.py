"""Counts per raster: taken tile by tile where the tiles are made, moved as two arrays a tile, added up raster by raster.

A count of colours has nearly as many rows as the image has pixels, so it is never written row by row: what is exchanged and sorted is one
row per tile, and a task keeps one raster's counts at a time, however many tiles hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from photolake.session import small_batches

#: (tile of each entry, value in 0 .. 2^31 - 1, weight or None for 1), of the columns named.
Entries = Callable[[list[pa.Array]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]
#: (bounds of the rasters, values, counts) -> the columns of the result; with a first item None, or the raster of each row.
Feature = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray | None, list]]


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def lists(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def added(run: np.ndarray, value: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights added up by run and value, in their order."""
    bits, kind = 32, np.int64
    if len(run) and (int(run.max()) + 1) << (small := int(value.max()).bit_length()) < 1 << 31:  # half the bytes to sort
        bits, kind = small, np.int32
    code = (run.astype(kind) << bits) | value.astype(kind)
    if (code[1:] > code[:-1]).all():  # in order already, nothing to add
        return run, value, np.ones(len(run), np.int64) if weight is None else weight
    if weight is None:
        code.sort()
        first = np.flatnonzero(np.diff(code, prepend=kind(-1)))
        code, total = code[first], np.diff(first, append=len(code))
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=kind(-1)))
        code, total = code[first], np.add.reduceat(weight[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    code = code.astype(np.int64)
    return code >> bits, code & ((1 << bits) - 1), total


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for key in keys:
        code = pc.dictionary_encode(key, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return new


def _summed(keys: list[pa.Array], n_keys: int, row: np.ndarray, value: np.ndarray, weight: np.ndarray | None):
    """Rows of equal keys that follow each other become one: (keys, bounds, values, counts). Those without entries go."""
    new = np.append(True, _changes(keys[:n_keys]))
    run, value, total = added((np.cumsum(new) - 1)[row], value, weight)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    starts = pa.array(np.flatnonzero(new)[run[first]])
    return [key.take(starts) for key in keys], np.append(first, len(value)), value, total


def _by_raster(parts: Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray | None]], n_keys: int) -> Iterator[tuple]:
    """(keys, bounds, values, counts) of whole rasters, from (keys, row of each entry, value, weight or None for 1) in order of the keys."""
    last = None  # the last raster may go on in the next batch
    for held, row, v, n in parts:
        held, bounds, v, n = _summed(held, n_keys, row, v, n)
        if last is not None:
            end = bounds[1]
            both = [pa.concat_arrays([a, b.slice(0, 1)]) for a, b in zip(last[0], held)]
            if _changes(both[:n_keys]).any():
                held, bounds = [pa.concat_arrays([a, b]) for a, b in zip(last[0], held)], np.append(0, bounds + len(last[1]))
                v, n = np.concatenate([last[1], v]), np.concatenate([last[2], n])
            else:
                _, value, total = added(np.zeros(len(last[1]) + end, np.int64), np.concatenate([last[1], v[:end]]), np.concatenate([last[2], n[:end]]))
                bounds = np.append(0, bounds[1:] + (len(value) - end))
                v, n = np.concatenate([value, v[end:]]), np.concatenate([total, n[end:]])
        end = bounds[-2]
        last = [k.slice(len(k) - 1) for k in held], v[end:], n[end:]
        if len(bounds) > 2:
            yield [k.slice(0, len(k) - 1) for k in held], bounds[:-1], v[:end], n[:end]
    if last is not None:
        yield last[0], np.array([0, len(last[1])]), last[1], last[2]


def per_raster(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], entries: Entries, feature: Feature, schema: str,
               carry: Sequence[str] = ()) -> DataFrame:
    """``feature`` of the added-up ``entries`` of each raster: (keys, carry, columns of ``schema``). ``carry`` holds any tile's value."""
    names, n_keys = [*keys, *carry], len(keys)
    kinds = {f.name: f.dataType.simpleString() for f in tiles.select(*names).schema.fields}
    result = [part.split()[0] for part in schema.split(", ")]

    @F.arrow_udf("struct<v: array<int>, n: array<bigint>>")
    def tally(*arrays: pa.Array) -> pa.Array:
        tile, v, n = added(*entries(list(arrays)))
        bounds = pa.array(np.searchsorted(tile, np.arange(len(arrays[0]) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (v.astype(np.int32), n.astype(np.int64))], names=["v", "n"])

    def finished(held: list[pa.Array], bounds: np.ndarray, v: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        row, found = feature(bounds, v, n)
        held = held if row is None else [k.take(pa.array(row)) for k in held]
        return pd.DataFrame({**{name: k.to_pandas() for name, k in zip(names, held)}, **dict(zip(result, found))})

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            sizes = np.fromiter(map(len, frame["v"]), np.int64, len(frame))
            if sizes.sum():
                yield ([pa.array(frame[name], pa.string(), from_pandas=True) for name in names], np.repeat(np.arange(len(frame)), sizes),
                       np.concatenate(list(frame["v"])), np.concatenate(list(frame["n"])))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in _by_raster(parts(frames), n_keys):
            yield finished(*found)

    small_batches(tiles.sparkSession)
    counted = tiles.select(*names, tally(*columns).alias("c")).repartition(*keys).sortWithinPartitions(*keys)
    # Keys travel as text: pandas would turn whole numbers beside nulls into floating ones.
    done = counted.select(*[F.col(name).cast("string").alias(name) for name in names], "c.v", "c.n").mapInPandas(
        merge, ", ".join(f"{name} string" for name in names) + ", " + schema)
    return done.select(*[F.col(name).cast(kinds[name]).alias(name) for name in names], *result)


#: Tiles that are counted at a time where they meet.
MET_ROWS = 100
#: Entries of lists in one Arrow batch that a worker returns.
OUT_CELLS = 1 << 20


def per_raster_moved(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], entries: Entries,
                     feature: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]],
                     schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """As ``per_raster``, for counts that take more bytes than the tile: the ``columns`` are exchanged and counted where a raster's tiles meet.

    ``feature`` gives the raster of each row, its plain columns, and the bounds and values of its list, the last column of ``schema``.
    """
    names, n_keys = [*keys, *carry], len(keys)
    result = [part.split()[0] for part in schema.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for a in range(0, len(batch), MET_ROWS):
                    columns = batch.slice(a, MET_ROWS).columns
                    row, v, n = entries(columns[len(names):])
                    if len(v):
                        yield columns[:len(names)], row, v, n

        for held, bounds, v, n in _by_raster(parts(), n_keys):
            row, plain, ends, cells = feature(bounds, v, n)
            a = 0
            while a < len(row):  # at least one row, and no more cells than a batch may hold
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + OUT_CELLS, side="right")) - 1)
                some = pa.array(row[a:b])
                listed = pa.ListArray.from_arrays(pa.array((ends[a:b + 1] - ends[a]).astype(np.int32)), pa.array(cells[ends[a]:ends[b]]))
                yield pa.RecordBatch.from_arrays([*[k.take(some) for k in held], *[pa.array(x[a:b]) for x in plain], listed], names=[*names, *result])
                a = b

    small_batches(tiles.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in tiles.select(*names).schema.fields}
    met = tiles.select(*names, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(merge, ", ".join(f"{name} {kinds[name]}" for name in names) + ", " + schema)


def rasters(bounds: np.ndarray) -> np.ndarray:
    """The raster of each entry."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def entropy(run: np.ndarray, count: np.ndarray, runs: int, log, eps: float = 0.0) -> np.ndarray:
    """-sum p log(p + eps) of each run."""
    p = count / np.bincount(run, weights=count, minlength=runs)[run]
    return -np.bincount(run, weights=p * log(p + eps), minlength=runs)


def range_bins(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Histogram bins over each raster's own range, last bin closed; a constant raster falls into one bin."""
    run = rasters(bounds)
    low, high = np.minimum.reduceat(values, bounds[:-1])[run], np.maximum.reduceat(values, bounds[:-1])[run]
    return np.where(high > low, np.minimum((values - low) * bins // np.maximum(high - low, 1), bins - 1), 0)


def pixels(value: Callable[[np.ndarray], np.ndarray]) -> Entries:
    """One entry a pixel: ``value`` of the packed pixels."""
    def entries(columns: list[pa.Array]):
        px, tile = flat(columns[0])
        return tile, value(px.view(np.uint32)), None
    return entries
