"""Image files in, whole images as tiles out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from photolake.functions.fixed import IMAGE_EXTENSIONS
from photolake.session import small_batches

#: Side of a tile: 16 KB of packed pixels.
TILE = 64
#: Pixels of tiles in one Arrow batch.
BATCH_CELLS = 1 << 20
#: Pixels of small images that are packed at a time.
PACK_CELLS = 1 << 16
TILE_COLUMNS = ["image_id", "width", "height", "y0", "x0", "w", "h", "px"]
TILE_SCHEMA = "image_id bigint, width int, height int, y0 int, x0 int, w int, h int, px array<int>"


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_images(spark: SparkSession, path: str, extensions: Sequence[str] = tuple(IMAGE_EXTENSIONS)) -> DataFrame:
    """Recursive listing by extension; file content is not read unless it is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .where(extension(F.col("path")).isin(list(extensions))))


def decode_images(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Decode image files with the built-in source. A file it cannot decode keeps its row, with ``error``.

    The driver lists the files of one read; a larger tree is read some of its folders at a time.
    """
    raw = (spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false")
           .load(path if isinstance(path, str) else list(path)).select("image.*"))
    bad = F.col("height") < 1
    return raw.select(
        F.col("origin").alias("path"),
        F.when(~bad, F.col("width")).alias("width"), F.when(~bad, F.col("height")).alias("height"),
        F.when(bad, None).when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB")
        .otherwise("RGBA").alias("mode"),
        extension(F.col("origin")).alias("format"),
        F.when(~bad, F.col("width") / F.col("height")).alias("aspect_ratio"),
        F.col("nChannels").alias("n_channels"),
        F.when(~bad, F.col("data")).alias("data"),
        F.when(bad, F.lit("cannot decode")).alias("error"))


def squeezed(width: int, height: int, side: int = 100) -> tuple[int, int]:
    """The size at which palettes are taken: at most ``side`` on each side, the shape not kept, never enlarged."""
    return min(width, side), min(height, side)


def lowered(width: int, height: int, rows: int = 300) -> tuple[int, int]:
    """The size at which quality is judged: at most ``rows`` rows, the shape kept, never enlarged."""
    return (width, height) if height <= rows else (max(1, (2 * width * rows + height) // (2 * height)), rows)


def _area_sums(values: np.ndarray, m: int, axis: int) -> np.ndarray:
    """Sums over m equal intervals of an axis of n cells. A cell counts by its overlap, in units of 1 / m; an interval's weights add up to n."""
    n = values.shape[axis]
    if m == n:
        return values * n
    zero = np.zeros_like(np.take(values, [0], axis=axis))
    upto = np.concatenate([zero, np.cumsum(values, axis=axis)], axis=axis)
    whole, part = np.divmod(np.arange(m + 1, dtype=np.int64) * n, m)
    shape = [1] * values.ndim
    shape[axis] = m + 1
    at = m * np.take(upto, whole, axis=axis) + part.reshape(shape) * np.take(values, np.minimum(whole, n - 1), axis=axis)
    return np.diff(at, axis=axis)


def _resampled(bitmap: np.ndarray, width: int, height: int, rows: int = 256) -> np.ndarray:
    """Area-weighted means, rounded half up; columns are summed a band of rows at a time."""
    h, w = bitmap.shape[:2]
    bands = [_area_sums(bitmap[y:y + rows].astype(np.int64), width, 1) for y in range(0, h, rows)]
    sums = _area_sums(np.concatenate(bands), height, 0)
    return ((2 * sums + h * w) // (2 * h * w)).astype(np.uint8)


def _packed(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    gray = (299 * r + 587 * g + 114 * b + 500) // 1000
    return ((gray << 24) | (r << 16) | (g << 8) | b).astype(np.uint32, copy=False).view(np.int32)


def _bitmap(data: bytes, width: int, height: int, channels: int, bgr: bool) -> np.ndarray:
    """The RGB planes; too few bytes repeat to fill the bitmap."""
    flat, need = np.frombuffer(data, dtype=np.uint8), width * height * channels
    if len(flat) < need:
        flat = np.concatenate([flat, flat[:need - len(flat)]]) if need <= 2 * len(flat) else np.resize(flat, need)
    grid = flat[:need].reshape(height, width, channels)
    if channels == 1:
        return np.repeat(grid, 3, axis=2)
    return grid[:, :, 2::-1] if bgr else grid[:, :, :3]


@lru_cache(1 << 12)
def _mirrored(first: int, last: int, size: int) -> np.ndarray:
    """Places first - 1 .. last of an axis; the places outside are mirrored around the edge cells."""
    at = np.arange(first - 1, last + 1)
    at[at < 0] = min(1, size - 1)
    at[at >= size] = max(size - 2, 0)
    at.flags.writeable = False
    return at


def _packed_together(bitmaps: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """(image_id, raster): small bitmaps packed in one go, some ``PACK_CELLS`` pixels at a time; a larger one stays as it is."""
    def packed() -> Iterator[tuple[int, np.ndarray]]:
        flat = _packed(np.concatenate([b.reshape(-1, 3) for _, b in held]))
        ends = np.cumsum([b.size // 3 for _, b in held]).tolist()
        for (image_id, b), begin, end in zip(held, [0, *ends], ends):
            yield image_id, flat[begin:end].reshape(b.shape[:2])

    held: list[tuple[int, np.ndarray]] = []
    cells = 0
    for image_id, bitmap in bitmaps:
        if bitmap.size > 3 * PACK_CELLS:
            yield image_id, bitmap
            continue
        held.append((image_id, bitmap))
        cells += bitmap.size // 3
        if cells > PACK_CELLS:
            yield from packed()
            held, cells = [], 0
    if held:
        yield from packed()


def _cut(bitmap: np.ndarray, side: int, halo: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(y0, x0, packed pixels, the same with a border) of each tile, a band of tiles at a time. ``bitmap`` may be packed already."""
    h, w = bitmap.shape[:2]
    for y0 in range(0, h, side):
        y1 = min(y0 + side, h)
        band = bitmap[_mirrored(y0, y1, h)] if halo else bitmap[y0:y1]
        if band.ndim == 3:
            band = _packed(band)
        core = band[1:-1] if halo else band
        for x0 in range(0, w, side):
            x1 = min(x0 + side, w)
            yield y0, x0, core[:, x0:x1], band[:, _mirrored(x0, x1, w)] if halo else None


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([a.reshape(-1) for a in arrays])))


def image_tiles(images: DataFrame, bgr: bool = False, halo: bool = False, size: Callable[[int, int], tuple[int, int]] | None = None,
                side: int = TILE) -> DataFrame:
    """(image_id, width, height, data[, n_channels]) -> whole images as tiles of at most ``side`` x ``side`` pixels.

    ``px`` holds packed 0xYYRRGGBB values (Y = gray), row by row; ``y0``, ``x0`` say where the tile begins, ``width`` and
    ``height`` how large the raster is. With ``halo``, ``pad`` holds the tile with a border of one pixel, of (w + 2) x (h + 2): the
    neighbouring tiles' pixels, or those mirrored around the raster's edge. ``size`` gives the size to which an image is
    resampled first, if any. A map over Arrow batches: nothing is shuffled, no row exceeds a tile, and besides the bitmap
    itself (or a bounded number of small ones, which are packed together) only a band of tiles is in memory.
    """
    if "n_channels" not in images.columns:
        images = images.withColumn("n_channels", F.lit(3))
    names = TILE_COLUMNS + (["pad"] if halo else [])
    small_batches(images.sparkSession)

    def batch_of(tiles: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*tiles))
        arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[1:7]], *[_lists(list(c)) for c in columns[7:]]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def bitmaps(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for image_id, data, w, h, c in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
            bitmap = _bitmap(data.as_buffer(), w, h, c, bgr)
            if size is not None and size(w, h) != (w, h):
                bitmap = _resampled(bitmap, *size(w, h))
            yield image_id, bitmap

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[tuple] = []
        cells = 0
        for batch in batches:
            for image_id, bitmap in _packed_together(bitmaps(batch)):
                height, width = bitmap.shape[:2]
                for y0, x0, px, pad in _cut(bitmap, side, halo):
                    tiles.append((image_id, width, height, y0, x0, px.shape[1], px.shape[0], px, *([pad] if halo else [])))
                    cells += px.size
                    if cells > BATCH_CELLS:
                        yield batch_of(tiles)
                        tiles, cells = [], 0
        if tiles:
            yield batch_of(tiles)

    good = images.where(F.col("data").isNotNull() & (F.octet_length("data") > 0) & (F.col("width") > 0) & (F.col("height") > 0))
    return good.select("image_id", "data", "width", "height", "n_channels").mapInArrow(
        convert, TILE_SCHEMA + (", pad array<int>" if halo else ""))


def labels_from_path(images: DataFrame) -> DataFrame:
    """Class label = parent directory; class index = rank of the label among all labels."""
    labelled = images.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return labelled.join(class_index(labelled), "label").select("image_id", "path", "label", "class_index")


def class_index(labelled: DataFrame) -> DataFrame:
    """(label, class_index). The ranking sees one row per class (a model's output width), never the images."""
    classes = labelled.groupBy("label").agg(F.lit(0).alias("one"))
    return classes.select("label", (F.dense_rank().over(W.partitionBy("one").orderBy("label")) - 1)
                          .alias("class_index"))
