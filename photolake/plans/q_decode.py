"""Listing and decoding image files: documents become files in the shared folder, and are read back."""

import struct
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from photolake.operators import raster
from photolake.plans.q_collect import scratch
from photolake.plans.registry import query
from photolake.sources import images, tables


LISTED = ("jpg", "png", "gif")
#: Subfolders that the written images are dealt to, at least, and images in one of them, about.
FOLDERS = 256
IN_FOLDER = 1000
#: Images that are listed and decoded in one read, about: the driver holds a listing, so it must not grow with the table.
AT_ONCE = 1 << 15
#: What opening a small file counts for when files are dealt to tasks; Spark's default of 4 MB gives a task 32 files.
OPEN_COST = 1 << 16


def _png(data: bytes, width: int, height: int) -> bytes:
    """An RGB bitmap as an uncompressed-filter PNG; the bytes repeat to fill the grid."""
    size = width * height * 3
    flat = (data * (size // len(data) + 1))[:size]
    rows = b"".join(b"\0" + flat[y * width * 3:(y + 1) * width * 3] for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def write_pngs(bitmaps, folder: str, folders: int = FOLDERS) -> list[tuple[str, int]]:
    """One file per image, written where the tasks run; a retried task writes the same files again. Subfolders keep listings short, and
    are listed side by side: (path, images written to it) of each."""
    def write(batches):
        target, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            parts = []
            for image_id, width, height, data in zip(*(batch[c] for c in ("image_id", "width", "height", "data"))):
                name = f"{image_id}.png"
                part = f"{zlib.crc32(name.encode()) % folders:03x}"
                if part not in made:
                    target.create_dir(f"{base}/{part}", recursive=True)
                    made.add(part)
                with target.open_output_stream(f"{base}/{part}/{name}") as out:
                    out.write(_png(bytes(data), width, height))
                parts.append(part)
            yield pd.DataFrame({"part": parts})

    written = bitmaps.mapInPandas(write, "part string").groupBy("part").count().orderBy("part")
    return [(f"{folder}/{r.part}", r["count"]) for r in written.collect()]  # a row a subfolder


def write_files(files, folder: str) -> None:
    """(path, content): one file per row below ``folder``, written where the tasks run; a retried task writes the same files again."""
    def write(batches):
        target, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = f"{base}{path}"
                target.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(name) as out:
                    out.write(bytes(content))
            yield batch[["path"]]

    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


@query("list_images", views="images", sql=f"SELECT path, length FROM images WHERE format IN {tuple(LISTED)}")
def list_images(spark, d):
    """Every document as a file under its image's path; those with the extensions asked for are listed, without reading them."""
    folder = scratch(spark, "files")
    folder = folder if ":" in folder else f"file://{folder}"
    texts = tables.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"),
                                                       F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    write_files(tables.images(spark, d).select("image_id", "path").join(texts, "image_id").select("path", "content"), folder)
    return images.list_images(spark, folder, LISTED).select(F.regexp_extract("path", r"(/img/.*)$", 1).alias("path"), "length")


def groups(folders: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Folders in their order, at most ``most`` files together or one folder."""
    out, n = [], 0
    for path, files in folders:
        if not out or n + files > most:
            out.append([])
            n = 0
        out[-1].append(path)
        n += files
    return out


def decoded(spark, d):
    """Every image as a file, decoded once: what is read from the files is kept as a table. Files are listed and read some folders at a
    time, each listing in tasks, and forgotten by the driver."""
    folder, kept = scratch(spark, "png"), scratch(spark, "decoded")
    folder = folder if ":" in folder else f"file://{folder}"
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    n_docs = tables.table(spark, d, "documents").count()  # one number, read from the file footers
    parts = groups(write_pngs(tables.raw_images(spark, d), folder, max(FOLDERS, -(-n_docs // IN_FOLDER))), AT_ONCE)
    number = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long")
    settings = {"spark.sql.files.openCostInBytes": str(OPEN_COST), "spark.sql.sources.parallelPartitionDiscovery.threshold": "0",
                "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    old = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for paths in parts or [[folder]]:
            files = images.decode_images(spark, paths).withColumn("image_id", number)
            files.write.mode("append").parquet(kept)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    return spark.read.schema(files.schema).parquet(kept)


@query("decode_images", views="pix", sql="""
SELECT image_id, width, height, 'RGB' AS mode, 'png' AS format, round(width/height,6) AS aspect_ratio,
 CAST(NULL AS VARCHAR) AS error, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green,
 CAST(sum(b) AS BIGINT) AS blue FROM pix GROUP BY ALL""")
def decode_images(spark, d):
    """File facts of every decoded image, with the channel sums of its pixels."""
    files = decoded(spark, d)
    sums = (raster.explode_pixels(images.image_tiles(files, bgr=True)).groupBy("image_id")
            .agg(F.sum("r").alias("red"), F.sum("g").alias("green"), F.sum("b").alias("blue")))
    return files.join(sums, "image_id", "left").select(
        "image_id", "width", "height", "mode", "format", F.round("aspect_ratio", 6).alias("aspect_ratio"), "error",
        "red", "green", "blue")
