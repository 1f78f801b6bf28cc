"""Sinks: metadata exports, organised images, and collection state."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from photolake.operators.collect import ERRORS, ITEMS, RUNS, State


def export_metadata_json(metadata: DataFrame, path: str) -> None:
    """One JSON record per image; nested structs are kept."""
    metadata.write.mode("overwrite").json(path)


def csv_frame(*parts: DataFrame) -> DataFrame:
    """Union over all columns in sorted order; nested values become JSON text."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    flat = []
    for f in sorted(union.schema.fields, key=lambda f: f.name):
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        value = F.to_json(f.name) if nested else F.base64(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name)
        flat.append(value.cast("string").alias(f.name))
    return union.select(*flat)


def export_metadata_csv(path: str, *parts: DataFrame) -> None:
    csv_frame(*parts).write.mode("overwrite").option("header", True).csv(path)


def export_metadata(metadata: DataFrame, path: str, output_format: str = "json") -> None:
    """JSON or CSV; an unknown format falls back to JSON."""
    if output_format == "csv":
        export_metadata_csv(path, metadata)
    else:
        export_metadata_json(metadata, path)


def write_organised(metadata: DataFrame, path: str) -> None:
    """One record per image, split into person and other folders."""
    metadata.write.mode("overwrite").partitionBy("is_person").json(path)


TABLES = {"items": ITEMS, "errors": ERRORS, "runs": RUNS}
MANIFEST = "saved_ts string, digests map<string,string>"


def _digest(frame: DataFrame) -> str:
    """Rows and content of a table, whatever the order of rows."""
    # to_json, since maps cannot be hashed
    content = F.xxhash64(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~")).alias(c) if not isinstance(
        frame.schema[c].dataType, MapType) else F.array_sort(F.map_entries(c)).alias(c) for c in frame.columns])))
    row = frame.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(content), F.lit(0)).alias("x"),
                    F.coalesce(F.sum(content.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row['n']}:{row['x']}:{row['s']}"


def _folder(path: str, saved_ts: str, name: str) -> str:
    return f"{path}/saves/{saved_ts.replace(':', '-')}/{name}"


def save_state(state: State, path: str, saved_ts: str) -> None:
    """Write the state under its timestamp, then its manifest, which holds a digest of every table as it can be read back; without it
    the save does not exist. The same save again replaces it.
    """
    spark = state.items.sparkSession
    digests = {}
    for name, schema in TABLES.items():
        getattr(state, name).write.mode("overwrite").parquet(_folder(path, saved_ts, name))
        digests[name] = _digest(spark.read.schema(schema).parquet(_folder(path, saved_ts, name)))
    manifest = spark.createDataFrame([(saved_ts, digests)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{saved_ts.replace(':', '-')}")


def load_state(spark: SparkSession, path: str) -> State | None:
    """The newest state that can be read whole, or None.

    Saves are tried from the newest on; one whose tables cannot be read, or do not agree with their digests, is passed over.
    """
    try:
        manifests = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").parquet(
            f"{path}/manifests").collect()  # a row per save
    except (PySparkException, Py4JJavaError):
        return None
    for saved in sorted(manifests, key=lambda r: r["saved_ts"], reverse=True):
        try:
            frames = {name: spark.read.schema(schema).parquet(_folder(path, saved["saved_ts"], name)) for name, schema in TABLES.items()}
            if all(_digest(frame) == saved["digests"][name] for name, frame in frames.items()):
                return State(**frames)
        except (PySparkException, Py4JJavaError):
            continue
    return None
