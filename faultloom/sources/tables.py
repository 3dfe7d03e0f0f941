"""Reading and writing tables by file extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_records import read_csv
from .scratch import read_text, write_text

# Extensions (matched case-sensitively) per format.
PARQUET_SUFFIXES = (".parquet", ".parq", ".pq")
CSV_SUFFIXES = (".csv",)
NDJSON_SUFFIXES = (".jsonl", ".ndjson")

#: How CSV is written: quotes doubled, white space around a field kept.
CSV_OUT = {
    "header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"
}


def path_suffix(path: str) -> str:
    """Extension of the last path component with its dot, or an empty string."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return dot + ext if stem and ext else ""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read Parquet, CSV or NDJSON, told apart by extension.

    Give a schema for CSV and NDJSON; without one NDJSON is sampled by Spark and CSV read as text. CSV fields
    may span lines, and a file is read by as many tasks as its size asks for. As Spark's own reader does, it
    takes an empty text in CSV for null.
    """
    suffix = path_suffix(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix in PARQUET_SUFFIXES:
        return reader.parquet(path)
    if suffix in CSV_SUFFIXES:
        return read_csv(spark, path, schema)
    if suffix in NDJSON_SUFFIXES:
        return reader.json(path)
    raise ValueError(f"Unsupported file format: {suffix}")


def write_csv(df: DataFrame, path: str) -> None:
    """Write a CSV table that :func:`read_table` reads back."""
    df.write.mode("overwrite").options(**CSV_OUT).csv(path)


#: Pointer of a folder that is replaced as a whole: the name of the version that counts.
CURRENT = "_CURRENT"


def new_version(root: str) -> str:
    """A path below ``root`` for outputs that belong together; they count once :func:`publish` has named it."""
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, version: str) -> str:
    """Make a complete version the current one of its root; older ones stay whole for those who read them."""
    root, name = version.rsplit("/", 1)
    write_text(spark, f"{root}/{CURRENT}", name)
    return version


def current_version(spark: SparkSession, root: str) -> str:
    """Path of the version of ``root`` that was published last."""
    name = read_text(spark, f"{root.rstrip('/')}/{CURRENT}")
    return f"{root.rstrip('/')}/{name}"


def write_three_ways(df: DataFrame, root: str, name: str = "all_metadata") -> str:
    """Write one table as Parquet, NDJSON and CSV, as one new version of ``root``; returns the version's path.

    The Parquet copy is written first and the other two are made from it: the plan runs once and
    nothing has to be kept in executor memory. The version is published last, so that
    :func:`current_version` never names one of which a format is missing.
    """
    spark, path = df.sparkSession, new_version(root)
    df.write.parquet(f"{path}/{name}.pq")
    written = spark.read.parquet(f"{path}/{name}.pq")
    written.write.json(f"{path}/{name}.ndjson")
    write_csv(written, f"{path}/{name}.csv")
    return publish(spark, path)


def analysis_dir(path: str) -> str:
    """Sibling directory ``<stem>_analysis`` of an input table."""
    trimmed = path.rstrip("/")
    suffix = path_suffix(trimmed)
    return (trimmed[: -len(suffix)] if suffix else trimmed) + "_analysis"


def write_json_column(df: DataFrame, column: str, path: str, *keys: str) -> None:
    """Write a map column as JSON text beside its keys."""
    value = F.col(column) if dict(df.dtypes)[column] == "string" else F.to_json(column)
    df.select(*keys, value.alias(column)).write.mode("overwrite").json(path)
