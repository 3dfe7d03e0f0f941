"""CSV with line ends inside quotes, read by many tasks per file.

Spark splits a file at line ends. Whether a split starts inside a quoted field is the parity of all quotes
before it: quotes are counted per split, summed up along the file, and each task then knows how to read its
lines. Records that lie in one split are put together there; of those across a border the pieces, at most two
a split, are joined by their place in the file.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts hold newlines and quotes, so fields may span lines and quotes are doubled.
CSV_OPTIONS = {"multiLine": "true", "escape": '"', "quote": '"'}

def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files in the order of each split, with file and first byte of their split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that start inside quotes; as many at most as the scan has splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = splits.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).where("odd")
    return {(r.file, r.start) for r in odd.select("file", "start").collect()}


PIECE = "record string, whole boolean, first boolean, file string, start long, tail boolean"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, first)``: the records of all files as text, ``first`` marking the first one of each file.

    A line end is ``\\n`` or ``\\r\\n``; empty records are left out. The quotes are counted when this is called.
    A quote that is open at the end of a file ends there.
    """
    lines = _lines(spark, path)
    share = spark.sparkContext.broadcast(_inside(lines))

    def run(batches):
        inside = share.value
        at, held, open_, seen, head = None, [], False, 0, False

        def piece(whole, tail):
            nonlocal seen
            row = ("\n".join(held), whole, at[1] == 0 and seen == 0, at[0], at[1], tail)
            seen += 1
            held.clear()
            return row

        for batch in batches:
            made = []
            for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != at:
                    if held:  # the split before ended inside a record
                        made.append(piece(False, not head))
                    at, seen = (file, start), 0
                    open_ = head = at in inside
                held.append(value)
                if value.count('"') % 2:
                    open_ = not open_
                if not open_:
                    made.append(piece(not head, False))
                    head = False
            yield _pieces(made)
        if held:
            yield _pieces([piece(False, not head)])

    pieces = lines.mapInArrow(run, PIECE)
    # A record across a border begins with the open end of a split and goes on with the pieces after it.
    order = Window.partitionBy("file").orderBy("start", "tail")
    parts = pieces.where("not whole").withColumn("number", F.sum(F.col("tail").cast("int")).over(order))
    listed = F.sort_array(F.collect_list(F.struct("start", "tail", "record")))
    joined = parts.groupBy("file", "number").agg(F.array_join(listed["record"], "\n").alias("record"), F.max("first").alias("first"))
    both = pieces.where("whole").select("record", "first").unionByName(joined.select("record", "first"))
    return both.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table whose files begin with a header; without a schema all columns are text under its names."""
    records = csv_records(spark, path)
    if schema is None:
        head = records.where("first").select("record").first()
        if head is None:
            return spark.createDataFrame([], T.StructType([]))
        names = next(csv.reader([head.record], strict=True))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.where("not first").select(F.from_csv("record", fields, CSV_OPTIONS).alias("r"))
    return parsed.select("r.*")


def _pieces(made) -> pa.RecordBatch:
    columns = list(zip(*made)) or [()] * 6
    kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.bool_())
    names = ("record", "whole", "first", "file", "start", "tail")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
