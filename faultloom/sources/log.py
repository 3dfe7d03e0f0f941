"""A log of records that jobs add to, once each.

The log is a folder of NDJSON files that any reader opens. A run writes its rows to a hidden folder beside
them, Spark's ``_SUCCESS`` mark being its manifest: with it the run's files are moved into the log one by one,
without it they are none of the log's. A run that ended between two moves is finished by the next one, and
rows whose key the log has are never added, so repeating a run, whole or in part, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.responses import one_per_key
from .scratch import file_system

# Hidden from readers by its first letter.
RUNS = "_runs"
DONE = "_SUCCESS"


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a log; none if it does not exist yet."""
    files, place = file_system(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def settle_log(spark: SparkSession, path: str) -> int:
    """Finish runs that were written but not all moved, drop those that were not; returns the files moved."""
    files, place = file_system(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    runs = Path(place, RUNS)
    moved = 0
    for run in files.listStatus(runs) if files.exists(runs) else []:
        if files.exists(Path(run.getPath(), DONE)):
            for part in files.listStatus(run.getPath()):
                name = part.getPath().getName()
                if name.startswith(("_", ".")):
                    continue
                if not files.rename(part.getPath(), Path(place, f"{run.getPath().getName()}-{name}")):
                    raise OSError(f"could not move {part.getPath()}")
                moved += 1
        files.delete(run.getPath(), True)
    return moved


def append_log(df: DataFrame, path: str, *, key: str = "uuid") -> None:
    """Add the rows of ``df`` whose key the log does not have, one per key; the plan of ``df`` runs once.

    Of rows of one key the one added is that of :func:`one_per_key`; a row without a key fails the job. One
    job adds to a log at a time, any number may read it.
    """
    spark = df.sparkSession
    settle_log(spark, path)
    run = f"{path.rstrip('/')}/{RUNS}/run-{uuid.uuid4().hex}"
    kind = df.schema[key].dataType
    sure = F.coalesce(F.col(key), F.raise_error(F.lit("a log row without a key")).cast(kind))
    single = one_per_key(df.withColumn(key, sure), key=key, order=next(c for c in df.columns if c != key))
    known = read_log(spark, path, df.schema).select(F.col(key).alias("_known")).distinct()
    fresh = single.join(known, single[key] == known["_known"], "left_anti")
    fresh.write.json(run)
    settle_log(spark, path)
