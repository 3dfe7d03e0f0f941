"""The confusion matrix kept up to date while a response log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import percent
from ..operators.evaluation import ACTUAL, EXPECTED, with_labels
from ..schemas import RESPONSES


def response_stream(spark: SparkSession, log_dir: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New rows of an append-only NDJSON log directory."""
    return (
        spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(log_dir)
    )


def running_counts(responses: DataFrame) -> DataFrame:
    """Counts per (expected, actual): a handful of state rows however long the stream runs."""
    return with_labels(responses).groupBy(EXPECTED, ACTUAL).agg(F.count("*").alias("count"))


def with_percent(counts: DataFrame) -> DataFrame:
    """Share of all rows; applied to each emitted result, since it needs the grand total."""
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(EXPECTED, ACTUAL, "count", percent(F.col("count"), total).alias("percent"))


def follow_log(spark: SparkSession, log_dir: str, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Rewrite ``out`` (Parquet) with the current matrix after every batch."""
    writer = (
        running_counts(response_stream(spark, log_dir))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: with_percent(batch).write.mode("overwrite").parquet(out))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
