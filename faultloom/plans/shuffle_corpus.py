"""Shuffle: reorder code chunks across a corpus, reproducibly."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.chunking import shuffle_documents
from ..sources.tables import new_version, publish, write_json_column


def shuffle_corpus(corpus: DataFrame, *, text: str = "content", seed: int = 0, level: str = "safe") -> DataFrame:
    """Reordered texts with ``chunk_order`` and ``order_json``."""
    return shuffle_documents(corpus, text=text, seed=seed, level=level)


def write_shuffled(shuffled: DataFrame, root: str, *, key: str = "path") -> str:
    """Write texts and maps once, then the map side file from what was written, as one new version of ``root``;
    returns the version's path."""
    spark = shuffled.sparkSession
    path = new_version(root)
    shuffled.write.parquet(f"{path}/texts.pq")
    written = spark.read.parquet(f"{path}/texts.pq")
    write_json_column(written, "order_json", f"{path}/order_maps.ndjson", key)
    return publish(spark, path)
