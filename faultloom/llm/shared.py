"""Shared folder, scratch tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables in the shared folder that cut lineage and can be dropped as soon as nothing reads them.

    They survive the loss of executors, unlike cached or locally checkpointed data.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def table(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and read it back; ``replaces`` is an earlier scratch table to drop."""
        where = self.path()
        df.write.parquet(where)
        self.release()
        back = self.spark.read.schema(df.schema).parquet(where)
        back.scratch_path = where
        if replaces is not None:
            self.drop(replaces)
        return back

    def release(self) -> None:
        """Let the driver notice that the shuffle files of finished steps are no longer referred to."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: one row ``(node, component)`` per node.

    The component is the least node reachable. Large-star and small-star steps alternate until nothing
    changes; both pre-aggregate minima and then join them back, so a hub is a skewed join side that AQE
    can split and never a collected list. Self-loops keep their node. No edges give no rows.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = scratch.table(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(large.where("a <> b").distinct(), replaces=now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.table(small.distinct(), replaces=large)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).unionByName(loops).distinct()
    roots = roots.join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    )
