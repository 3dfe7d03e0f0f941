"""Spreading of work whose cost the engine cannot see."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting with the number of partitions that :func:`widened` spreads a scan over; unset by default.
SCAN_PARTITIONS = "spark.faultloom.scan.partitions"


#: Rows of an Arrow batch of which a kernel holds Python objects at once.
KERNEL_ROWS = 256


def widened(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan over as many partitions as the session's ``spark.faultloom.scan.partitions`` says.

    For inputs that sit in fewer row groups than there are cores, such as a test table in one file. It is
    the caller's decision alone: without the setting no plan is changed, whatever the input's size.
    """
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted else df


def balance(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows ahead of a per-row Python kernel.

    A kernel's cost per byte is far above that of moving the byte, but AQE only sees bytes: it would
    merge the small partitions of a join into one slow task and leave a hot join key's rows together.
    The partition count is the session's shuffle setting, so it grows with the cluster.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
