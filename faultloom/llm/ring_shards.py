"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a point of the ring and belong to the next virtual node clockwise. A shard keeps its own
keys up to its capacity, in ring order; what overflows continues clockwise to the next virtual node
with room. Capacities differ by one row at most and add up to the number of rows, so counts are at most
one apart whatever the hashes do, and a key moves only if its shard overflows.

Only the ring's virtual nodes (their number is a parameter) meet in one place, as counts: a shard's spare
room is shared out over its virtual nodes, and walking clockwise from the point where nothing is carried,
the k-th overflowing key takes the k-th free place. That is two running sums over the ring. Rows are
ranked within their arc; arcs map to places by a join of bounded size. No Python runs on any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

NODES = 64
#: Ring points are 60-bit numbers; cells cut the ring so that an arc is found by an equality join.
POINT_BITS = 60
CELL_BITS = 12


def point(text) -> F.Column:
    """A point of the ring from the md5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, POINT_BITS // 4), 16, 10).cast("long")


def ring(spark, shards: int, nodes: int) -> DataFrame:
    """``(arc, shard, low, high)``: arc holds the points in (low, high]; the first arc also wraps around."""
    ends = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    ends = ends.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    ends = ends.withColumn("high", point(F.format_string("shard %d node %d", "shard", "node")))
    order = Window.orderBy("high", "shard", "node")
    return ends.select(
        (F.row_number().over(order) - 1).cast("int").alias("arc"),
        "shard",
        F.lag("high", 1, -1).over(order).alias("low"),
        "high",
    )


def arc_cells(arcs: DataFrame) -> DataFrame:
    """``(cell, arc, low, high)`` per arc and cell it touches; points past the last end fall to arc 0."""
    step = POINT_BITS - CELL_BITS
    last = (1 << POINT_BITS) - 1
    wrap = arcs.agg(F.max("high").alias("low")).select(
        F.lit(0).alias("arc"), "low", F.lit(last).cast("long").alias("high")
    )
    spans = arcs.select("arc", "low", "high").unionByName(wrap).where("low < high")
    cells = F.sequence(F.shiftright(F.col("low") + 1, step), F.shiftright("high", step))
    return spans.select(F.explode(cells).alias("cell"), "arc", "low", "high")


def places(loads: DataFrame, arcs: DataFrame, shards: int) -> DataFrame:
    """``(arc, first, last, shard, base)``: ranks first to last of an arc go to the shard at slots from base."""
    ring_wide = Window.partitionBy()  # over the ring's virtual nodes only
    held = arcs.join(F.broadcast(loads), "arc", "left").select(
        "arc", "shard", F.coalesce("load", F.lit(0)).cast("long").alias("load")
    )
    held = held.withColumn("total", F.sum("load").over(ring_wide))
    held = held.withColumn("room", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)"))
    by_shard = Window.partitionBy("shard").orderBy("arc")
    before = F.sum("load").over(by_shard) - F.col("load")
    stay = F.greatest(F.lit(0), F.least(F.col("load"), F.col("room") - before))
    held = held.withColumn("stay", stay).withColumn("at", before)
    whole = Window.partitionBy("shard")
    spare = F.col("room") - F.least(F.sum("load").over(whole), F.col("room"))
    held = held.withColumn("spare", spare).withColumn("node", F.row_number().over(by_shard) - 1)
    held = held.withColumn("nodes", F.count("*").over(whole))
    free = F.expr("spare * (node + 1) div nodes - spare * node div nodes")
    held = held.withColumn("free", free).withColumn("over", F.col("load") - F.col("stay"))
    around = Window.orderBy("arc")
    held = held.withColumn("carry", F.sum(F.col("over") - F.col("free")).over(around))
    held = held.withColumn("least", F.min(F.struct("carry", "arc")).over(ring_wide)["arc"])
    held = held.withColumn("size", F.count("*").over(ring_wide)).withColumn("all_over", F.sum("over").over(ring_wide))
    held = held.withColumn("turn", F.expr("(arc - least - 1 + size) % size"))
    walk = Window.orderBy("turn")
    held = held.select(
        "*",
        (F.sum("over").over(walk) - F.col("over")).alias("over_at"),
        (F.sum("free").over(walk) - F.col("free")).alias("free_at"),
        (F.sum("free").over(by_shard) - F.col("free")).alias("own_free_at"),
    )
    own = held.where("stay > 0").select(
        "arc", F.lit(0).cast("long").alias("first"), (F.col("stay") - 1).alias("last"), "shard", F.col("at").alias("base")
    )
    # Overflow and free places are intervals over one common count: cut both at all their bounds.
    bounds = held.where("over > 0").select(F.col("over_at").alias("c")).unionByName(
        held.where("free > 0").select(F.col("free_at").alias("c"))
    )
    bounds = bounds.distinct().select("c", F.lead("c").over(Window.orderBy("c")).alias("d"))
    overs = held.where("over > 0").select("arc", "stay", "over_at", "all_over", F.col("over_at").alias("c"))
    frees = held.where("free > 0").select("shard", "free_at", "own_free_at", "room", "spare", F.col("free_at").alias("c"))
    upto = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    names = ("arc", "stay", "over_at", "all_over", "shard", "free_at", "own_free_at", "room", "spare")
    cut = bounds.join(overs, "c", "left").join(frees, "c", "left")
    cut = cut.select("c", "d", *(F.last(n, True).over(upto).alias(n) for n in names))
    cut = cut.withColumn("d", F.coalesce("d", "all_over")).where("d > c")
    moved = cut.select(
        "arc",
        (F.col("stay") + F.col("c") - F.col("over_at")).alias("first"),
        (F.col("stay") + F.col("d") - F.col("over_at") - 1).alias("last"),
        "shard",
        (F.col("room") - F.col("spare") + F.col("own_free_at") + F.col("c") - F.col("free_at")).alias("base"),
    )
    return own.unionByName(moved)


def ring_shards(
    docs: DataFrame, shards: int = 40, nodes: int = NODES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``; the law is ``rows``.

    Counts of rows per shard differ by one at most and slots run gapless from 0 in each shard. Size is the
    text's UTF-8 bytes (null: none) plus 16; the checksum of a null text is that of an empty one. A key's
    point comes from the key and its text's checksum, so a key or text that many rows repeat spreads; rows
    equal in key, size and checksum are counted first and dealt out as one run of ranks. Null keys have a
    point as any other. ``grown_shard`` is null under this law. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ring")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
    )
    rows = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    rows = rows.withColumn("point", point(F.concat_ws(":", "key", "crc", "size")))
    rows = rows.withColumn("cell", F.shiftright("point", POINT_BITS - CELL_BITS))
    arcs = scratch.table(ring(spark, shards, nodes))
    cells = F.broadcast(arc_cells(arcs))  # at most shards * nodes + 2 ** CELL_BITS rows
    rows = rows.join(cells, "cell").where("point > low and point <= high")
    rows = scratch.table(rows.select("key", "size", "crc", "n", "point", "arc"))
    plan = scratch.table(places(rows.groupBy("arc").agg(F.sum("n").alias("load")), arcs, shards))
    order = Window.partitionBy("arc").orderBy("point", "key", "size", "crc")
    ranked = rows.withColumn("at", F.sum("n").over(order) - F.col("n"))
    meets = (F.col("at") <= F.col("last")) & (F.col("at") + F.col("n") - 1 >= F.col("first"))
    dealt = ranked.join(F.broadcast(plan), "arc").where(meets)
    begin, end = F.greatest("at", "first"), F.least(F.col("at") + F.col("n") - 1, F.col("last"))
    slot = F.explode(F.sequence(F.col("base") + begin - F.col("first"), F.col("base") + end - F.col("first")))
    return dealt.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
