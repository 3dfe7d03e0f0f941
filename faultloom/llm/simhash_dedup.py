"""SimHash near-duplicates through vantage-point trees over Hamming distance.

Every text gets a 64-bit fingerprint. The distinct fingerprints are routed down a vantage-point tree whose
vantage points come from a bounded sample: each lives in one leaf shard and also visits the later shards
that its ball of radius ``radius`` overlaps, by the triangle inequality. Each shard builds its own
vantage-point tree and compares exactly at the leaves, so all pairs within the radius are found; only a
spanning forest of them leaves a shard, and the forests' union gives the components.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, free_name

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints a leaf shard should hold, and the sampled ones that steer each split.
SHARD_ROWS = 4_096
PER_SHARD = 16
#: Bound of the sample, and so of the routing tree that tasks receive (8 bytes each).
SAMPLE_ROWS = 65_536
LEAF = 256


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; zero without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles = words
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    count = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 16_384):
        part = hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > count, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` per row, the fingerprint as a signed long; null texts count as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInArrow(run, f"key {kind}, fp long")


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def plant(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree in heap order; near is at most the radius."""
    vantages = np.zeros(1 << depth, np.uint64)
    radii = np.zeros(1 << depth, np.int64)

    def grow(node, points):
        if node >= 1 << depth:
            return
        if len(points):
            trials = points[:: max(1, len(points) // 8)][:8]
            spread = [distances(points, v).var() for v in trials]
            vantages[node] = trials[int(np.argmax(spread))]
            far = distances(points, vantages[node])
            radii[node] = int(np.median(far))
            grow(2 * node, points[far <= radii[node]])
            grow(2 * node + 1, points[far > radii[node]])

    grow(1, sample)
    return vantages, radii


def route(points: np.ndarray, vantages, radii, depth: int, radius: int):
    """``(leaf, row, home)`` of every point: its home shard and the later shards its ball overlaps."""
    rows = np.arange(len(points))
    nodes = np.ones(len(points), np.int64)
    home = np.ones(len(points), bool)
    for _ in range(depth):
        far = np.bitwise_count(points[rows] ^ vantages[nodes]).astype(np.int64)
        inside = far <= radii[nodes]
        low = (home & inside) | (far <= radii[nodes] + radius)
        high = (home & ~inside) | (far > radii[nodes] - radius)
        nodes, rows, home = (
            np.concatenate([2 * nodes[low], 2 * nodes[high] + 1]),
            np.concatenate([rows[low], rows[high]]),
            np.concatenate([home[low] & inside[low], home[high] & ~inside[high]]),
        )
    at = np.zeros(len(points), np.int64)
    at[rows[home]] = nodes[home]
    keep = home | (nodes > at[rows])  # a pair across shards is found once, in the later one
    return nodes[keep], rows[keep], home[keep]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find by whole arrays: labels point to the least member of their set."""
    while True:
        low, other = labels[a], labels[b]
        apart = low != other
        if not apart.any():
            return labels
        a, b, low, other = a[apart], b[apart], low[apart], other[apart]
        least = np.minimum(low, other)
        np.minimum.at(labels, np.maximum(low, other), least)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up


def shard_forest(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Labels that join all pairs within ``radius`` of which one at least lives in the shard."""
    labels = np.arange(len(points))
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        mine, asking = todo.pop()
        if not len(mine) or not len(asking):
            continue
        split = None
        if len(mine) > LEAF:
            split = _split(points, mine, asking, radius)
        if split:
            todo += split
            continue
        for at in range(0, len(mine), LEAF):  # an inseparable ball holds a bounded number of fingerprints
            part = mine[at : at + LEAF]
            for begin in range(0, len(asking), 8192):
                ask = asking[begin : begin + 8192]
                near = np.bitwise_count(points[part][:, None] ^ points[ask][None, :]) <= radius
                a, b = np.nonzero(near)
                labels = join_labels(labels, part[a], ask[b])
    return labels


def _split(points, mine, asking, radius):
    for vantage in points[mine[:: max(1, len(mine) // 4)][:4]]:
        far = distances(points[mine], vantage)
        middle = int(np.median(far))
        near = far <= middle
        if near.all() or not near.any():
            continue
        ask = distances(points[asking], vantage)
        low, high = asking[ask <= middle + radius], asking[ask > middle - radius]
        if len(low) < len(asking) or len(high) < len(asking):
            return [(mine[near], low), (mine[~near], high)]
    return None


def fingerprint_classes(scratch: Scratch, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, first_key, component)`` per distinct fingerprint; component is the class's least key."""
    spark = prints.sparkSession
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("key").alias("first_key")))
    total = nodes.count()
    depth = max(0, min(12, int(np.ceil(np.log2(max(1, total / SHARD_ROWS))))))
    wanted = min(SAMPLE_ROWS, PER_SHARD << depth)
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()
    vantages, radii = plant(np.array([r.fp for r in sample], np.int64).view(np.uint64), depth)

    def deal(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False)
            leaf, row, home = route(points.view(np.uint64), vantages, radii, depth, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(points[row]), pa.array(home)], ["leaf", "fp", "home"]
            )

    def link(table):
        points = table.column("fp").to_numpy()
        labels = shard_forest(points.view(np.uint64), table.column("home").to_numpy(), radius)
        joined = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": points[joined], "b": points[labels[joined]]})

    dealt = nodes.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean")
    edges = scratch.table(dealt.groupBy("leaf").applyInArrow(link, "a long, b long"))
    found = components(scratch, edges)
    joined = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "first_key", F.coalesce("component", "fp").alias("root")
    )
    joined = scratch.table(joined, replaces=nodes)
    roots = joined.groupBy("root").agg(F.min("first_key").alias("component"))
    return joined.join(roots, "root").select("fp", "first_key", "component")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(key, fingerprint, component_id)`` per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest key reachable over
    fingerprints at most ``radius`` bits apart. Null and empty texts have fingerprint zero, which links
    like any other. Repeated rows stay rows of their own. A null key gets a class but never names one; a
    class of null keys alone has a null id. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, key, text))
    classes = fingerprint_classes(scratch, prints, radius)
    return prints.join(classes, "fp").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest key, of the least text where keys repeat.

    All columns stay. Rows whose key is null stay only where their class has no key at all.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    stamp = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    prints = scratch.table(_stamped(docs, key, text, stamp))
    classes = fingerprint_classes(scratch, prints.select("key", "fp"), radius)
    held = prints.join(classes, "fp").where(F.col("key").eqNullSafe(F.col("component")))
    root = F.coalesce(F.col("component").cast("string"), F.hex("fp"))
    chosen = held.groupBy(root.alias("root"), "key").agg(F.min("stamp").alias("stamp"), F.count("*").alias("n"))
    own, k, s, n = (free_name(docs, name) for name in ("_row_stamp", "_k", "_s", "_n"))
    chosen = scratch.table(chosen.select(F.col("key").alias(k), F.col("stamp").alias(s), F.col("n").alias(n)))
    rows = docs.withColumn(own, stamp).join(chosen, F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(s)))
    single = rows.where(F.col(n) == 1).select(*docs.columns)
    more = rows.where(F.col(n) > 1).dropDuplicates([k, s]).select(*docs.columns)
    return single.unionByName(more)


def _stamped(docs, key, text, stamp):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["key", "fp", "stamp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), stamp.alias("stamp"))
    return out.mapInArrow(run, f"key {kind}, fp long, stamp string")
