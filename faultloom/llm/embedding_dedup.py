"""Embedding near-dedup: one HNSW graph per shard, every shard queried, verified cosine, union of components.

Equal vectors are one class with a count. Classes are hashed into shards of bounded size and each shard
builds a graph. A recall audit against brute force over a bounded set of audit vectors that have links
doubles the beam until enough links are found; where the widest beam misses too many, shards are searched
exactly, in blocks. A query whose beam ends within links widens its own beam, at last to an exact search. Links are
verified in double precision; a task returns a spanning forest of them, never all pairs of a group. As
every link lies within a component, the exact numbers of links are then counted component by component,
in blocks that return counts only.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .shared import Scratch, components
from .simhash_dedup import join_labels

THRESHOLD = 0.95
#: A shard's classes, the least number of shards, and the queries of a block.
SHARD_ROWS = 25_000
LEAST_SHARDS = 8
BLOCK_ROWS = 16_384
#: First and widest beam (an exact search costs less than a wider one), wanted share of an audit vector's links,
#: candidates and bound of the audit set, planted queries, and how far below the threshold a beam must end.
BEAM = 48
WIDEST = 1536
RECALL = 0.97
CANDIDATES = 4096
AUDIT_ROWS = 512
PLANTED = 256
MARGIN = 0.06
COUNT_BLOCK = 1024
STEP = 512


def unpack(column) -> np.ndarray:
    """Vectors of one length from a column of packed doubles."""
    raw = [v.as_py() for v in column]
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def unit(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(1, keepdims=True)  # scaled first, so that no square leaves the range of doubles
    raw = raw / top
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def packed(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(key, vec)``: the vector's doubles as bytes; null if null, empty, zero or not finite throughout."""

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                own = value.as_py()
                good = bool(own) and None not in own
                if good:
                    own = np.array(own, np.float64)
                    good = bool(np.isfinite(own).all() and own.any())
                out.append(own.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "vec"])

    kind = vectors.schema[key].dataType.simpleString()
    source = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("e"))
    return source.mapInArrow(run, f"key {kind}, vec binary")


def range_search(graph, raw_points, units, raw_queries, beam: int | None, threshold: float):
    """``(query, point)`` pairs found in a shard with a double-precision cosine of at least the threshold.

    Without a beam, and for queries whose beam outgrows WIDEST, all points of the shard are compared.
    """
    queries = unit(raw_queries)
    found_q, found_p = [], []
    todo, size = np.arange(len(queries)), beam
    while len(todo):
        wider = []
        for at in range(0, len(todo), STEP):
            own = todo[at : at + STEP]
            if size is None or size > WIDEST or size >= len(units):
                row, p = np.nonzero(queries[own].astype(np.float32) @ graph.vectors.T >= threshold - 1e-4)
                q = own[row]
            else:
                ids, sims = graph.search(queries[own].astype(np.float32), size)
                full = sims[:, -1] >= threshold - MARGIN
                wider.append(own[full])
                row, col = np.nonzero((sims >= threshold - 1e-4) & (ids >= 0) & ~full[:, None])
                q, p = own[row], ids[row, col]
            for part in range(0, len(q), 65_536):
                cut = slice(part, part + 65_536)
                exact = np.einsum("kd,kd->k", queries[q[cut]], units[p[cut]]) >= threshold
                found_q.append(q[cut][exact])
                found_p.append(p[cut][exact])
        todo = np.concatenate(wider) if wider else todo[:0]
        size = size and 2 * size
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(found_q), join(found_p)


def load(blob: bytes):
    state = pickle.loads(blob)
    raw = np.frombuffer(state["raw"], np.float64).reshape(len(state["ids"]), -1)
    units = unit(raw)
    return hnsw.Graph(units.astype(np.float32), [x.astype(np.int64) for x in state["layers"]], 0), raw, units, state["ids"]


def build_shard(table):
    ids = table.column("cls").to_numpy()
    raw = unpack(table.column("vec"))
    graph, order = hnsw.build(unit(raw).astype(np.float32))
    state = {"ids": ids[order], "raw": raw[order].tobytes(), "layers": [x.astype(np.int32) for x in graph.layers]}
    return pa.table({"shard": table.column("shard")[:1], "graph": pa.array([pickle.dumps(state)], pa.binary())})


def audit_set(classes: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(classes, vectors, links, groups)`` of audit queries with links, by brute force and without self matches.

    Linked candidates are taken evenly in the order of their links; they form two groups, with fewer and with
    more links, so that hot vectors do not outweigh the others. A third group are planted queries (class -1),
    each within the threshold of a candidate, so that the audit can tell something where links are rare.
    """
    chosen = classes.orderBy(F.xxhash64("cls"), "cls").limit(CANDIDATES).select("cls", "vec").collect()
    known = np.array([r.cls for r in chosen], np.int64)
    raw = unit(np.stack([np.frombuffer(r.vec, np.float64) for r in chosen]))
    rng = np.random.default_rng(7)
    near = raw[:PLANTED]
    aside = rng.normal(size=near.shape)
    aside -= (aside * near).sum(1, keepdims=True) * near
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-9)
    level = (1 + threshold) / 2
    raw = np.concatenate([raw, level * near + np.sqrt(1 - level * level) * aside])
    known = np.concatenate([known, np.full(len(near), -1)])

    def truth(batches):
        links = np.zeros(len(raw), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), STEP):
                own = unit(unpack(batch.column(1)[at : at + STEP]))
                links += ((own @ raw.T >= threshold) & (ids[at : at + STEP, None] != known)).sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(raw)), "n": links})

    links = np.zeros(len(raw), np.int64)
    counted = classes.select("cls", "vec").mapInArrow(truth, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in counted.where("n > 0").collect():
        links[r.at] = r.n
    linked = np.flatnonzero((links > 0) & (known >= 0))
    linked = linked[np.argsort(links[linked], kind="stable")]
    if len(linked) > AUDIT_ROWS:
        linked = linked[np.linspace(0, len(linked) - 1, AUDIT_ROWS).astype(np.int64)]
    planted = np.flatnonzero((links > 0) & (known < 0))
    rows = np.concatenate([linked, planted])
    cuts = np.split(np.arange(len(rows)), [len(linked) // 2, len(linked)])
    return known[rows], raw[rows], links[rows], [c for c in cuts if len(c)]


def audited_beam(classes: DataFrame, graphs: DataFrame, threshold: float) -> tuple[int | None, float]:
    """The beam at which audit vectors find RECALL of their links, and the recall measured; no beam if none does.

    The recall is the mean over a group's vectors of the share of their links found, the least of the groups.
    """
    known, audit, wanted, groups = audit_set(classes, threshold)
    beam = BEAM
    while groups and beam <= WIDEST:

        def trial(batches, beam=beam):
            found = np.zeros(len(audit), np.int64)
            for batch in batches:
                for blob in batch.column(0):
                    graph, raw, points, ids = load(blob.as_py())
                    q, p = range_search(graph, raw, points, audit, beam, threshold)
                    found += np.bincount(q[ids[p] != known[q]], minlength=len(audit))
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(audit)), "n": found})

        rows = graphs.select("graph").mapInArrow(trial, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        share = np.zeros(len(audit))
        for r in rows.collect():
            share[r.at] = min(1.0, r.n / wanted[r.at])
        recall = min(float(share[g].mean()) for g in groups)
        if recall >= RECALL:
            return beam, recall
        beam *= 2
    return None, 1.0


def search_links(scratch: Scratch, classes: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(a, b)`` between classes that span everything the graphs find."""
    total = classes.count()
    shards = max(LEAST_SHARDS, math.ceil(total / SHARD_ROWS))
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    placed = classes.withColumn("shard", F.expr(f"cast(pmod(xxhash64(cls, 1), {shards}) as int)"))
    graphs = placed.select("shard", "cls", "vec").groupBy("shard").applyInArrow(build_shard, "shard int, graph binary")
    graphs = scratch.table(graphs)
    beam, _ = audited_beam(classes, graphs, threshold)

    def ask(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        graph, raw, units, ids = load(right.column("graph")[0].as_py())
        own = left.column("cls").to_numpy()
        q, p = range_search(graph, raw, units, unpack(left.column("vec")), beam, threshold)
        nodes, place = np.unique(np.concatenate([own[q], ids[p]]), return_inverse=True)
        labels = join_labels(np.arange(len(nodes)), place[: len(q)], place[len(q) :])
        joined = np.flatnonzero(labels != np.arange(len(nodes)))
        return pa.table({"a": nodes[joined], "b": nodes[labels[joined]]})

    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    block = F.expr(f"cast(pmod(xxhash64(cls, 2), {blocks}) as int)").alias("block")
    queries = classes.select(each_shard, block, "cls", "vec")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    hosts = graphs.select("shard", each_block, "graph")
    pairs = queries.groupBy("shard", "block").cogroup(hosts.groupBy("shard", "block"))
    edges = scratch.table(pairs.applyInArrow(ask, "a long, b long"))
    scratch.drop(graphs)
    return edges


def count_links(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``(cls, links)``: other rows within the threshold of a class, over the components of two and more."""
    members = groups.join(classes.select("cls", "vec", "n"), groups.node == classes.cls).drop("node")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "component").withColumn("part", F.expr("cast(pmod(xxhash64(cls, 3), blocks) as int)"))
    against = F.explode(F.expr("sequence(0, blocks - 1)"))
    # A component of many blocks is spread over all pairs of its blocks; a block travels once per other block.
    asks = members.select("component", F.col("part").alias("i"), against.alias("j"), "cls", "vec", F.lit(0).alias("side"), "n")
    told = members.select("component", against.alias("i"), F.col("part").alias("j"), "cls", "vec", F.lit(1).alias("side"), "n")

    def count(table):
        side = table.column("side").to_numpy()
        mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids = table.column("cls").to_numpy()[mine]
        if not len(mine) or not len(other):
            return pa.table({"cls": ids, "links": np.zeros(len(ids), np.int64)})
        rows = unit(unpack(table.column("vec")))
        weights = table.column("n").to_numpy()[other]
        links = np.concatenate(
            [(rows[mine[a : a + STEP]] @ rows[other].T >= threshold) @ weights for a in range(0, len(mine), STEP)]
        )
        return pa.table({"cls": ids, "links": links})

    counted = asks.unionByName(told).groupBy("component", "i", "j").applyInArrow(count, "cls long, links long")
    return counted.groupBy("cls").agg(F.sum("links").alias("links"))


def embedding_groups(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` per row of ``vectors``.

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more, ``component_id`` is the least key
    reachable by links, ``kept`` whether that is the row's own. Null, empty or zero vectors and vectors with
    null or non-finite components link with nothing and are components of their own. Vectors link only with
    vectors of their length. Repeated rows link with each other; a null key never names a component unless
    nothing else does, and is kept only then. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = scratch.table(packed(vectors, key, embedding))
    good = rows.where("vec is not null")
    classes = good.groupBy("vec").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("cls"), "vec", "n", "first_key"))
    found = None
    for (size,) in classes.select(F.length("vec")).distinct().collect():  # lengths of vectors: usually one
        own = classes.where(F.length("vec") == size)
        groups = scratch.table(components(scratch, search_links(scratch, own, threshold)))
        links = count_links(own, groups, threshold)
        part = own.select("cls", "vec", "n", "first_key").join(groups, own.cls == groups.node, "left").drop("node")
        part = part.join(links, "cls", "left").select(
            "vec",
            "first_key",
            F.coalesce("component", "cls").alias("root"),
            (F.coalesce("links", "n") - 1).alias("n_links"),
        )
        found = part if found is None else found.unionByName(part)
    kind = vectors.schema[key].dataType
    alone = rows.where("vec is null").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept")
    )
    if found is not None:
        found = scratch.table(found)
        named = found.groupBy("root").agg(F.min("first_key").alias("component_id"))
        of_class = found.join(named, "root").select("vec", "n_links", "component_id")
        linked = good.join(of_class, "vec").select(
            "key", "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
        )
        alone = linked.unionByName(alone)
    return alone.select(F.col("key").cast(kind).alias(key), "n_links", "component_id", "kept")
