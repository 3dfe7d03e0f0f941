"""A hierarchical navigable small-world graph over unit vectors, built and searched a batch at a time.

Points enter in the order of their level, highest first, so upper layers are complete before lower ones
start; batches grow with the graph. A batch searches the graph for neighbours, meets its own members
directly, keeps diverse neighbours and links back, pruning full lists by the same rule. Searches of many
queries move in step: each expands its best open candidate until the beam holds no better one.
"""

from __future__ import annotations

import numpy as np

LINKS = 12
BUILD_BEAM = 48
SEED_POINTS = 128


class Graph:
    """Vectors, levels and per layer the neighbour lists (-1 where empty)."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.vectors, self.layers, self.entry = vectors, layers, entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points and cosines found for each query, best first (-1 where fewer)."""
        start = np.full((len(queries), 1), self.entry)
        for layer in self.layers[:0:-1]:
            start, _ = walk(self.vectors, layer, queries, start, 1)
        return walk(self.vectors, self.layers[0], queries, start, beam)


def walk(vectors, links, queries, start, beam):
    """Beam search of all queries in one layer from their starting points."""
    count = len(queries)
    rows = np.arange(count)
    width = max(beam, start.shape[1])
    ids = np.full((count, width), -1)
    sims = np.full((count, width), -np.inf, np.float32)
    done = np.ones((count, width), bool)
    ids[:, : start.shape[1]] = start
    known = start >= 0
    sims[:, : start.shape[1]] = np.where(
        known, np.einsum("qd,qkd->qk", queries, vectors[np.maximum(start, 0)], dtype=np.float32), -np.inf
    )
    done[:, : start.shape[1]] = ~known
    seen = np.zeros((count, len(vectors)), bool)
    seen[rows[:, None].repeat(start.shape[1], 1)[known], start[known]] = True
    order = np.argsort(-sims, 1)[:, :beam]
    ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
    live = rows
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = open_sims.argmax(1)
        more = open_sims[np.arange(len(live)), pick] > -np.inf
        live, pick = live[more], pick[more]
        if not len(live):
            break
        done[live, pick] = True
        near = links[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
        found = np.einsum("qd,qkd->qk", queries[live], vectors[np.maximum(near, 0)], dtype=np.float32)
        found = np.where(fresh, found, -np.inf)
        all_sims = np.concatenate([sims[live], found], 1)
        best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        all_ids = np.concatenate([ids[live], near], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, ids), sims


def diverse(vectors, ids, sims, limit):
    """Of candidates sorted best first, those nearer to the point than to any kept one; then the nearest left."""
    count, width = ids.shape
    kept = np.full((count, limit), -1)
    held = np.zeros(count, np.int64)
    taken = np.zeros((count, width), bool)
    own = np.zeros((count, limit, vectors.shape[1]), np.float32)
    for c in range(width):
        usable = (ids[:, c] >= 0) & (held < limit)
        if not usable.any():
            continue
        row = np.flatnonzero(usable)
        value = vectors[ids[row, c]]
        closest = np.einsum("qd,qkd->qk", value, own[row])
        closest = np.where(np.arange(limit) < held[row, None], closest, -np.inf).max(1)
        good = row[closest < sims[row, c]]
        kept[good, held[good]] = ids[good, c]
        own[good, held[good]] = vectors[ids[good, c]]
        held[good] += 1
        taken[good, c] = True
    for c in range(width):
        row = np.flatnonzero((ids[:, c] >= 0) & ~taken[:, c] & (held < limit))
        kept[row, held[row]] = ids[row, c]
        held[row] += 1
    return kept


def build(vectors: np.ndarray, seed: int = 7, links: int = LINKS, beam: int = BUILD_BEAM) -> tuple[Graph, np.ndarray]:
    """A graph over the vectors and the order in which it holds them."""
    rng = np.random.default_rng(seed)
    levels = np.minimum(rng.geometric(1 - 1 / links, len(vectors)) - 1, 8)
    order = np.argsort(-levels, kind="stable")
    vectors, levels = np.ascontiguousarray(vectors[order], np.float32), levels[order]
    layers = []
    for level in range(int(levels[0]) + 1):
        layers.append(np.full((int((levels >= level).sum()), links * (2 if level == 0 else 1)), -1))
    graph = Graph(vectors, layers, 0)
    at = 0
    while at < len(vectors):
        size = SEED_POINTS if at == 0 else min(max(at // 2, SEED_POINTS), 2048)
        _insert(graph, at, min(len(vectors), at + size), links, beam)
        at += size
    return graph, order


def _insert(graph, first, last, links, beam):
    vectors = graph.vectors
    points = np.arange(first, last)
    start = np.zeros((len(points), 1), np.int64)
    for level in range(len(graph.layers) - 1, -1, -1):
        layer = graph.layers[level]
        here = points < len(layer)
        if first:
            near, sims = walk(vectors[: max(1, min(first, len(layer)))], layer, vectors[points], start, beam)
            start = near[:, : max(1, beam // 4)]
        else:
            near, sims = np.full((len(points), 1), -1), np.full((len(points), 1), -np.inf, np.float32)
        if not here.any():
            continue
        own = points[here]
        mates = vectors[own] @ vectors[own].T
        np.fill_diagonal(mates, -np.inf)
        take = min(beam, len(own))
        best = np.argpartition(-mates, take - 1, 1)[:, :take]
        mate_sims = np.take_along_axis(mates, best, 1)
        ids = np.concatenate([near[here], np.where(np.isneginf(mate_sims), -1, own[best])], 1)
        sims = np.concatenate([sims[here], mate_sims], 1)
        rank = np.argsort(-sims, 1)[:, :beam]
        ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
        chosen = diverse(vectors, ids, sims, links)
        layer[own, : chosen.shape[1]] = chosen
        _link_back(vectors, layer, own, chosen)


def _link_back(vectors, layer, own, chosen):
    """Add the reverse of new links; a list that would overflow keeps diverse neighbours."""
    source = np.repeat(own, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("kd,kd->k", vectors[source], vectors[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, begins, counts = np.unique(target, return_index=True, return_counts=True)
    limit = layer.shape[1]
    rank = np.arange(len(target)) - np.repeat(begins, counts)
    few = rank < limit  # nearest of the newcomers; the rest reach the node by their own links
    incoming = np.full((len(nodes), limit), -1)
    incoming[np.repeat(np.arange(len(nodes)), counts)[few], rank[few]] = source[few]
    ids = np.concatenate([layer[nodes], incoming], 1)
    ids.sort(1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", vectors[nodes], vectors[np.maximum(ids, 0)]), -np.inf)
    rank = np.argsort(-sims, 1)
    ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
    full = (ids >= 0).sum(1) > limit
    layer[nodes[~full]] = ids[~full][:, :limit]
    if full.any():
        layer[nodes[full]] = diverse(vectors, ids[full], sims[full], limit)
