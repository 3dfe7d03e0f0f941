"""Line diffs and diff chunks.

Python only finds the matching runs of two line lists (Arrow batches). Opcodes
and chunks are array expressions on the same row, so a corpus of pairs is diffed without a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, unnest
from ..functions.text import normalized_lines, split_lines_keeping_ends
from ..sizing import KERNEL_ROWS
from .matching import make_run_finder

# Fixed value: equal runs of at least this many lines separate two chunks.
CONTEXT_LINES = 3

NORMALIZED = "normalized"
EXACT = "exact"


def make_run_kernel(autojunk: bool):
    """``kernel(old, new)`` over Arrow arrays of line lists: each pair's runs as ``i, j, n, i, j, n, ...``."""
    find = make_run_finder(autojunk)

    def kernel(old: pa.Array, new: pa.Array) -> pa.Array:
        import numpy as np

        def runs(a, b):
            if np.array_equal(a, b):
                return [0, 0, len(a)] if len(a) else []
            return [x for run in find(a.tolist(), b.tolist()) for x in run]

        def ends(lists):
            return np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])

        # Lines become numbers, equal for equal ones, some pairs at a time: no line is made a Python object.
        done = []
        for at in range(0, len(old), KERNEL_ROWS):
            left, right = old.slice(at, KERNEL_ROWS), new.slice(at, KERNEL_ROWS)
            lines = pa.concat_arrays([left.flatten(), right.flatten()])
            codes = lines.dictionary_encode("encode").indices.to_numpy()
            a, b = ends(left), ends(right) + len(left.flatten())
            both = zip(left.is_valid().to_pylist(), right.is_valid().to_pylist())
            found = [
                runs(codes[a[k] : a[k + 1]], codes[b[k] : b[k + 1]]) if all(there) else None
                for k, there in enumerate(both)
            ]
            done.append(pa.array(found, pa.list_(pa.int32())))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return kernel


def matching_runs(old_lines: Column, new_lines: Column, *, autojunk: bool) -> Column:
    """Maximal equal runs of two ``array<string>`` as ``array<struct<i,j,n>>``, in order."""
    kernel = F.arrow_udf(make_run_kernel(autojunk), "array<int>")

    def triples(flat: Column) -> Column:
        count = F.floor(F.size(flat) / 3).cast("int")
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
                lambda k: F.struct(
                    F.get(flat, k * 3).alias("i"),
                    F.get(flat, k * 3 + 1).alias("j"),
                    F.get(flat, k * 3 + 2).alias("n"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<i:int,j:int,n:int>>"))

    # Declared nondeterministic so that filters on its result are not pushed below it, which would run
    # the kernel twice.
    return bind(kernel.asNondeterministic()(old_lines, new_lines), triples)


def _gaps(runs: Column, old_size: Column, new_size: Column) -> Column:
    """Stretches before, between and after the given runs: ``array<struct<i1,i2,j1,j2>>``."""

    def gap(i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
        names = ("i1", "i2", "j1", "j2")
        return F.struct(*[c.cast("int").alias(n) for n, c in zip(names, (i1, i2, j1, j2))])

    def before(x: Column, k: Column) -> Column:
        prev, here = F.get(x["runs"], k - 1), F.get(x["runs"], k)
        return gap(
            F.when(k == 0, 0).otherwise(prev["i"] + prev["n"]),
            F.coalesce(here["i"], x["n_old"]),
            F.when(k == 0, 0).otherwise(prev["j"] + prev["n"]),
            F.coalesce(here["j"], x["n_new"]),
        )

    inputs = F.struct(runs.alias("runs"), old_size.alias("n_old"), new_size.alias("n_new"))
    return bind(
        inputs,
        lambda x: F.transform(F.sequence(F.lit(0), F.size(x["runs"])), lambda k: before(x, k)),
    )


def opcodes(runs: Column, old_size: Column, new_size: Column) -> Column:
    """Edit script ``array<struct<tag,i1,i2,j1,j2>>`` that turns the old lines into the new ones."""

    def op(tag: Column, i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
        bounds = zip(("i1", "i2", "j1", "j2"), (i1, i2, j1, j2))
        return F.struct(tag.alias("tag"), *[c.cast("int").alias(n) for n, c in bounds])

    def change(g: Column) -> Column:
        tag = (
            F.when(g["i1"] == g["i2"], "insert").when(g["j1"] == g["j2"], "delete").otherwise("replace")
        )
        return op(tag, g["i1"], g["i2"], g["j1"], g["j2"])

    def with_run(found: Column, g: Column, k: Column) -> Column:
        run = F.get(found, k)
        equal = op(F.lit("equal"), run["i"], run["i"] + run["n"], run["j"], run["j"] + run["n"])
        return F.array(
            F.when((g["i1"] < g["i2"]) | (g["j1"] < g["j2"]), change(g)),
            F.when(k < F.size(found), equal),
        )

    def script(found: Column) -> Column:
        gaps = _gaps(found, old_size, new_size)
        return F.filter(
            F.flatten(F.transform(gaps, lambda g, k: with_run(found, g, k))), lambda o: o.isNotNull()
        )

    return bind(runs, script)


def with_diff_chunks(
    df: DataFrame,
    old_text: str,
    new_text: str,
    *,
    into: str = "chunks",
    mode: str = NORMALIZED,
    context: int = CONTEXT_LINES,
) -> DataFrame:
    """Add the changed chunks of two text columns: ``array<struct<old_version,new_version>>``.

    Equal runs of ``context`` lines or more separate chunks; shorter ones are folded into the chunk
    around them, at the edges too. So a chunk is whatever lies between two separating runs.

    * ``normalized``: whitespace is collapsed per line, no popular-line heuristic, chunk sides are
      stripped and chunks whose sides agree are dropped.
    * ``exact``: lines keep their terminators, the popular-line heuristic is on, nothing is stripped
      or dropped.
    """
    if mode not in (NORMALIZED, EXACT):
        raise ValueError(f"unknown diff mode: {mode}")
    normalized = mode == NORMALIZED
    to_lines = normalized_lines if normalized else split_lines_keeping_ends

    # The line lists are columns of their own so that the kernel and the chunk step share them.
    lined = df.withColumns({"_old": to_lines(F.col(old_text)), "_new": to_lines(F.col(new_text))})
    matched = lined.withColumn(
        "_runs", matching_runs(F.col("_old"), F.col("_new"), autojunk=not normalized)
    )

    def side(lines: Column, start: Column, end: Column) -> Column:
        body = F.slice(lines, start + 1, end - start)
        return F.btrim(F.array_join(body, "\n"), F.lit("\n")) if normalized else F.array_join(body, "")

    def chunks(both: Column) -> Column:
        old, new = both["old"], both["new"]
        separators = F.filter(both["runs"], lambda r: r["n"] >= context)
        stretches = F.filter(
            _gaps(separators, F.size(old), F.size(new)),
            lambda g: (g["i1"] < g["i2"]) | (g["j1"] < g["j2"]),
        )
        built = F.transform(
            stretches,
            lambda g: F.struct(
                side(old, g["i1"], g["i2"]).alias("old_version"),
                side(new, g["j1"], g["j2"]).alias("new_version"),
            ),
        )
        return F.filter(built, lambda c: c["old_version"] != c["new_version"]) if normalized else built

    parts = F.struct(F.col("_old").alias("old"), F.col("_new").alias("new"), F.col("_runs").alias("runs"))
    return matched.withColumn(into, bind(parts, chunks)).drop("_old", "_new", "_runs")


def chunk_table(
    pairs: DataFrame,
    *,
    key: str = "pair_id",
    old: str = "base_code",
    new: str = "buggy_code",
    mode: str = NORMALIZED,
) -> DataFrame:
    """Long form: one row per ``(key, chunk_no)``."""
    chunks = with_diff_chunks(pairs.select(key, old, new), old, new, mode=mode)
    rows = unnest(chunks, F.col("chunks"), key, item="chunk", pos="chunk_no")
    return rows.select(
        key, F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk.old_version", "chunk.new_version"
    )


def opcode_table(
    pairs: DataFrame,
    *,
    key: str = "pair_id",
    old: str = "base_code",
    new: str = "buggy_code",
    mode: str = NORMALIZED,
) -> DataFrame:
    """Edit script of every pair, one row per opcode."""
    normalized = mode == NORMALIZED
    to_lines = normalized_lines if normalized else split_lines_keeping_ends
    lined = pairs.select(key, to_lines(F.col(old)).alias("_old"), to_lines(F.col(new)).alias("_new"))
    matched = lined.withColumn(
        "_runs", matching_runs(F.col("_old"), F.col("_new"), autojunk=not normalized)
    )
    ops = unnest(matched, opcodes(F.col("_runs"), F.size("_old"), F.size("_new")), key, item="op")
    return ops.select(key, F.col("pos").cast("bigint").alias("pos"), "op.*")
