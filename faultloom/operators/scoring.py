"""Scoring of bug reports by how well their code blocks cover the true change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, unnest
from ..functions.text import code_blocks, collapse_whitespace
from ..sizing import balance
from .diffs import with_diff_chunks
from .similarity import best_similarity

# Default threshold and the two reasons a report has no score.
DEFAULT_THRESHOLD = 0.8
OK = "ok"
NO_DIFFS = "no_diffs"
NO_CODE_BLOCKS = "no_code_blocks"
NO_PAIR = "no_pair"
MESSAGES = {
    NO_DIFFS: "No diffs found between base and buggy code.",
    NO_CODE_BLOCKS: "No code blocks found in bug report.",
    NO_PAIR: "No pair of base and buggy code for this bug report.",
}

# Sides and blocks scored per kernel row; a report with more of either is split over several rows.
SIDES_PER_SLICE = 64
BLOCKS_PER_SLICE = 64


def change_sides(chunks: Column) -> Column:
    """Per chunk the text a report should quote: the new side, or the old one of a pure removal."""
    return F.transform(
        chunks,
        lambda c: collapse_whitespace(
            F.when(c["new_version"] != "", c["new_version"]).otherwise(c["old_version"])
        ),
    )


def pair_sides(pairs: DataFrame, *, key: str, base: str = "base_code", buggy: str = "buggy_code") -> DataFrame:
    """``(key, sides)``: the quotable sides of each pair's change, one row per pair."""
    chunked = with_diff_chunks(pairs.select(key, base, buggy), base, buggy)
    return chunked.select(key, change_sides(F.col("chunks")).alias("sides"))


def report_blocks(reports: DataFrame, *, keys: list[str], text: str = "bug_report") -> DataFrame:
    """``(keys, blocks)``: the whitespace-collapsed code blocks of each report."""
    return reports.select(
        *keys, F.transform(code_blocks(F.col(text)), collapse_whitespace).alias("blocks")
    )


def joined_slices(
    reports: DataFrame,
    pairs: DataFrame,
    *,
    report_key: str,
    pair_key: str,
    text: str,
    base: str,
    buggy: str,
    scorable_only: bool = False,
) -> DataFrame:
    """Reports joined to their pair's change, in slices of some sides against some blocks.

    Only pairs that a report names are diffed, once however many reports name them, and only blocks and
    sides travel through the join, not the source texts. The join is left to AQE, which splits a pair key
    that many reports share; slices split a report whose change or number of blocks is large. A report
    without a pair stays, with a null ``n_diffs``. ``scorable_only`` leaves out reports without a pair or
    blocks or whose pair has no change. ``slice_no`` counts the slices of sides, ``block_slice`` those of
    blocks.
    """
    named = pairs.join(reports.select(pair_key).distinct(), pair_key, "left_semi")
    sides = pair_sides(named, key=pair_key, base=base, buggy=buggy)
    blocks = report_blocks(reports, keys=list(dict.fromkeys([report_key, pair_key])), text=text)
    joined = blocks.join(sides.withColumn("n_diffs", F.size("sides")), pair_key, "left")
    joined = joined.withColumn("n_blocks", F.size("blocks"))

    def sliced(values: Column, size: int) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size))
        return F.transform(steps, lambda s: F.slice(values, s + 1, size))

    none = F.array().cast("array<string>")
    of_sides = bind(F.coalesce("sides", none), lambda own: sliced(own, SIDES_PER_SLICE))
    if scorable_only:
        # Part of the generator rather than a filter: a filter would be pushed below the join and
        # compute blocks and sides a second time.
        of_sides = F.when((F.col("n_blocks") > 0) & (F.col("n_diffs") > 0), of_sides)
    rows = unnest(joined, of_sides, report_key, "blocks", "n_diffs", "n_blocks", item="slice", pos="slice_no")
    of_blocks = bind(F.col("blocks"), lambda own: sliced(own, BLOCKS_PER_SLICE))
    kept = (report_key, "slice", "slice_no", "n_diffs", "n_blocks")
    return unnest(rows, of_blocks, *kept, item="blocks", pos="block_slice")


def similarity_table(
    reports: DataFrame,
    pairs: DataFrame,
    *,
    report_key: str = "report_id",
    pair_key: str = "pair_id",
    text: str = "bug_report",
    base: str = "base_code",
    buggy: str = "buggy_code",
    autojunk: bool = True,
) -> DataFrame:
    """Best similarity of every diff chunk of every report that has blocks."""
    slices = joined_slices(
        reports,
        pairs,
        report_key=report_key,
        pair_key=pair_key,
        text=text,
        base=base,
        buggy=buggy,
        scorable_only=True,
    )
    best = best_similarity(F.col("slice"), F.col("blocks"), autojunk=autojunk)
    placed = balance(slices, report_key, "slice_no", "block_slice")
    scored = unnest(placed, best, report_key, "slice_no", item="best_similarity", pos="n")
    chunk_no = (F.col("slice_no") * SIDES_PER_SLICE + F.col("n")).cast("bigint").alias("chunk_no")
    return scored.groupBy(report_key, chunk_no).agg(F.max("best_similarity").alias("best_similarity"))


def report_scores(
    reports: DataFrame,
    pairs: DataFrame,
    *,
    report_key: str = "report_id",
    pair_key: str = "pair_id",
    text: str = "bug_report",
    base: str = "base_code",
    buggy: str = "buggy_code",
    threshold: float = DEFAULT_THRESHOLD,
    autojunk: bool = True,
    strict: bool = False,
) -> DataFrame:
    """One row per report: ``n_diffs, n_code_blocks, status, score``.

    The score is the mean over the change's chunks of 1 at or above the threshold, else the best
    similarity as a share of the threshold. Reports without a pair, a change or blocks have a status
    and a NULL score; with ``strict`` they fail the job.
    """
    slices = joined_slices(
        reports, pairs, report_key=report_key, pair_key=pair_key, text=text, base=base, buggy=buggy
    )
    # The score only asks whether the threshold is met, so the search may stop there.
    best = best_similarity(F.col("slice"), F.col("blocks"), stop_at=threshold, autojunk=autojunk)
    # The best of each side over all slices of blocks, then its credit.
    per_side = (
        balance(slices, report_key, "slice_no", "block_slice")
        .select(report_key, "slice_no", "n_diffs", "n_blocks", F.posexplode_outer(best).alias("n", "best"))
        .groupBy(report_key, "slice_no", "n")
        .agg(F.max("n_diffs").alias("n_diffs"), F.max("n_blocks").alias("n_blocks"), F.max("best").alias("best"))
    )
    credit = F.when(F.col("best") >= threshold, 1.0).otherwise(F.col("best") / threshold)
    totals = per_side.groupBy(report_key).agg(
        F.max("n_diffs").cast("bigint").alias("n_diffs"),
        F.max("n_blocks").cast("bigint").alias("n_code_blocks"),
        F.sum(F.when((F.col("n_blocks") > 0) & (F.col("n_diffs") > 0), credit)).alias("credit"),
    )
    status = (
        F.when(F.col("n_diffs").isNull(), NO_PAIR)
        .when(F.col("n_diffs") == 0, NO_DIFFS)
        .when(F.col("n_code_blocks") == 0, NO_CODE_BLOCKS)
        .otherwise(OK)
    )
    if strict:
        for name, message in MESSAGES.items():
            status = F.when(status == name, F.raise_error(F.lit(message)).cast("string")).otherwise(status)
    return totals.select(
        report_key,
        "n_diffs",
        "n_code_blocks",
        status.alias("status"),
        F.when(
            (F.col("n_diffs") > 0) & (F.col("n_code_blocks") > 0),
            F.least(F.col("credit") / F.col("n_diffs"), F.lit(1.0)),
        ).alias("score"),
    )
