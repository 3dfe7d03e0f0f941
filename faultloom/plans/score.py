"""Score: reports against the true change of the pair they talk about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import challenge_of
from ..operators.scoring import DEFAULT_THRESHOLD, report_scores


def pairs_from_emitted(emitted: DataFrame) -> DataFrame:
    """``challenge_id, base_code, buggy_code`` from the long table of file pairs.

    One group holds the two files of one challenge.
    """
    return emitted.groupBy(F.col("output_folder").alias("challenge_id")).agg(
        F.max(F.when(F.col("role") == "base", F.col("content"))).alias("base_code"),
        F.max(F.when(F.col("role") == "buggy", F.col("content"))).alias("buggy_code"),
    )


def score_responses(
    responses: DataFrame,
    pairs: DataFrame,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    autojunk: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Score every response of a response table against its challenge's pair."""
    reports = responses.select(
        "uuid",
        challenge_of(F.col("input_file_rel_path")).alias("challenge_id"),
        F.col("llm_response").alias("bug_report"),
    )
    return report_scores(
        reports,
        pairs,
        report_key="uuid",
        pair_key="challenge_id",
        threshold=threshold,
        autojunk=autojunk,
        strict=strict,
    )
