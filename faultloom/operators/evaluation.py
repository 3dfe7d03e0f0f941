"""Detection labels, confusion matrix and per-challenge accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (
    CONTAINS_BUG,
    NO_BUG,
    actual_label,
    checked_label,
    expected_label,
    label_order,
    percent,
)
from ..functions.paths import challenge_of

EXPECTED = "expected_detection_result"
ACTUAL = "actual_detection_result"


def with_labels(responses: DataFrame, *, strict: bool = False) -> DataFrame:
    """Add ``challenge_id`` and the expected and actual labels to the response table."""
    path, response = F.col("input_file_rel_path"), F.col("llm_response")
    return responses.withColumns(
        {
            "challenge_id": challenge_of(path),
            EXPECTED: checked_label(expected_label(path), strict=strict),
            ACTUAL: checked_label(actual_label(response), strict=strict),
        }
    )


def confusion_matrix(labelled: DataFrame, *by: str) -> DataFrame:
    """Count and percent of rows per (expected, actual), overall or within each ``by`` group.

    Rows are pre-aggregated before the only shuffle that grows with the data; the total is a window
    over the few aggregated rows.
    """
    counts = labelled.groupBy(*by, EXPECTED, ACTUAL).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.select(
        *by, EXPECTED, ACTUAL, "count", percent(F.col("count"), total).alias("percent")
    ).orderBy(*by, label_order(F.col(EXPECTED)), EXPECTED, label_order(F.col(ACTUAL)), ACTUAL)


def results_by_challenge(labelled: DataFrame) -> DataFrame:
    """Accuracy per challenge.

    The two class percentages are doubled, which reads as a share of the class only when half of a
    challenge's files are buggy; elsewhere they may exceed 100.
    """
    expected, actual, total = F.col(EXPECTED), F.col(ACTUAL), F.col("total_llm_prompts")
    counts = labelled.groupBy("challenge_id").agg(
        F.count("*").alias("total_llm_prompts"),
        F.count_if(expected == actual).alias("correct_overall"),
        F.count_if((expected == CONTAINS_BUG) & (actual == CONTAINS_BUG)).alias("correctly_detected_bug"),
        F.count_if((expected == NO_BUG) & (actual == NO_BUG)).alias("correctly_detected_no_bug"),
    )
    return counts.withColumns(
        {
            "correct_overall_pct": percent(F.col("correct_overall"), total),
            "correctly_detected_bug_pct": percent(F.col("correctly_detected_bug"), total, 2),
            "correctly_detected_no_bug_pct": percent(F.col("correctly_detected_no_bug"), total, 2),
        }
    ).orderBy("challenge_id")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status, and their total on every row."""
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("count"))
    return counts.withColumn("total", F.sum("count").over(Window.partitionBy())).orderBy("status")
