"""Analyze: a response table to labels, confusion matrix and per-challenge accuracy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import confusion_matrix, results_by_challenge, with_labels
from ..schemas import RESPONSES
from ..sources.tables import analysis_dir, read_table

# Names of the outputs.
ROWS = "10_llm_bug_detection_data_with_analysis.pq"
MATRIX = "confusion_matrix.pq"
BY_CHALLENGE = "results_by_challenge.pq"
OUTPUTS = (ROWS, MATRIX, BY_CHALLENGE)


class Analysis(NamedTuple):
    rows: DataFrame
    confusion_matrix: DataFrame
    results_by_challenge: DataFrame


def analyze(responses: DataFrame, *, strict: bool = False) -> Analysis:
    """The three results as independent plans.

    The two aggregates read only path and response; file contents and prompts are pruned from them.
    """
    labelled = with_labels(responses, strict=strict)
    return Analysis(labelled, confusion_matrix(labelled), results_by_challenge(labelled))


def analyze_file(spark: SparkSession, path: str, *, strict: bool = False) -> str:
    """Analyze a table on storage and write the results to ``<stem>_analysis``; returns that path.

    The input is read and labelled once, for the table of rows; both aggregates are made from that table, of
    which they read two or three narrow columns.
    """
    out = analysis_dir(path)
    labelled = with_labels(read_table(spark, path, RESPONSES), strict=strict)
    labelled.write.mode("overwrite").parquet(f"{out}/{ROWS}")
    rows = spark.read.parquet(f"{out}/{ROWS}")
    confusion_matrix(rows).write.mode("overwrite").parquet(f"{out}/{MATRIX}")
    results_by_challenge(rows).write.mode("overwrite").parquet(f"{out}/{BY_CHALLENGE}")
    return out
