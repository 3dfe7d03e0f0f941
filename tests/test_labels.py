import pytest
from faultloom.functions.labels import actual_label, checked_label, expected_label, percent
from faultloom.operators.evaluation import confusion_matrix, results_by_challenge, status_counts, with_labels
from pyspark.sql import functions as F


def test_expected_label(apply):
    paths = ["c/buggy.sv", "c/base.v", "c/other.sv", "buggy.sv", "c/buggyXsv", "a/buggy.x/base.v", None]
    assert apply(expected_label, paths) == [
        "contains_bug", "no_bug", "unknown", "unknown", "contains_bug", "contains_bug", "unknown",
    ]


def test_actual_label(apply):
    responses = [
        "No modifications detected",
        "x\n```\ncode\n```\nNo modifications detected.",
        "a" * 19,
        "a" * 20,
        "é" * 19,
        "é" * 20,
        "```" + "a" * 16,
        "```" + "a" * 17,
        None,
        "no modifications detected, really",
    ]
    assert apply(actual_label, responses) == [
        "no_bug", "no_bug", "response_very_short", "response_contains_no_code_block", "response_very_short",
        "response_contains_no_code_block", "response_very_short", "contains_bug", "contains_bug",
        "response_contains_no_code_block",
    ]


def test_strict_labels(apply):
    assert apply(lambda c: checked_label(c, strict=True), ["no_bug", None]) == ["no_bug", None]
    assert apply(checked_label, ["unknown"]) == ["unknown"]
    with pytest.raises(Exception, match="label outside"):
        apply(lambda c: checked_label(c, strict=True), ["unknown"])


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 800), (3, 800), (1, 3), (2, 3), (1, 1)], "a int, b int")
    got = [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()]
    assert got == [0.12, 0.38, 33.33, 66.67, 100.0]


ROWS = [
    ("c1/buggy.sv", "x" * 30 + "```"),
    ("c1/base.sv", "No modifications detected"),
    ("c1/base.sv", "x" * 30 + "```"),
    ("c2/buggy.sv", "short"),
    ("c2/buggy.sv", "y" * 30 + "```"),
    ("c2/buggy.sv", "y" * 30 + "```"),
]


@pytest.fixture
def labelled(spark):
    return with_labels(spark.createDataFrame(ROWS, "input_file_rel_path string, llm_response string"))


def test_confusion_matrix(labelled):
    rows = [tuple(r) for r in confusion_matrix(labelled).collect()]
    assert rows == [
        ("contains_bug", "contains_bug", 3, 50.0),
        ("contains_bug", "response_very_short", 1, 16.67),
        ("no_bug", "contains_bug", 1, 16.67),
        ("no_bug", "no_bug", 1, 16.67),
    ]


def test_results_by_challenge(labelled):
    rows = [tuple(r) for r in results_by_challenge(labelled).collect()]
    assert rows == [
        ("c1", 3, 2, 1, 1, 66.67, 66.67, 66.67),
        # Only buggy files: the class percentage exceeds 100, as documented.
        ("c2", 3, 2, 2, 0, 66.67, 133.33, 0.0),
    ]


def test_status_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "status string")
    assert [tuple(r) for r in status_counts(df).collect()] == [("a", 2, 3), ("b", 1, 3)]


def test_counts_prune_text_columns(spark, tmp_path):
    """The aggregates must not read prompts or file contents."""
    from faultloom.schemas import RESPONSES

    path = str(tmp_path / "r.parquet")
    rows = [("u", p, "content", "prompt", r, "m") for p, r in ROWS]
    spark.createDataFrame(rows, RESPONSES).write.parquet(path)
    plan = confusion_matrix(with_labels(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<input_file_rel_path:string,llm_response:string>" in plan
