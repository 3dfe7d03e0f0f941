"""Declared schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


RESPONSES = _strings(
    "uuid",
    "input_file_rel_path",
    "input_file_contents",
    "llm_prompt",
    "llm_response",
    "llm_model_name",
)

BRANCH_METADATA = _strings(
    "output_folder",
    "git_repo",
    "branch_name",
    "source_path",
    "buggy_commit",
    "fixed_commit",
)

OVERRIDES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("expected_path", T.StringType()),
        T.StructField("chosen_path", T.StringType()),
    ]
)
