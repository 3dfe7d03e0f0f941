"""Rename: replace identifiers across a corpus by the names a responder proposes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.masking import KINDED, mask, unmask
from ..functions.prompts import rename_prompt
from ..functions.text import first_json_object, identifier_tokens, json_entries
from ..operators.renaming import (
    accepted_map,
    has_untyped_value,
    judge_entries,
    rename_tokens,
)
from ..operators.responses import attach_responses

# Outcome of a document.
SUCCEEDED = "succeeded"
UNCHANGED = "no_usable_mapping"
FAILED = "failed"


def apply_rename_responses(
    documents: DataFrame, *, text: str = "content", response: str = "llm_response", mask_first: bool = False
) -> DataFrame:
    """Rename each document by the mapping in its own response.

    Adds ``verdicts`` (every proposed pair with its reason), ``status`` and ``renamed``. All steps
    work on the row, so the corpus is rewritten without a shuffle. A document whose response lacks a
    usable mapping stays as it is; one whose mapping holds a value that is not a string fails and
    also stays. With ``mask_first`` comments and strings are left alone; by default they are renamed
    along with the code.
    """
    body, hits = F.col(text), None
    staged = documents
    if mask_first:
        staged = staged.withColumn("_mask", mask(F.col(text), KINDED))
        body, hits = F.col("_mask.masked"), F.col("_mask.hits")
    staged = (
        staged.withColumn("_object", first_json_object(F.col(response)))
        .withColumn("_entries", json_entries(F.col("_object")))
        .withColumn("_tokens", F.when(F.size("_entries") > 0, F.array_distinct(identifier_tokens(body))))
        .withColumn("verdicts", judge_entries(F.col("_entries"), F.col("_tokens")))
        .withColumn("_mapping", accepted_map(F.col("verdicts")))
    )
    # An object that parses but whose values cannot be typed holds a nested value with repeated keys.
    broken = F.col("_object").isNotNull() & F.col("_entries").isNull()
    failed = F.coalesce(F.col("error").isNotNull(), F.lit(False)) if "error" in documents.columns else F.lit(False)
    status = (
        F.when(failed | broken | F.coalesce(has_untyped_value(F.col("verdicts")), F.lit(False)), FAILED)
        .when(F.coalesce(F.size("_mapping"), F.lit(0)) <= 0, UNCHANGED)
        .otherwise(SUCCEEDED)
    )
    # A column of its own: the kernel must not end up inside a lambda.
    staged = staged.withColumn("_renamed", rename_tokens(body, F.col("_mapping")))
    renamed = F.col("_renamed")
    if mask_first:
        renamed = unmask(renamed, hits, KINDED)
    return (
        staged.withColumn("status", status)
        .withColumn("renamed", F.when(F.col("status") == SUCCEEDED, renamed).otherwise(F.col(text)))
        .drop("_mask", "_object", "_entries", "_tokens", "_mapping", "_renamed")
    )


def rename_corpus(
    corpus: DataFrame,
    responder: Callable[[str], str],
    *,
    text: str = "content",
    mask_first: bool = False,
    concurrency: int = 12,
) -> DataFrame:
    """Ask for a mapping per document and apply it."""
    shown = mask(F.col(text), KINDED)["masked"] if mask_first else F.col(text)
    prompts = corpus.withColumn("_prompt", rename_prompt(shown))
    answered = attach_responses(prompts, responder, prompt="_prompt", concurrency=concurrency)
    return apply_rename_responses(answered.drop("_prompt"), text=text, mask_first=mask_first)


def rename_summary(renamed: DataFrame) -> DataFrame:
    """Documents per status, and over all documents the pairs accepted and dropped by reason."""
    documents = renamed.groupBy(F.lit("document").alias("what"), F.col("status").alias("outcome"))
    pairs = unnest(renamed, F.col("verdicts"), item="v").groupBy(
        F.lit("pair").alias("what"), F.coalesce("v.reason", F.lit("accepted")).alias("outcome")
    )
    count = F.count("*").alias("count")
    return documents.agg(count).unionByName(pairs.agg(count))
