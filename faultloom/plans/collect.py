"""Collect: a source corpus to prompts to responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import detection_prompt, record_key
from ..operators.responses import attach_responses, unanswered
from ..schemas import RESPONSES
from ..sources.log import append_log, read_log


def build_prompts(corpus: DataFrame, *, model: str, version: str = "v2") -> DataFrame:
    """Response records without the response, from ``path, content``."""
    prompt = F.col("llm_prompt")
    return (
        corpus.select(F.col("path").alias("input_file_rel_path"), F.col("content").alias("input_file_contents"))
        .withColumn("llm_prompt", detection_prompt(F.col("input_file_contents"), version))
        .withColumn("llm_model_name", F.lit(model))
        .withColumn("uuid", record_key(F.col("input_file_rel_path"), prompt, F.col("llm_model_name")))
    )


def collect_responses(
    corpus: DataFrame,
    responder: Callable[[str], str],
    *,
    model: str,
    version: str = "v2",
    log: DataFrame | None = None,
    ordered: bool = False,
    concurrency: int = 1,
) -> DataFrame:
    """Response records plus an ``error`` column; with a ``log`` only what it lacks is asked.

    ``ordered`` sorts by path. The prompts are sorted, not the answers: sorting samples its input,
    which would ask for some answers twice.
    """
    prompts = build_prompts(corpus, model=model, version=version)
    if log is not None:
        prompts = unanswered(prompts, log)
    if ordered:
        prompts = prompts.orderBy("input_file_rel_path")
    answered = attach_responses(prompts, responder, concurrency=concurrency)
    return answered.select(*RESPONSES.names, "error")


def collect_to_log(
    corpus: DataFrame,
    responder: Callable[[str], str],
    path: str,
    *,
    model: str,
    rounds: int = 1,
    log: DataFrame | None = None,
    **options,
) -> None:
    """Add the successful responses to an NDJSON log that has each record once.

    Only what the log lacks is asked, or what another ``log`` lacks; failed calls stay out, so running again
    retries exactly those, and a repeated run adds nothing. A job's rows become visible when it ends;
    ``rounds`` splits the corpus by path into that many jobs, so that an interrupted run keeps the answers of
    the rounds it finished.
    """
    turn = F.pmod(F.xxhash64("path"), F.lit(rounds))
    for number in range(rounds):
        part = corpus if rounds == 1 else corpus.where(turn == number)
        known = read_log(corpus.sparkSession, path, RESPONSES) if log is None else log
        answered = collect_responses(part, responder, model=model, log=known, **options)
        append_log(answered.where(F.col("error").isNull()).drop("error"), path)
