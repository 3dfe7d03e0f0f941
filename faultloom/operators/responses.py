"""Attaching one response to each prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_responses(
    prompts: DataFrame,
    responder: Callable[[str], str],
    *,
    prompt: str = "llm_prompt",
    into: str = "llm_response",
    concurrency: int = 1,
) -> DataFrame:
    """Add ``into`` and ``error`` by calling ``responder`` on every prompt.

    Only the prompt crosses to Python. A failing call leaves its message in ``error`` and the job
    goes on. ``concurrency`` threads per task overlap calls that wait on a service. The result is
    not repeatable in general: write it out before reading it twice.
    """

    @F.pandas_udf("struct<response:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def one(text):
            try:
                return responder(text).strip(), None
            except Exception as failure:
                return None, f"{type(failure).__name__}: {failure}"

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                answers = map(one, batch) if concurrency == 1 else pool.map(one, batch)
                yield pd.DataFrame(list(answers), columns=["response", "error"])

    answered = prompts.withColumn("_answer", call.asNondeterministic()(F.col(prompt)))
    return answered.withColumns({into: F.col("_answer.response"), "error": F.col("_answer.error")}).drop(
        "_answer"
    )


def join_responses(
    prompts: DataFrame, responses: DataFrame, *, key: str = "uuid", into: str = "llm_response"
) -> DataFrame:
    """Add responses that were obtained elsewhere, matched by record key."""
    return prompts.join(responses.select(key, into), key, "left")


def unanswered(prompts: DataFrame, log: DataFrame, *, key: str = "uuid") -> DataFrame:
    """Prompts whose key is not in the response log yet, to resume an interrupted run."""
    return prompts.join(log.select(key), key, "left_anti")


def one_per_key(log: DataFrame, *, key: str = "uuid", order: str = "llm_response") -> DataFrame:
    """One row per record key of a log that several runs appended to: that of the largest ``order``.

    Pass a time column to keep the latest; the default keeps an answer rather than none. Ties go to the
    largest row by its other columns, so the choice never depends on the run. Maxima are aggregated before
    the shuffle.
    """
    others = [c for c in log.columns if c not in (key, order)]
    best = F.max(F.struct(order, *others)).alias("_best")
    return log.groupBy(key).agg(best).select(*[F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in log.columns])
