"""From retrieved chunks to answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import prompts, text
from recallgrid.operators.evolution import Completer, complete


def answer_prompts(records: DataFrame, context_k: int = 5) -> DataFrame:
    """Add ``context`` and ``prompt`` from the first ``context_k`` chunks."""
    return records.withColumn(
        "context", text.build_context(F.col("chunks"), context_k)
    ).withColumn("prompt", prompts.answer_prompt(F.col("context"), F.col("question")))


def generate_answers(
    records: DataFrame, completer: Completer | None = None, context_k: int = 5
) -> DataFrame:
    """Add ``generated_answer``; a failed call (null reply) gives an empty answer.

    Without a model the context itself is the answer, which makes a baseline
    that any model should beat.
    """
    asked = answer_prompts(records, context_k)
    if completer is None:
        replied = asked.withColumn("reply", F.col("context"))
    else:
        replied = complete(asked, completer)
    return replied.withColumn(
        "generated_answer", F.coalesce(text.clean_answer(F.col("reply")), F.lit(""))
    ).drop("reply", "context", "prompt")


def row_completer(answer) -> Completer:
    """A completer from a plain function of the prompt; errors become null replies."""

    def one(prompt: str) -> str | None:
        try:
            return answer(prompt)
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=batch["prompt"].map(one))

    return run
