"""Retrieval records to metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import COVERAGE_THRESHOLD, token_f1
from recallgrid.operators import answer_metrics, answers, matching, questions, retrieval_metrics
from recallgrid.operators.evolution import Completer
from recallgrid.sources.stages import stage


def chunk_texts(records: DataFrame) -> DataFrame:
    """Records in written form (chunk structs) to chunk texts."""
    return records.withColumn("chunks", F.transform("chunks", lambda c: c["content"]))


def evaluate_retrieval(
    records: DataFrame,
    ks: Sequence[int | None] = (3, 5, 10),
    threshold: float = COVERAGE_THRESHOLD,
    mode: str = "ir",
    nfkc: bool = True,
    by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Per-record metrics, averages, and the records left out for lack of evidence."""
    judged, skipped = matching.split_no_evidence(records)
    per_record = retrieval_metrics.per_record_metrics(judged, ks, threshold, mode, nfkc)
    return {
        "per_record": per_record,
        "averages": retrieval_metrics.average_metrics(per_record, ks, mode, by, records),
        "skipped": skipped,
    }


def evaluate_generation(
    records: DataFrame,
    asked: DataFrame,
    completer: Completer | None = None,
    context_k: int = 5,
    stem: bool = True,
    key: str = "row_id",
    position: str | Sequence[str] = "conv_idx",
) -> dict[str, DataFrame]:
    """Answers, their metrics, and the records without a known answer.

    ``records`` needs a unique ``row_id``.  A model's answers are staged, so it
    is asked once however often they are read.  ``asked`` has its conversations'
    place in ``position``.
    """
    known = questions.attach_ground_truth(records, asked, position)
    made = answers.generate_answers(
        questions.drop_missing_ground_truth(known), completer, context_k
    )
    if completer is not None:
        made = stage(made, "answers")
    scored = made.withColumn(
        "f1", token_f1(F.col("generated_answer"), F.col("ground_truth"))
    ).withColumn("num_chunks_retrieved", F.coalesce(F.size("chunks"), F.lit(0)))
    metrics = answer_metrics.generation_metrics(
        made.select(
            key,
            "category",
            F.col("generated_answer").alias("prediction"),
            F.col("ground_truth").alias("reference"),
        ),
        key,
        stem=stem,
    )
    return {
        "per_question": scored,
        "metrics": metrics,
        "missing": questions.missing_ground_truth(known),
    }
