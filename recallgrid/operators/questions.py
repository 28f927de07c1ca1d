"""Questions: unfolding, filtering, ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import category_label


def explode_questions(dataset: DataFrame) -> DataFrame:
    """One row per question; a missing id becomes ``{conv_id}_q{position}``.

    The place of a conversation (``source``, ``conv_idx``) is kept where it is known.
    """
    place = [c for c in ("source", "conv_idx") if c in dataset.columns]
    return dataset.select("conv_id", *place, F.posexplode("qas").alias("q_idx", "qa")).select(
        "conv_id",
        *place,
        F.col("q_idx").cast("long").alias("q_idx"),
        F.coalesce(
            "qa.question_id",
            F.concat(F.col("conv_id").cast("string"), F.lit("_q"), F.col("q_idx").cast("string")),
        ).alias("question_id"),
        F.coalesce("qa.question", F.lit("")).alias("question"),
        F.coalesce("qa.answer", F.lit("")).alias("answer"),
        F.coalesce("qa.evidences", F.array().cast("array<string>")).alias("evidences"),
        category_label(F.col("qa.category")).alias("category"),
    )


def askable(questions: DataFrame) -> DataFrame:
    """Questions that have a text."""
    return questions.filter(F.coalesce("question", F.lit("")) != "")


def unindexed_questions(questions: DataFrame, notes: DataFrame, group=("conv_id",)) -> DataFrame:
    """Report of questions whose collection has no note at all."""
    keys = list(group)
    return questions.join(notes.select(*keys).distinct(), keys, "left_anti")


def take_conversations(conversations: DataFrame, n: int, position: str) -> DataFrame:
    """Rows of the first ``n`` conversations by position (ids may sort otherwise)."""
    first = conversations.select(position).distinct().orderBy(position).limit(n)
    return conversations.join(first, position, "left_semi")


def limit_questions(records: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` records in file order."""
    return records.orderBy(*order).limit(n)


def attach_ground_truth(
    records: DataFrame,
    questions: DataFrame,
    position: str | Sequence[str],
    positional_fallback: bool = False,
) -> DataFrame:
    """Add ``ground_truth``: by question id, else by question text.

    ``questions`` needs ``conv_id, q_idx, question_id, question, answer`` and
    ``records`` needs ``conv_id, question_id, question``.  Where two questions
    share a text the one that comes last wins: by ``position``, the column or
    columns that order conversations as their files do, then by place within one.
    ``positional_fallback`` also accepts an id that is a bare position within any
    conversation, again with the last one winning.
    """
    order = [position] if isinstance(position, str) else list(position)
    place = F.struct(*order, "q_idx")

    def last_answer(key, name):
        known = questions.filter(F.coalesce(F.col(key), F.lit("")) != "")
        return known.groupBy(F.col(key).alias(name)).agg(
            F.max_by("answer", place).alias(f"by_{name}")
        )

    by_id = questions.groupBy("conv_id", F.col("question_id").alias("id")).agg(
        F.max_by("answer", "q_idx").alias("by_id")
    )
    joined = (
        records.withColumn("id", F.col("question_id"))
        .withColumn("text", F.col("question"))
        .join(by_id, ["conv_id", "id"], "left")
        .join(last_answer("question", "text"), "text", "left")
    )
    choices = [F.nullif("by_id", F.lit(""))]
    if positional_fallback:
        by_place = questions.groupBy(F.col("q_idx").cast("string").alias("id")).agg(
            F.max_by("answer", F.struct(*order)).alias("by_place")
        )
        joined = joined.join(by_place, "id", "left")
        choices.append(F.nullif("by_place", F.lit("")))
    choices.append(F.nullif("by_text", F.lit("")))
    return joined.withColumn("ground_truth", F.coalesce(*choices)).drop(
        "id", "text", "by_id", "by_text", "by_place"
    )


def drop_missing_ground_truth(records: DataFrame) -> DataFrame:
    return records.filter(F.col("ground_truth").isNotNull())


def missing_ground_truth(records: DataFrame) -> DataFrame:
    """Report of the records ``drop_missing_ground_truth`` leaves out."""
    return records.filter(F.col("ground_truth").isNull())
