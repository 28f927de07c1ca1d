"""Summaries of runs, as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.retrieval_metrics import METRICS

SCORE_KEYS = ["section", "category", "k_label", "metric"]


def index_summary(turns: DataFrame, notes: DataFrame, **settings: str) -> DataFrame:
    """Per conversation: turns found and notes stored, plus the run's settings."""
    found = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_turns"))
    stored = notes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_indexed"))
    return found.join(stored, "conv_id", "left").select(
        "conv_id",
        "num_turns",
        F.coalesce("num_indexed", F.lit(0)).alias("num_indexed"),
        *[F.lit(str(v)).alias(name) for name, v in settings.items()],
    )


def run_totals(records: DataFrame) -> DataFrame:
    """One row: conversations, questions, answered questions, chunks per question."""
    chunks = F.coalesce(F.size("chunks"), F.lit(0))
    per_conv = records.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(chunks > 0).alias("processed"),
        F.sum(chunks).alias("chunks"),
    )
    return per_conv.agg(
        F.count(F.lit(1)).alias("conversations"),
        F.coalesce(F.sum("questions"), F.lit(0)).alias("questions_total"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("questions_processed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_total"),
    )


def _long(df: DataFrame, keys: Sequence[Column], metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(*keys, F.explode(pairs).alias("m")).select(*SCORE_KEYS[:3], "m.metric", "m.value")


def scoreboard(
    retrieval: DataFrame | None = None, generation: DataFrame | None = None
) -> DataFrame:
    """Retrieval and answer metrics as rows (section, category, k_label, metric, value)."""
    parts = []
    if retrieval is not None:
        names = ["n", *[f"{s}_{m}" for s in ("macro", "micro") for m in METRICS]]
        keys = [
            F.concat(F.lit("retrieval_"), "section").alias("section"),
            F.coalesce("category", F.lit("ALL")).alias("category"),
            F.col("k_label"),
        ]
        parts.append(_long(retrieval, keys, names))
    if generation is not None:
        names = [c for c in generation.columns if c not in ("section", "category")]
        keys = [
            F.concat(F.lit("generation_"), "section").alias("section"),
            F.coalesce("category", F.lit("ALL")).alias("category"),
            F.lit("-").alias("k_label"),
        ]
        parts.append(_long(generation, keys, names))
    if not parts:
        raise ValueError("give at least one metrics table")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def in_report_order(rows: DataFrame) -> DataFrame:
    """Rows by section, category and cut-off, numbers before ``ALL``."""
    return rows.orderBy(
        F.desc("section"), F.asc_nulls_first("category"), F.expr("try_cast(k_label AS int)").asc_nulls_last()
    )


def pivot_scoreboard(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One column per metric; the metric names are given, so no extra pass is run."""
    return scores.groupBy(*SCORE_KEYS[:3]).pivot("metric", list(metrics)).agg(F.first("value"))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Same metric from two runs, with the difference."""
    a = first.withColumnRenamed("value", "value_a")
    b = second.withColumnRenamed("value", "value_b")
    return a.join(b, SCORE_KEYS, "full").withColumn("delta", F.col("value_b") - F.col("value_a"))
