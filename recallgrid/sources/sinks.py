"""Writers of retrieval records, evaluation reports and bad cases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.sources.stages import stage

CHUNK_FIELDS = ["id", "content", "score", "keywords", "tags", "context", "timestamp", "category"]
QUESTION_FIELDS = ["question_id", "question", "answer", "evidences", "category", "conv_id"]


def nest_records(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One record per question with its ranked chunks.

    ``hits`` is keyed by (conv_id, q_idx) and has ``rank`` and the chunk fields;
    a question has at most top-k of them.  Questions without hits get none.
    """
    chunks = hits.groupBy("conv_id", "q_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*CHUNK_FIELDS).alias("chunk")))).alias(
            "ranked"
        )
    )
    nested = F.transform("ranked", lambda r: r["chunk"])
    none = F.array().cast(
        "array<struct<id:string,content:string,score:double,keywords:array<string>,"
        "tags:array<string>,context:string,timestamp:string,category:string>>"
    )
    return questions.join(chunks, ["conv_id", "q_idx"], "left").select(
        *QUESTION_FIELDS[:3], F.coalesce(nested, none).alias("chunks"), *QUESTION_FIELDS[3:]
    )


def write_retrieval_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Nested records as JSON Lines (UTF-8) or Parquet."""
    records.write.mode("overwrite").format(fmt).save(path)


def write_eval_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """One folder of Parquet per report section (macro, counts, per-record, skipped, ...)."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").parquet(f"{path}/section={name}")


def eval_sections(
    meta: DataFrame, averages: DataFrame, per_record: DataFrame, skipped: DataFrame, failed: DataFrame
) -> dict[str, DataFrame]:
    """The parts of a retrieval report from its tables; the averages are made once for all parts."""
    averages = stage(averages, "averages", heavy=False)
    overall = averages.filter("section = 'overall'").drop("section", "category")
    macro = [c for c in averages.columns if c.startswith("macro_")]
    micro = [c for c in averages.columns if c.startswith("micro_")]
    sums = ["tp_evidence", "retrieved", "gold", "rel_chunks", "dcg", "idcg"]
    return {
        "meta": meta,
        "macro": overall.select("k_label", "n", *macro),
        "micro": overall.select("k_label", *micro),
        "counts": overall.select("k_label", "n"),
        "micro_sums": overall.select("k_label", *sums),
        "category": averages.filter("section = 'category'").drop("section"),
        "per_record": per_record,
        "skipped": skipped,
        "failed": failed,
    }


def _case_columns(cases: DataFrame) -> list[Column]:
    """What places a case: its file where cases of several are together, its cut-off, its number."""
    source = ["source"] if "source" in cases.columns else []
    return [F.col("k_label").alias("k"), *[F.col(c) for c in [*source, "idx", "question_id", "reason"]]]


def write_bad_cases(cases: DataFrame, path: str) -> None:
    """Bad cases as JSON, one folder per cut-off, metrics nested; ``source`` is kept where there is one."""
    cases.select(
        *_case_columns(cases),
        F.struct("precision", "recall", "f1", "ndcg").alias("metrics"),
        "question",
    ).write.mode("overwrite").partitionBy("k").json(path)


def write_bad_cases_csv(cases: DataFrame, path: str) -> None:
    """The same, flat, with a header."""
    cases.select(
        *_case_columns(cases),
        "precision",
        "recall",
        "f1",
        "ndcg",
        F.coalesce("question", F.lit("")).alias("question"),
    ).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_generation_report(
    config: DataFrame, metrics: DataFrame, per_question: DataFrame, path: str
) -> None:
    """Config, overall, per-category and per-question tables; the metrics are made once."""
    metrics = stage(metrics, "metrics", heavy=False)
    write_eval_report(
        {
            "config": config,
            "overall": metrics.filter("section = 'overall'").drop("section", "category"),
            "by_category": metrics.filter("section = 'category'").drop("section"),
            "per_question": per_question,
        },
        path,
    )
