"""A training corpus from raw documents: rules, line dedup, near-dedup, decontamination, packing.

Each stage takes what the one before kept, as written Parquet, and returns the
columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

import recallgrid  # noqa: E402
from recallgrid.llm import (  # noqa: E402
    decontamination,
    line_dedup,
    near_dedup,
    packing,
    quality_rules,
)
from recallgrid.llm.tables import stage  # noqa: E402
from recallgrid.session import shared_dir  # noqa: E402

cloudpickle.register_pickle_by_value(recallgrid)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"))
    changed = F.col("n_dropped") > 0
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages.

    Contamination is a matter of the text alone, so texts are judged by their
    digest: ids may be missing, or stand on several texts.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mark = F.md5(F.coalesce("text", F.lit("")))
    found = decontamination.find_passages(docs.select(mark.alias("mark"), "text"), items, id_col="mark")
    bad = decontamination.report(found).filter("contaminated").select(F.col("doc_id").alias("_mark")).distinct()
    return docs.join(stage(bad, "contaminated"), mark == F.col("_mark"), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(docs, vocabulary, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("pack", pack),
]

# Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and reread."""
    folder = f"{shared_dir(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
