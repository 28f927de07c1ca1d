"""Reading conversation datasets and retrieval records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.operators.matching import coerce_records
from recallgrid.operators.ordered import sum_before
from recallgrid.schemas import CORRUPT, DATASET, RETRIEVAL_RECORD
from recallgrid.sources.stages import stage


def _read_json(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, lines: bool
) -> DataFrame:
    """Rows with ``source`` (their file) and ``position`` (their place in it).

    Positions count from 0 in every file, however it is split: the rows of every
    split are counted in a pass of their own.  JSON Lines files are split over
    tasks; an array file cannot be, so one task streams it.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    rows = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(wanted)
        .withColumn("source", F.col("_metadata.file_path"))
        .withColumn("_split", F.col("_metadata.file_block_start"))
        .withColumn("position", F.monotonically_increasing_id())
    )
    # A split lies in one task, which may read several; rows before it are summed along the file.
    splits = rows.groupBy("source", "_split").agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    begins = sum_before(splits, ["source"], ["_split"], "_rows", "_begin").drop("_rows")
    # Staged, so that Spark knows how few they are and the rows stay where they are read.
    begins = stage(begins, "splits", heavy=False)
    here = F.col("position") - F.col("_first") + F.col("_begin")
    return (
        rows.join(begins, ["source", "_split"], "left")
        .withColumn("position", F.coalesce(here, F.raise_error(F.lit("a file was split anew while it was read")).cast("long")))
        .drop("_split", "_first", "_begin")
    )


def read_dataset(
    spark: SparkSession, paths: str | Sequence[str], lines: bool = False
) -> DataFrame:
    """Conversations; a missing id becomes ``conv_{position}``.

    Rows that could not be parsed keep their text in ``_corrupt``; see
    ``quarantine``.
    """
    rows = _read_json(spark, paths, DATASET, lines)
    return rows.withColumn("conv_idx", F.col("position")).withColumn(
        "conv_id",
        F.coalesce("conv_id", F.concat(F.lit("conv_"), F.col("position").cast("string"))),
    )


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the report (source, position, text) of the others."""
    # Spark refuses to read the corrupt-record column alone, so one more is looked at.
    looked_at = F.col("conv_id").isNull() | (F.length("conv_id") >= 0)
    good = rows.filter(F.col(CORRUPT).isNull() & looked_at).drop(CORRUPT)
    bad = rows.filter(F.col(CORRUPT).isNotNull() & looked_at).select("source", "position", CORRUPT)
    return good, bad


def read_retrieval_records(
    spark: SparkSession, paths: str | Sequence[str], lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records of one or many files with string chunks and evidences, and the failed rows.

    ``source`` tells the files apart, so all of them are evaluated in one job;
    ``idx`` is the position and stands in for a missing id.
    """
    good, bad = quarantine(_read_json(spark, paths, RETRIEVAL_RECORD, lines))
    named = good.withColumnRenamed("position", "idx").withColumn(
        "question_id",
        F.coalesce("question_id", F.concat(F.lit("idx"), F.col("idx").cast("string"))),
    )
    return coerce_records(named), bad
