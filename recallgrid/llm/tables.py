"""Tables that several later steps read, kept in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from recallgrid.session import shared_dir


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write and reread: computed once, and a lost executor costs a read.  Options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
