"""Intermediate tables: results that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from recallgrid.session import shared_dir, spread


def stage(df: DataFrame, name: str, heavy: bool = True) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Used where a costly result (pairing, nearest neighbours, model replies) has
    several readers: it is then computed once, and a lost executor costs a read
    instead of the whole lineage.  Joins see its true size.  Without ``heavy``
    the rows are read as they were written, for work that costs little per row.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/recallgrid/{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    return spread(rows) if heavy else rows
