"""Running values over long ordered groups, without one task per group.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task.  Here the
group is cut into chunks of consecutive ordinals; the window runs inside a
chunk, and only one summary row per chunk is carried along the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
BUCKET = 1_024


def chunk_of(ordinal: str, size: int) -> Column:
    return F.expr(f"`{ordinal}` div {int(size)}")


def before(group: Sequence[str], order: Sequence[str]):
    """All rows of the group that stand before the current one."""
    return (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def sum_before(
    summary: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    bucket: int = BUCKET,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, in two levels.

    ``order[0]`` must be an integer; rows are first summed inside buckets of it
    and then over bucket totals, so that a group with very many summary rows is
    still spread over tasks.
    """
    cut = summary.withColumn("_bucket", chunk_of(order[0], bucket))
    totals = cut.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
    offsets = (
        totals.withColumn("_base", F.sum("_total").over(before(group, ["_bucket"])))
        .filter(F.col("_base").isNotNull())
        .drop("_total")
    )
    inner = cut.withColumn("_inner", F.sum(value).over(before([*group, "_bucket"], order)))
    return (
        inner.join(offsets, [*group, "_bucket"], "left")
        .withColumn(out, F.coalesce("_inner", F.lit(0)) + F.coalesce("_base", F.lit(0)))
        .drop("_bucket", "_inner", "_base")
    )


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    ordinal: str,
    value: Column,
    out: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``ordinal`` inside the group."""
    keys = [*group, "_chunk"]
    cut = df.withColumn("_chunk", chunk_of(ordinal, chunk)).withColumn("_value", value)
    upto = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    carried = (
        sum_before(totals, group, ["_chunk"], "_sum", "_carry")
        .filter(F.col("_chunk") > 0)
        .drop("_sum")
    )
    return (
        cut.withColumn("_local", F.sum("_value").over(upto))
        .join(carried, keys, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_chunk", "_value", "_local", "_carry")
    )
