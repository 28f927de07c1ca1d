"""What has been done already: shards, completion marks, processed turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import note_id, turn_key


def shard_filter(conversations: DataFrame, n: int, i: int, position: str = "conv_idx") -> DataFrame:
    """Conversations of shard ``i`` of ``n``.

    Only for splitting work between separate jobs; inside a job Spark's own
    partitioning does this.
    """
    return conversations.filter(F.pmod(F.col(position), F.lit(n)) == i)


def keep_known(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(keys_of.select(*keys).distinct(), list(keys), "left_semi")


def drop_known(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return df.join(keys_of.select(*keys).distinct(), list(keys), "left_anti")


def skip_completed(turns: DataFrame, completed: DataFrame) -> DataFrame:
    return drop_known(turns, completed, ["conv_id"])


def with_turn_key(turns: DataFrame) -> DataFrame:
    return turns.withColumn("turn_key", turn_key(F.col("turn_idx"), F.col("timestamp")))


def skip_processed_turns(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Turns whose key the ledger ``(conv_id, turn_key)`` does not hold."""
    return drop_known(with_turn_key(turns), ledger, ["conv_id", "turn_key"])


def ledger_of(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """The ledger ``(conv_id, turn_key)`` of the turns whose notes are stored."""
    own = with_turn_key(turns).withColumn("id", note_id(F.col("conv_id"), F.col("turn_idx"), F.col("content")))
    return keep_known(own, notes, ["id"]).select("conv_id", "turn_key").distinct()


def completed_of(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Conversations, ``(conv_id)``, all of whose turns are in the ledger."""
    open_ones = skip_processed_turns(turns, ledger).select("conv_id")
    return drop_known(turns.select("conv_id").distinct(), open_ones, ["conv_id"])
