"""Incremental indexing: turns arrive, notes are appended exactly once.

What a micro-batch costs depends on the batch and on the conversations it
touches, not on history: stored keys are looked up in the batch's own folders of
the collection, and no key is kept in stream state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallgrid.operators.ledger import with_turn_key
from recallgrid.operators.neighbors import nearest
from recallgrid.operators.notes import notes_from_turns
from recallgrid.sources.collections import Collection

KEY = ("conv_id", "turn_key")


def add_turns(
    turns: DataFrame, collection: Collection, batch_id: int, encode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Append the notes of a batch of turns; returns those that this batch has stored.

    A turn whose key is stored already is left out, so a replayed batch, also one
    that was cut off on the way, completes what it wrote before.
    """
    notes = notes_from_turns(with_turn_key(turns), keep=("turn_key",))
    if encode is not None:
        notes = notes.withColumn("embedding", encode(F.col("content")))
    touched = collection.add(notes.withColumn("batch", F.lit(batch_id).cast("long")), KEY)
    return collection.read(touched).filter(F.col("batch") == batch_id)


def ingest_turns(
    turns: DataFrame,
    collection: Collection,
    checkpoint: str,
    encode: Callable[[Column], Column] | None = None,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Append a note per new turn of a stream.

    The stream itself is stateless.  ``after_batch`` gets the notes its batch
    has stored; it runs again when a batch is replayed, with the same notes.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        own = Collection(batch.sparkSession, collection.path, collection.partitions)
        if batch.isEmpty():
            return
        stored = add_turns(batch, own, batch_id, encode)
        if after_batch is not None:
            after_batch(stored, batch_id)

    return (
        turns.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's result to its own folder; a replay replaces the same folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def batch_neighbors(
    new_notes: DataFrame, collection: Collection, batch_id: int, k: int = 5, metric: str = "l2sq"
) -> DataFrame:
    """Nearest earlier notes of a batch's notes, among those stored up to that batch.

    Only the folders of the batch's conversations are read, and of these only
    the notes of the conversations themselves.
    """
    stored = collection.read(collection.buckets_of(new_notes)).filter(F.col("batch") <= batch_id)
    touched = new_notes.select("conv_id").distinct()
    pool = stored.select("conv_id", F.col("seq").alias("neighbor_seq"), "embedding")
    return nearest(
        new_notes,
        pool.join(touched, "conv_id", "left_semi"),
        group=["conv_id"],
        query_key="seq",
        item_key="neighbor_seq",
        k=k,
        metric=metric,
        earlier_only=True,
    )
