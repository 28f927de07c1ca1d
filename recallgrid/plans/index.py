"""Dataset to notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import evolution, ledger, neighbors
from recallgrid.operators.notes import notes_from_turns
from recallgrid.operators.turns import explode_messages, pair_turns
from recallgrid.sources.stages import stage


def index_dataset(
    dataset: DataFrame,
    encode: Callable[[Column], Column],
    completed: DataFrame | None = None,
    processed: DataFrame | None = None,
) -> DataFrame:
    """Notes with vectors for all turns that are not in the ledgers."""
    turns = pair_turns(explode_messages(dataset))
    if completed is not None:
        turns = ledger.skip_completed(turns, completed)
    if processed is not None:
        turns = ledger.skip_processed_turns(turns, processed)
    return notes_from_turns(turns).withColumn("embedding", encode(F.col("content")))


def neighbor_ids(notes: DataFrame, k: int = 5, metric: str = "l2sq") -> DataFrame:
    """As-of neighbours of every note, with the ids of both sides."""
    near = neighbors.asof_neighbors(notes, k, metric=metric)
    mine = notes.select("conv_id", "seq", F.col("id").alias("note_id"))
    other = notes.select("conv_id", F.col("seq").alias("neighbor_seq"), "id")
    return near.join(mine, ["conv_id", "seq"]).join(other, ["conv_id", "neighbor_seq"])


def evolve(
    notes: DataFrame,
    completer: evolution.Completer | None = None,
    k: int = 5,
    metric: str = "l2sq",
    limit: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """Evolved notes and the decisions behind them.

    With a text model every note that has earlier neighbours is put to it;
    without one the distance rule decides.  All decisions see the notes as they
    were added, so they are taken in parallel.  Neighbours and decisions are
    staged, as both are read again when the decisions are applied.
    """
    near = stage(neighbor_ids(notes, k, metric), "neighbors")
    if completer is None:
        decisions = evolution.distance_rule(near, limit)
    else:
        asked = evolution.evolution_prompts(notes, near, k).select("id", "seq", "prompt")
        decisions = evolution.parse_decisions(evolution.complete(asked, completer)).select(
            "id", "seq", "decision"
        )
        decisions = stage(decisions, "decisions")
    return evolution.apply_evolution(notes, decisions, near), decisions
