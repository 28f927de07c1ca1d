"""Questions to retrieval records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import neighbors, questions, search
from recallgrid.sources.sinks import CHUNK_FIELDS, nest_records


def retrieve(
    dataset: DataFrame,
    notes: DataFrame,
    encode: Callable[[Column], Column],
    k: int = 100,
    metric: str = "l2sq",
) -> DataFrame:
    """Records for all questions whose conversation has notes.

    Distances are found on vectors alone; the chunk fields join the winners.
    """
    asked = questions.askable(questions.explode_questions(dataset)).join(
        notes.select("conv_id").distinct(), "conv_id", "left_semi"
    )
    encoded = asked.withColumn("embedding", encode(F.col("question")))
    hits = neighbors.retrieve_topk(encoded, notes, k, metric=metric)
    fields = [f for f in CHUNK_FIELDS if f != "score"]
    chunks = search.project_chunks(
        search.hydrate_hits(hits, notes, ("conv_id", "seq"), fields)
    )
    return nest_records(chunks, asked)
