"""Consolidation points on a stream of evolved notes, with one running count per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

POINT = "conv_id string, seq long, evolved_count long"


class EvolvedCount(StatefulProcessor):
    """Counts evolved notes in the order of their sequence numbers.

    State: the next number and the count so far, and flags that arrived ahead of
    a gap.  What comes again for a number already counted is left out.
    """

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle) -> None:
        self.progress = handle.getValueState("progress", "next_seq bigint, evolved bigint")
        self.ahead = handle.getMapState("ahead", "seq bigint", "evolved boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        at, count = map(int, self.progress.get()) if self.progress.exists() else (0, 0)
        come: dict[int, bool] = {}
        for batch in rows:
            come.update(zip(batch["seq"].tolist(), batch["evolved"].tolist(), strict=True))
        points = []
        while True:
            if at in come:
                evolved = come.pop(at)
            elif self.ahead.containsKey((at,)):
                evolved = self.ahead.getValue((at,))[0]
                self.ahead.removeKey((at,))
            else:
                break
            if evolved:
                count += 1
                if count % self.threshold == 0:
                    points.append((key[0], at, count))
            at += 1
        for seq, evolved in come.items():
            if seq > at:
                self.ahead.updateValue((seq,), (bool(evolved),))
        self.progress.update((at, count))
        yield pd.DataFrame(points, columns=["conv_id", "seq", "evolved_count"])

    def close(self) -> None:
        pass


def consolidation_points_stream(evolved: DataFrame, threshold: int) -> DataFrame:
    """Every ``threshold``-th evolved note of a conversation, as ``operators.notes.consolidation_points``.

    ``evolved``: a stream of ``conv_id, seq, should_evolve``, one row per note
    with ``seq`` from 0 without gaps in the end, in any order of arrival.  The
    session must use the RocksDB state store.
    """
    flag = F.coalesce("should_evolve", F.lit(False)).alias("evolved")
    keyed = evolved.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("seq").cast("long").alias("seq"), flag)
    return keyed.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=EvolvedCount(threshold), outputStructType=POINT, outputMode="Append", timeMode="None"
    )
