"""Best-fit packing of documents into training sequences.

``pieces`` encodes whole texts, ends each with ``end_id`` and cuts what is
longer than a sequence into whole sequences, the remainder going first.
``pack`` is bounded-space online best-fit: a task keeps a fixed number of open
bins, found through a bitset keyed by free space (one integer, one bit a free
space); a piece goes where it leaves least, and when a bin too many would be
open the fullest closes first.  Pieces are dealt to tasks by a hash, about
``per_task`` of them each, and come in hash order, so that lengths are mixed
everywhere and a repeated task packs alike; texts are never shuffled.

Null and empty texts are one piece of the end id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.bpe import TextEncoder
from recallgrid.llm.tables import stage
from recallgrid.llm.token_counts import GROUP
from recallgrid.llm.worker import id_type, kept, texts_of

OPEN_BINS = 1024
PER_TASK = 100_000


def pieces(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian bytes."""
    own = id_type(df, id_col)
    end = np.array([end_id], "<u4").tobytes()

    def rows(doc_ids: list, coded: list[bytes]) -> Iterator[tuple]:
        for doc_id, ids in zip(doc_ids, coded, strict=True):
            ids += end
            total, at, number = len(ids) // 4, 0, 0
            size = total % capacity or capacity
            while at < total:
                part = ids[4 * at : 4 * (at + size)]
                yield doc_id, number, at, size, zlib.crc32(part), part
                at, size, number = at + size, capacity, number + 1

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {own}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("ids", vocabulary, pattern), lambda: TextEncoder(vocabulary, pattern, False))
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 3, pa.binary()]
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                coded = encoder.encode(part["text"].to_pylist())
                columns = zip(*rows(part["doc_id"].to_pylist(), coded), strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)], names)

    return texts_of(df, id_col, text_col).mapInArrow(run, schema)


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int, limit: int, first_id: int):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.free = 0  # bit s: some open bin has s places free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def take(self, space: int) -> int:
        bins = self.by_free[space]
        found = bins.pop()
        if not bins:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_id = self.take(space)
        else:
            if self.open >= self.limit:
                self.take((self.free & -self.free).bit_length() - 1)
            space, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = space - length
        if left:
            self.by_free[left].append(bin_id)
            self.free |= 1 << left
            self.open += 1
        return bin_id, self.capacity - space


def pack(
    cut: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS, per_task: int = PER_TASK
) -> DataFrame:
    """``cut`` with sequence_id and the offset of each piece in its sequence."""
    cut = stage(cut, "pieces")
    tasks = max(1, -(-cut.count() // per_task))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = (
        cut.withColumn("_key", key)
        .repartition(tasks, "_key")
        .sortWithinPartitions("_key", "doc_id", "piece", "ids_crc32")
        .drop("_key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].to_pylist()]
            ids, offsets = zip(*placed, strict=True) if placed else ((), ())
            yield batch.append_column("sequence_id", pa.array(ids, pa.int64())).append_column(
                "offset", pa.array(offsets, pa.int64())
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids as little-endian bytes; needs pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
