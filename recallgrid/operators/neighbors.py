"""Exact nearest-neighbour joins inside groups.

A group's queries and items are cut into tiles of bounded size, and every pair of
a query tile and an item tile is one cell.  Spark deals the rows of both sides to
the cells (a group of n items and tiles of t send each query n/t times, and a
group below t just once), a task holds one item tile and streams the cell's
queries past it as matrix products, keeping ``k`` rows per query.  So neither a
row per (query, item) pair nor a whole group ever exists, and a group holding a
large share of all rows is spread over as many tasks as it has cells.  A final
window merges the per-cell winners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions.vectors import DECIMALS, METRICS

BLOCK = 4_096
STRIP = 1_024  # queries compared at a time


def _distances(q: np.ndarray, n: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ n.T
    if metric == "ip":
        return np.subtract(1, dots, out=dots)
    qq, nn = (q * q).sum(axis=1)[:, None], (n * n).sum(axis=1)[None, :]
    if metric == "l2sq":
        dots *= -2
        dots += qq
        dots += nn
        return np.maximum(dots, 0.0, out=dots)
    norms = np.sqrt(qq) * np.sqrt(nn)
    cosine = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return np.subtract(1, cosine, out=cosine)


def _best(
    q_keys: np.ndarray, n_keys: np.ndarray, dist: np.ndarray, k: int, earlier_only: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded distance of the ``k`` best items per query.

    Only entries that can still win after rounding are rounded and sorted; ties
    go to low keys.
    """
    if earlier_only:
        dist[n_keys[None, :] >= q_keys[:, None]] = np.inf
    if dist.shape[1] > k:
        limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] + 2 * 10.0**-DECIMALS
        rows, cols = np.nonzero(dist <= limit)
    else:
        rows, cols = np.indices(dist.shape).reshape(2, -1)
    values = dist[rows, cols]
    possible = np.isfinite(values)
    rows, cols, values = rows[possible], cols[possible], np.round(values[possible], DECIMALS)
    values[values == 0] = 0.0  # no negative zero
    order = np.lexsort((cols, values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.searchsorted(rows, np.arange(dist.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep], values[keep]


def _side(rows: DataFrame, group: Sequence[str], key: str, vector: str) -> DataFrame:
    there = rows.filter(F.col(vector).isNotNull())
    return there.select(*group, F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vec"))


def _directory(queries: DataFrame, items: DataFrame, group: Sequence[str], block: int, ordered: bool) -> DataFrame:
    """Per group with both sides: its number of tiles on each side, and how keys are placed.

    With ``ordered``, tiles are ranges of keys where these are dense enough for
    ranges to be even; then only item tiles up to the query's own are needed.
    """
    keys = queries.select(*group, "key", F.lit(1).alias("q")).unionByName(items.select(*group, "key", F.lit(0).alias("q")))
    sized = keys.groupBy(*group).agg(
        F.sum("q").alias("n_q"), F.sum(1 - F.col("q")).alias("n_i"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    reach = F.col("high") - F.col("low") + 1
    ranged = F.lit(ordered) & (reach <= 2 * F.greatest("n_q", "n_i"))
    return sized.filter("n_q > 0 and n_i > 0").select(
        *group,
        "low",
        reach.alias("reach"),
        ranged.alias("ranged"),
        *[
            F.ceil(F.when(ranged, F.greatest("n_q", "n_i")).otherwise(F.col(n)) / block).alias(t)
            for n, t in (("n_q", "t_q"), ("n_i", "t_i"))
        ],
    )


def deal(queries: DataFrame, items: DataFrame, group: Sequence[str], block: int, ordered: bool = False) -> DataFrame:
    """Rows of both sides by cell, each cell's items before its queries.

    ``queries``, ``items``: group, ``key``, ``vec``.  Adds ``tile_q``, ``tile_i``
    and ``query``, whether the row is one.
    """
    known = _directory(queries, items, group, block, ordered)

    def tile(count: str) -> Column:
        spot = F.expr(f"(key - low) * {count} div reach")
        return F.when(F.col("ranged"), spot).otherwise(F.pmod(F.xxhash64("key"), F.col(count)))

    def cells(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(first, last))

    last_i = F.when(F.col("ranged"), F.col("tile_q")).otherwise(F.col("t_i") - 1)
    first_q = F.when(F.col("ranged"), F.col("tile_i")).otherwise(F.lit(0).cast("long"))
    asking = queries.join(known, list(group)).withColumn("tile_q", tile("t_q")).withColumn("tile_i", cells(F.lit(0).cast("long"), last_i))
    asked = items.join(known, list(group)).withColumn("tile_i", tile("t_i")).withColumn("tile_q", cells(first_q, F.col("t_q") - 1))
    columns = [*group, "tile_q", "tile_i"]
    rows = [side.select(*columns, F.lit(q).alias("query"), "key", "vec") for side, q in ((asking, True), (asked, False))]
    # Named explicitly, because adaptive execution would merge partitions by the size
    # of the vectors, and comparing them costs many times what reading them does.
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows[0].unionByName(rows[1]).repartition(n, *columns).sortWithinPartitions(*columns, "query")


def _matrix(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a run of rows."""
    vectors = part.column("vec")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of one group differ in length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return part.column("key").to_numpy(zero_copy_only=False), flat.reshape(part.num_rows, -1)


class Cell:
    """The items of a cell, in key order, once the first query comes."""

    def __init__(self, row: pa.RecordBatch, block: int):
        self.row, self.limit = row, 2 * block + 2  # more means that keys repeat
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = self.vectors = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(_matrix(part))
        if sum(len(keys) for keys, _ in self.parts) > self.limit:
            raise ValueError("keys must be unique within their group")

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys is None:
            if len({vectors.shape[1] for _, vectors in self.parts}) > 1:
                raise ValueError("vectors of one group differ in length")
            keys = np.concatenate([keys for keys, _ in self.parts])
            order = np.argsort(keys, kind="stable")
            self.keys, self.vectors = keys[order], np.concatenate([vectors for _, vectors in self.parts])[order]
        return self.keys, self.vectors

    def strips(self, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, vectors = _matrix(part)
        if self.parts and vectors.shape[1] != self.parts[0][1].shape[1]:
            raise ValueError("vectors of one group differ in length")
        for at in range(0, len(keys), STRIP):
            yield keys[at : at + STRIP], vectors[at : at + STRIP]

    def rows(self, group: Sequence[str], n: int) -> list[pa.Array]:
        """The group's columns for ``n`` result rows."""
        take = pa.array(np.zeros(n, np.int64))
        return [self.row.column(g).take(take) for g in group]


def over_cells(
    batches: Iterator[pa.RecordBatch],
    group: Sequence[str],
    block: int,
    ask: Callable[[Cell, pa.RecordBatch], list[pa.RecordBatch]],
    end: Callable[[Cell], list[pa.RecordBatch]] = lambda cell: [],
) -> Iterator[pa.RecordBatch]:
    """Walk through dealt rows; ``ask`` gets a cell with all its items and a run of its queries."""
    names = [*group, "tile_q", "tile_i"]
    cell, own = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in [*names, "query"]:
            column = batch.column(name)
            change[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(change)]).tolist()
        out: list[pa.RecordBatch] = []
        for start, stop in zip(starts, [*starts[1:], n], strict=True):
            part = batch.slice(start, stop - start)
            now = tuple(part.column(name)[0].as_py() for name in names)
            if now != own:
                out += end(cell) if cell else []
                cell, own = Cell(part.slice(0, 1), block), now
            if not part.column("query")[0].as_py():
                cell.hold(part)
            elif cell.parts:
                out += ask(cell, part)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if cell:
        yield from end(cell)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    *,
    group: Sequence[str],
    query_key: str,
    item_key: str,
    query_vector: str = "embedding",
    item_vector: str = "embedding",
    k: int,
    metric: str = "l2sq",
    earlier_only: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest items of the same group for every query.

    The keys are integers, unique within the group; repeated ones are an error.
    With ``earlier_only`` an item must have a smaller key than the query.
    Distances are rounded to six decimals before ranking; ties go to the lower
    item key.  Columns: group, ``query_key``, ``item_key``, ``distance``, ``rank``
    (from 1).
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    group = list(group)
    sides = _side(queries, group, query_key, query_vector), _side(items, group, item_key, item_vector)
    dealt = deal(*sides, group, block, earlier_only)
    names = [*group, "q_key", "n_key", "distance"]

    def ask(cell: Cell, part: pa.RecordBatch) -> list[pa.RecordBatch]:
        n_keys, n = cell.items()
        found = []
        for q_keys, q in cell.strips(part):
            rows, cols, values = _best(q_keys, n_keys, _distances(q, n, metric), k, earlier_only)
            columns = [*cell.rows(group, len(rows)), pa.array(q_keys[rows]), pa.array(n_keys[cols]), pa.array(values, pa.float64())]
            found.append(pa.RecordBatch.from_arrays(columns, names))
        return found

    schema = T.StructType(
        [
            *[dealt.schema[g] for g in group],
            T.StructField("q_key", T.LongType()),
            T.StructField("n_key", T.LongType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    winners = dealt.mapInArrow(lambda batches: over_cells(batches, group, block, ask), schema)
    order = Window.partitionBy(*group, "q_key").orderBy("distance", "n_key")
    return (
        winners.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumnsRenamed({"q_key": query_key, "n_key": item_key})
    )


def best_partners(tokens: DataFrame, row: str, block: int = BLOCK) -> DataFrame:
    """Per token, the cosine distance of its nearest token on the other side of its row.

    ``tokens``: ``row``, ``side`` (``p`` or ``r``), ``tok``, ``embedding``.  Each
    pair of tiles is compared once, for both sides.  Columns: ``row``, ``side``,
    ``tok``, ``distance``.
    """
    sides = [_side(tokens.filter(F.col("side") == s), [row], "tok", "embedding") for s in "pr"]
    dealt = deal(*sides, [row], block)
    names = [row, "side", "tok", "distance"]

    def answer(cell: Cell, side: str, keys: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        values = np.round(best, DECIMALS) + 0.0
        return pa.RecordBatch.from_arrays([*cell.rows([row], len(keys)), pa.array([side] * len(keys)), pa.array(keys), pa.array(values)], names)

    def ask(cell: Cell, part: pa.RecordBatch) -> list[pa.RecordBatch]:
        n_keys, n = cell.items()
        if not hasattr(cell, "least"):
            cell.least = np.full(len(n_keys), np.inf)
        found = []
        for q_keys, q in cell.strips(part):
            dist = _distances(q, n, "cosine")
            np.minimum(cell.least, dist.min(axis=0), out=cell.least)
            found.append(answer(cell, "p", q_keys, dist.min(axis=1)))
        return found

    def end(cell: Cell) -> list[pa.RecordBatch]:
        return [answer(cell, "r", cell.keys, cell.least)] if hasattr(cell, "least") else []

    schema = T.StructType(
        [
            dealt.schema[row],
            T.StructField("side", T.StringType()),
            T.StructField("tok", T.LongType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    found = dealt.mapInArrow(lambda batches: over_cells(batches, [row], block, ask, end), schema)
    return found.groupBy(row, "side", "tok").agg(F.min("distance").alias("distance"))


def retrieve_topk(
    questions: DataFrame,
    notes: DataFrame,
    k: int = 100,
    *,
    metric: str = "l2sq",
    group: Sequence[str] = ("conv_id",),
    question_key: str = "q_idx",
    note_key: str = "seq",
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """Nearest notes of the same collection for every question, with scores.

    A collection with fewer than ``k`` notes gives all of them.
    """
    hits = nearest(
        questions,
        notes,
        group=group,
        query_key=question_key,
        item_key=note_key,
        query_vector=vector,
        item_vector=vector,
        k=k,
        metric=metric,
        block=block,
    )
    score = F.round(1 - F.col("distance"), DECIMALS)
    return hits.withColumn("score", F.when(score == 0, F.lit(0.0)).otherwise(score))


def asof_neighbors(
    notes: DataFrame,
    k: int = 5,
    *,
    metric: str = "l2sq",
    group: Sequence[str] = ("conv_id",),
    note_key: str = "seq",
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """For every note, the nearest of the notes that were added before it.

    Adds ``neighbor_idx``, the position in distance order from 0.  Only contents
    matter here and evolution never changes contents, so all notes are searched
    at once.
    """
    earlier = notes.withColumnRenamed(note_key, "neighbor_seq")
    return nearest(
        notes,
        earlier,
        group=group,
        query_key=note_key,
        item_key="neighbor_seq",
        query_vector=vector,
        item_vector=vector,
        k=k,
        metric=metric,
        earlier_only=True,
        block=block,
    ).withColumn("neighbor_idx", F.col("rank") - 1)
