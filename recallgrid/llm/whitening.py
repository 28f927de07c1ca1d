"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers, so that counts, sums and products are exact
whatever the order in which tasks add them up: two runs, or a run that lost an
executor, fit the same components.  Spark drops repeated vectors, adds up sums,
then products of entries centred at the rounded mean (the remainder is taken off
exactly afterwards).  Width-squared numbers reach the driver, which splits the
covariance by ``spectral.leading``; width times 16 numbers travel back to tasks.

Vectors that are null or hold a null, NaN or infinite entry are dropped.  Vectors
of another length are fitted and whitened among themselves.  Components without
variance have a null ``whitened`` entry; an empty vector has none.  Repeated rows
get a row each and count once in the fit; a deviation beyond 64 bits is null;
entries must stay below 2^53 / 64.  Other columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.spectral import EPS, leading
from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16


@dataclass(frozen=True)
class Whitening:
    """What is fitted for vectors of one length."""

    n: int
    centre: np.ndarray  # rounded mean
    rest: np.ndarray  # sums of what is left beside it, as whole numbers
    axes: np.ndarray  # components as columns
    values: np.ndarray  # their eigenvalues
    explained: np.ndarray

    def kept(self) -> np.ndarray:
        """Components that have variance beyond rounding."""
        return self.values > len(self.centre) * EPS * max(self.values.max(initial=0), 0)

    def project(self, x: np.ndarray) -> np.ndarray:
        moved = (x - self.centre) - self.rest.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.kept(), moved @ self.axes / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = x - self.centre
        most = max(int(np.abs(off).max(initial=0)) * self.n, max(map(abs, self.rest.tolist()), default=0))
        if (2 * most) ** 2 * len(self.centre) < 2**63:
            return ((self.n * off - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - self.rest) ** 2).sum(axis=1)
        return [d if d < 2**63 else None for d in exact]


def whole(vector: Column) -> Column:
    """Each entry as a whole number."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(the id, x) of rows whose vector is there and finite throughout."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(vector.isNotNull() & finite).select(F.col(id_col), whole(vector).alias("x"))


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the batch and their vectors as a matrix, for every length but 0."""
    widths = batch["x"].value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        chosen = batch["x"].take(pa.array(rows)) if len(rows) < len(widths) else batch["x"]
        yield rows, chosen.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums_of(fit: DataFrame) -> DataFrame:
    """width, i, n and total: exact sums of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in by_width(batch):
                held = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                held[0] += len(rows)
                held[1] = held[1] + (x - OFFSET).sum(axis=0)
        table = [(w, i, n, Decimal(int(t) + n * OFFSET)) for w, (n, total) in found.items() for i, t in enumerate(total)]
        yield _rows(table, [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)], ["width", "i", "n", "total"])

    parts = fit.mapInArrow(run, "width int, i int, n long, total decimal(38,0)")
    return parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _rows(table: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*table, strict=True) if table else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def exact_products(off: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers, without rounding, as Python's numbers."""
    most = int(np.abs(off).max(initial=0))
    if not most:
        return np.zeros((off.shape[1],) * 2, object)
    if most >= 1 << 26:
        wide = off.astype(object)
        return wide.T @ wide
    step = max(1, (1 << 53) // most**2)  # so many rows stay exact in floating point
    total = np.zeros((off.shape[1],) * 2, object)
    for at in range(0, len(off), step):
        part = off[at : at + step].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


def products_of(fit: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """width, i, j and total: sums of products of centred entries, for i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_width(batch):
                made = exact_products(x - centres[x.shape[1]])
                found[x.shape[1]] = found[x.shape[1]] + made if x.shape[1] in found else made
        for width, total in found.items():
            for i in range(width):
                row = [(width, i, j, Decimal(int(total[i, j]))) for j in range(i, width)]
                yield _rows(row, [pa.int32()] * 3 + [pa.decimal128(38, 0)], ["width", "i", "j", "total"])

    parts = fit.mapInArrow(run, "width int, i int, j int, total decimal(38,0)")
    return parts.groupBy("width", "i", "j").agg(F.sum("total").alias("total"))


def fit_components(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The model of every vector length in ``fit`` (distinct rows ``x``)."""
    n: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in sums_of(fit).collect():  # one row a dimension
        n[r["width"]] = r["n"]
        sums.setdefault(r["width"], {})[r["i"]] = int(r["total"])
    totals = {w: [s[i] for i in range(w)] for w, s in sums.items()}
    centres = {w: np.array([round(t / n[w]) for t in totals[w]], np.int64) for w in totals}
    products = {w: np.zeros((w, w), object) for w in totals}
    for r in products_of(fit, centres).collect():  # at most width squared rows
        products[r["width"]][r["i"], r["j"]] = products[r["width"]][r["j"], r["i"]] = int(r["total"])
    made = {}
    for w, total in totals.items():
        rest = np.array([t - n[w] * int(c) for t, c in zip(total, centres[w], strict=True)], object)
        square = n[w] ** 2
        covariance = np.array([[v / square for v in row] for row in n[w] * products[w] - np.outer(rest, rest)], float)
        values, axes = leading(covariance, components)
        trace = np.trace(covariance)
        made[w] = Whitening(n[w], centres[w], rest, axes, values, values / trace if trace else np.zeros(len(values)))
    return made


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """How far the whitened covariance of the fit list is from the identity, measured by a pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_width(batch):
                model = models[x.shape[1]]
                y = model.project(x)[:, model.kept()]
                y = np.concatenate([y, np.ones((len(y), 1))], axis=1)  # the last row holds the sums
                found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        table = [(w, i, j, float(total[i, j])) for w, total in found.items() for i, j in np.ndindex(total.shape)]
        yield _rows(table, [pa.int32()] * 3 + [pa.float64()], ["width", "i", "j", "total"])

    parts = fit.mapInArrow(run, "width int, i int, j int, total double")
    errors: dict[int, float | None] = {}
    moments = {w: np.zeros((int(m.kept().sum()) + 1,) * 2) for w, m in models.items()}
    for r in parts.groupBy("width", "i", "j").agg(F.sum("total").alias("total")).collect():
        moments[r["width"]][r["i"], r["j"]] = r["total"]
    for w, total in moments.items():
        mean = total[-1, :-1] / models[w].n
        covariance = total[:-1, :-1] / models[w].n - np.outer(mean, mean)
        errors[w] = float(np.abs(covariance - np.eye(len(mean))).max()) if len(mean) else None
    return errors


def whiten(
    df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The id, n, deviation, whitened (one entry a component), explained (likewise) and identity_error."""
    rows = usable(df, id_col, vector_col)
    fit = stage(rows.select("x").distinct(), "fit")
    models = fit_components(fit, components)
    errors = identity_errors(fit, models)
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_width(batch):
                model, width = models[x.shape[1]], x.shape[1]
                y = model.project(x)
                ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
                shares = pa.array(np.tile(model.explained, len(y)))
                yield pa.record_batch(
                    [
                        batch[id_col].take(pa.array(at)),
                        pa.array([model.n] * len(y), pa.int64()),
                        pa.array(model.deviations(x), pa.int64()),
                        pa.ListArray.from_arrays(ends, flat).cast(lists),
                        pa.ListArray.from_arrays(ends, shares).cast(lists),
                        pa.array([errors[width]] * len(y), pa.float64()),
                    ],
                    [id_col, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"`{id_col}` {id_type(df, id_col)}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return rows.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for every vector and component, numbered from 1."""
    others = [c for c in whitened.columns if c not in ("whitened", "explained")]
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both")
    return whitened.select(*others, pairs).select(
        *others, (F.col("at") + 1).alias("component"), F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained")
    )
