"""Vector columns and encoders."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2sq", "cosine", "ip")
DECIMALS = 6  # distances are compared and reported at this precision


def letter_counts(text: Column) -> Column:
    """Counts of a to z, as a vector: a deterministic stand-in encoder."""

    def count_all(lowered: Column) -> Column:
        return F.array(
            *[
                (F.length(lowered) - F.length(F.replace(lowered, F.lit(c), F.lit("")))).cast("float")
                for c in string.ascii_lowercase
            ]
        )

    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.element_at(F.transform(F.array(lowered), count_all), 1)


def letter_encoder(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same vectors as ``letter_counts``, for ``embed``: one pass per text."""
    first, last = ord("a"), ord("z")

    def count(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
        return np.bincount(raw, minlength=last + 1)[first : last + 1].astype(np.float32)

    for texts in batches:
        yield texts.map(count)


def embed(
    df: DataFrame,
    encoder: Callable[[Iterator[pd.Series]], Iterator[pd.Series]],
    text: str = "content",
    out: str = "embedding",
) -> DataFrame:
    """Add ``out`` from ``text`` with a user's encoder.

    ``encoder`` maps an iterator of text batches to an iterator of vector
    batches, so it loads its model once per Python worker, not once per batch.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encoder(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text)))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two vector columns as an expression.

    The same numbers as the blocked search in ``operators.neighbors``; meant for
    checks and single pairs, since lambdas run element by element.
    """

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    if metric == "l2sq":
        gaps = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
        raw = F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v * v)
    elif metric == "ip":
        raw = 1 - dot(a, b)
    elif metric == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        raw = F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    rounded = F.round(raw, DECIMALS)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
