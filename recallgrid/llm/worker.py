"""What Python workers keep between tasks, and small helpers around Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(key: tuple, make: Callable[[], object]) -> object:
    """One object per worker process and key: vocabularies load once, not once a task."""
    holder = sys.modules.setdefault("_worker_kept", types.ModuleType("_worker_kept"))
    if key not in vars(holder):
        vars(holder)[key] = make()
    return vars(holder)[key]


def dropped(kind: str) -> None:
    """Gives back the memory of this worker's objects whose keys begin with ``kind``."""
    held = vars(sys.modules.get("_worker_kept", types.ModuleType("_worker_kept")))
    gone = [key for key in held if isinstance(key, tuple) and key[0] == kind]
    for key in gone:
        del held[key]
    if gone:
        gc.collect()
        trim()


def trim() -> None:
    """Gives memory that allocators hold but don't use back to the system."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        release(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over every Arrow batch; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text being empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str = "doc_id") -> str:
    return df.schema[id_col].dataType.simpleString()
