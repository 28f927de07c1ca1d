"""Exact token counts of whole texts under a byte-level BPE vocabulary.

Pre-tokens of a batch become ragged arrays; ``bpe.Merges`` applies every
sequence's lowest-rank pair at the same time, and the surviving symbols are
counted.  No shuffle, and memory is bounded by a batch and the chunk cache.

Null and empty texts have no bytes and no tokens; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.  A
special string inside a text is one token, as in the vocabulary's library.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.bpe import TextEncoder
from recallgrid.llm.worker import id_type, kept, map_batches, texts_of

GROUP = 256  # texts encoded at a time


def grouped(texts: list[str], encode, size: int = GROUP) -> list:
    return [value for i in range(0, len(texts), size) for value in encode(texts[i : i + size])]


def count_tokens(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``vocabulary`` is a path that every worker can read."""
    own = id_type(df, id_col)
    sized = texts_of(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = kept(("counts", vocabulary, pattern), lambda: TextEncoder(vocabulary, pattern, True))
        counts = grouped(batch["text"].to_pylist(), encoder.encode)
        return pa.record_batch(
            [batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    counted = map_batches(sized, work, f"doc_id {own}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
