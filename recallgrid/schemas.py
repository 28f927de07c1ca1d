"""Explicit schemas of the files and tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

SESSION = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
    ]
)

QUESTION = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        # A primitive read as STRING keeps its text: 42 becomes "42".
        T.StructField("answer", T.StringType()),
        T.StructField("evidences", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)

CORRUPT = "_corrupt"

DATASET = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("dialogs", T.ArrayType(SESSION)),
        T.StructField("qas", T.ArrayType(QUESTION)),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

NOTE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("context", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("timestamp", T.StringType()),
        T.StructField("last_accessed", T.StringType()),
        T.StructField("retrieval_count", T.IntegerType()),
        T.StructField("evolution_history", T.ArrayType(T.StringType())),
    ]
)

# Chunks and evidences keep whatever shape the file has; the coercion functions
# in operators.matching turn them into arrays of strings.
RETRIEVAL_RECORD = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("chunks", T.VariantType()),
        T.StructField("evidence", T.VariantType()),
        T.StructField("evidences", T.VariantType()),
        T.StructField("category", T.StringType()),
        T.StructField("conv_id", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

DECISION = T.StructType(
    [
        T.StructField("should_evolve", T.BooleanType()),
        T.StructField("actions", T.ArrayType(T.StringType())),
        T.StructField("suggested_connections", T.ArrayType(T.StringType())),
        T.StructField("tags_to_update", T.ArrayType(T.StringType())),
        T.StructField("new_context_neighborhood", T.ArrayType(T.StringType())),
        T.StructField("new_tags_neighborhood", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("context", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
