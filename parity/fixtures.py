"""Operator inputs derived from the driver's tables, by Spark and in full."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.functions.vectors import embed, letter_encoder
from recallgrid.operators import evolution, neighbors
from recallgrid.operators import notes as notes_ops
from recallgrid.operators.turns import pair_turns, turn_tags
from recallgrid.session import spread
from recallgrid.sources.stages import stage

COLL = ("coll",)

# Built once per session: plans, and the tables that are staged on disk.
plan = lru_cache(maxsize=256)


@plan
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@plan
def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, on all cores."""
    return spread(table(spark, sf_dir, name))


@plan
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a single session."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.lit(0).cast("long").alias("session_pos"),
        F.lit("s0").alias("session_id"),
        F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("timestamp"),
        F.col("turn").alias("msg_pos"),
        "role",
        F.col("text").alias("content"),
    )


@plan
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_turns(messages(spark, sf_dir))


@plan
def collected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in collections of ten: each conversation is a session of its collection."""
    grouped = messages(spark, sf_dir).withColumn("session_pos", F.col("conv_id"))
    paired = pair_turns(grouped.withColumn("conv_id", F.expr("conv_id div 10")))
    named = paired.withColumnsRenamed(
        {"conv_id": "coll", "session_pos": "conv_id", "turn_idx": "seq"}
    )
    return stage(named, "turns")


@plan
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with ids, fields and letter-count vectors."""
    base = collected_turns(spark, sf_dir).select(
        "coll",
        "conv_id",
        "seq",
        text.note_id(F.col("coll"), F.col("seq"), F.col("content")).alias("id"),
        "content",
        "timestamp",
        F.lit("d").alias("last_accessed"),
        F.col("conv_id").cast("string").alias("category"),
        turn_tags(F.col("conv_id"), F.col("session_id")).alias("tags"),
    )
    return stage(embed(notes_ops.note_defaults(base), letter_encoder), "notes")


@plan
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per answered turn: the user's text, the reply as evidence and answer."""
    answered = collected_turns(spark, sf_dir).filter(F.col("reply_text") != "")
    asked = answered.select(
        "coll",
        "conv_id",
        F.col("seq").alias("q_idx"),
        F.concat(F.col("coll").cast("string"), F.lit("_q"), F.col("seq").cast("string")).alias(
            "question_id"
        ),
        F.col("user_text").alias("question"),
        F.col("reply_text").alias("answer"),
        F.array("reply_text").alias("evidences"),
        F.pmod("conv_id", F.lit(5)).cast("string").alias("category"),
    )
    return embed(asked, letter_encoder, "question")


@plan
def search(
    spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine", group: tuple = COLL
) -> DataFrame:
    """Nearest notes of every question, by position."""
    return neighbors.retrieve_topk(
        questions(spark, sf_dir), notes(spark, sf_dir), k, metric=metric, group=group
    )


@plan
def hits(
    spark: SparkSession,
    sf_dir: str,
    k: int = 10,
    metric: str = "cosine",
    fields: tuple = ("id",),
) -> DataFrame:
    """Top-k notes of the question's collection, with note fields."""
    stored = notes(spark, sf_dir).select("coll", "seq", *fields)
    return search(spark, sf_dir, k, metric).join(stored, ["coll", "seq"])


@plan
def conversation_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top-k notes of the question's own conversation, which has few of them."""
    stored = notes(spark, sf_dir).select("conv_id", "seq", "id")
    return search(spark, sf_dir, k, group=("conv_id",)).join(stored, ["conv_id", "seq"])


@plan
def records(
    spark: SparkSession, sf_dir: str, k: int = 10, metric: str = "cosine"
) -> DataFrame:
    """Nested retrieval records: a question with its ranked chunk texts."""
    found = hits(spark, sf_dir, k, metric, ("content",))
    ranked = found.groupBy("coll", "q_idx").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda c: c["content"]
        ).alias("chunks")
    )
    asked = questions(spark, sf_dir).drop("embedding")
    return asked.join(ranked, ["coll", "q_idx"]).withColumn(
        "idx", F.col("coll") * 1_000_000 + F.col("q_idx")
    )


@plan
def neighbor_table(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """As-of neighbours by note id."""
    stored = notes(spark, sf_dir)
    near = neighbors.asof_neighbors(stored, k, metric="cosine", group=COLL)
    ids = stored.select("coll", "seq", F.col("id").alias("note_id"))
    other = stored.select("coll", F.col("seq").alias("neighbor_seq"), "id")
    return stage(near.join(ids, ["coll", "seq"]).join(other, ["coll", "neighbor_seq"]), "neighbors")


@plan
def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes linked to their two nearest earlier notes; first notes link nowhere valid."""
    stored = notes(spark, sf_dir)
    near = neighbor_table(spark, sf_dir).filter(F.col("rank") <= 2)
    links = near.groupBy("note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias(
            "near"
        )
    )
    lost = F.array(F.concat(F.lit("lost-"), F.col("coll").cast("string")))
    joined = stored.join(links.withColumnRenamed("note_id", "id"), "id", "left")
    return joined.withColumn("links", F.coalesce("near", lost)).drop("near")


@plan
def decisions(spark: SparkSession, sf_dir: str, limit: float = 0.02) -> DataFrame:
    """The distance rule, asking also for an update of the nearest two notes."""
    ruled = evolution.distance_rule(neighbor_table(spark, sf_dir), limit)
    seq = F.col("seq").cast("string")
    return ruled.withColumn(
        "decision",
        F.col("decision")
        .withField("actions", F.array(F.lit("strengthen"), F.lit("update_neighbor")))
        .withField(
            "new_tags_neighborhood",
            F.array(
                F.array(F.concat(F.lit("a"), seq)),
                F.array(F.concat(F.lit("b"), seq), F.lit("near")),
            ),
        )
        .withField("new_context_neighborhood", F.array(F.concat(F.lit("seen by "), seq))),
    )


@plan
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (the best chunk's whole text) against whole replies."""
    from recallgrid.operators.answers import generate_answers

    made = generate_answers(records(spark, sf_dir, 1), None, context_k=1)
    return made.select(
        F.col("idx").alias("row_id"),
        "category",
        F.col("generated_answer").alias("prediction"),
        F.col("answer").alias("reference"),
    )


@plan
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ten "tokens" per row, alternately on the candidate and reference side."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("row_id"),
        F.when(F.col("vec_id") % 2 == 0, "p").otherwise("r").alias("side"),
        F.col("vec_id").alias("tok"),
        "embedding",
    )
