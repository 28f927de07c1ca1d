"""Note analysis and evolution.

Text models are user-supplied functions that run inside Spark tasks
(``complete``).  The rules at the bottom are their offline defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import prompts, text
from recallgrid.operators.notes import update_notes
from recallgrid.operators.search import related_notes_text
from recallgrid.schemas import ANALYSIS, CORRUPT, DECISION

Completer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
NO_STRINGS = "array<string>"


def complete(df: DataFrame, completer: Completer, reply: str = "reply") -> DataFrame:
    """Run a text model over the rows.

    ``completer`` takes an iterator of pandas batches that have all columns of
    ``df`` and returns them with the column ``reply`` added; null stands for a
    failed call.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(reply, T.StringType())])
    return df.mapInPandas(completer, schema)


def empty_value(kind: T.DataType) -> Column:
    """The empty value of a reply field: what a failed call yields."""
    if isinstance(kind, T.ArrayType):
        plain = F.array()
    elif isinstance(kind, T.StringType):
        plain = F.lit("")
    elif isinstance(kind, T.BooleanType):
        plain = F.lit(False)
    elif isinstance(kind, T.NumericType):
        plain = F.lit(0)
    elif isinstance(kind, T.StructType):
        return empty_reply(kind)
    else:
        plain = F.lit(None)
    return plain.cast(kind)


def empty_reply(schema: T.StructType) -> Column:
    return F.struct(*[empty_value(f.dataType).alias(f.name) for f in schema.fields])


def _read_json(reply: Column, schema: T.StructType) -> Column:
    """The reply as a struct of ``schema``, null where it is not an object."""
    checked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(text.strip_code_fence(reply), checked, options)
    fields = [f.name for f in schema.fields]
    return text.let(
        parsed,
        lambda p: F.when(
            p.isNotNull() & p[CORRUPT].isNull(), F.struct(*[p[f].alias(f) for f in fields])
        ),
    )


def parse_decisions(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the struct ``decision`` and the flag ``readable``.

    A reply that cannot be decoded, or that asks for an action without giving
    that action's fields, leaves everything as it is: ``should_evolve`` false.
    """
    read = df.withColumn("_read", _read_json(F.col(reply), DECISION))
    d = F.col("_read")

    def asks(action: str) -> Column:
        return F.coalesce(F.array_contains(d["actions"], action), F.lit(False))

    complete_ = (
        d["actions"].isNotNull()
        & (
            ~asks("strengthen")
            | (d["suggested_connections"].isNotNull() & d["tags_to_update"].isNotNull())
        )
        & (
            ~asks("update_neighbor")
            | (
                d["new_context_neighborhood"].isNotNull()
                & d["new_tags_neighborhood"].isNotNull()
            )
        )
    )
    evolves = F.coalesce(d["should_evolve"], F.lit(False)) & complete_
    filled = F.struct(
        evolves.alias("should_evolve"),
        *[
            F.coalesce(d[f.name], empty_value(f.dataType)).alias(f.name)
            for f in DECISION.fields
            if f.name != "should_evolve"
        ],
    )
    return (
        read.withColumn("readable", d.isNotNull())
        .withColumn("decision", F.when(d.isNotNull(), filled).otherwise(empty_reply(DECISION)))
        .drop("_read")
    )


def undecodable(parsed: DataFrame) -> DataFrame:
    """Report of replies that could not be read."""
    return parsed.filter(~F.col("readable"))


def evolution_prompts(notes: DataFrame, neighbors: DataFrame, k: int = 5) -> DataFrame:
    """Notes that have earlier neighbours, with the prompt about them.

    ``neighbors`` has ``note_id``, the neighbour's ``id`` and its ``rank``.  The
    prompt quotes the neighbours as they were first added (batch mode).
    """
    blocks = related_notes_text(neighbors, notes, ["note_id"], k)
    return notes.join(blocks.withColumnRenamed("note_id", "id"), "id").withColumn(
        "prompt",
        prompts.evolution_prompt(
            F.col("content"), F.col("context"), F.col("keywords"), F.col("text"), F.col("n_lines")
        ),
    )


def apply_evolution(
    notes: DataFrame, decisions: DataFrame, neighbors: DataFrame
) -> DataFrame:
    """Notes after all decisions have been applied.

    ``decisions``: ``id``, ``seq`` (order in which they were taken) and the
    struct ``decision``.  ``neighbors``: ``note_id``, ``id``, ``neighbor_idx``
    (from 0, distance order).

    *strengthen* extends the note's own links and replaces its tags;
    *update_neighbor* replaces tags and context of the i-th neighbour **by id**,
    for as many neighbours as the reply has tag lists.  Where it has fewer
    contexts than tag lists the neighbour keeps its context.  Of several changes
    to a field the one decided last stands.
    """
    return update_notes(_with_links(notes, decisions), evolution_changes(decisions, neighbors))


def _times(decision: Column, action: str) -> Column:
    return F.size(F.filter(decision["actions"], lambda a: a == action))


def _with_links(notes: DataFrame, decisions: DataFrame) -> DataFrame:
    d = F.col("decision")
    added = decisions.filter(d["should_evolve"] & (_times(d, "strengthen") > 0)).select(
        "id",
        F.flatten(
            F.array_repeat(d["suggested_connections"], _times(d, "strengthen"))
        ).alias("added"),
    )
    return (
        notes.join(added, "id", "left")
        .withColumn(
            "links", F.concat("links", F.coalesce("added", F.array().cast(NO_STRINGS)))
        )
        .drop("added")
    )


def evolution_changes(decisions: DataFrame, neighbors: DataFrame) -> DataFrame:
    """New tags and context per note id, the last decision winning."""
    d = F.col("decision")
    acting = decisions.filter(d["should_evolve"])
    own = acting.filter(_times(d, "strengthen") > 0).select(
        "id",
        "seq",
        d["tags_to_update"].alias("tags"),
        F.lit(None).cast("string").alias("context"),
    )
    idx = F.col("neighbor_idx").cast("int")
    others = (
        acting.filter(_times(d, "update_neighbor") > 0)
        .select(F.col("id").alias("note_id"), "seq", "decision")
        .join(neighbors.select("note_id", "id", "neighbor_idx"), "note_id")
        .filter(F.col("neighbor_idx") < F.size(d["new_tags_neighborhood"]))
        .select(
            "id",
            "seq",
            F.get(d["new_tags_neighborhood"], idx).alias("tags"),
            F.get(d["new_context_neighborhood"], idx).alias("context"),
        )
    )
    return (
        own.unionByName(others)
        .groupBy("id")
        .agg(
            F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("tags"),
            F.max_by("context", F.when(F.col("context").isNotNull(), F.col("seq"))).alias(
                "context"
            ),
        )
    )


def parse_analysis(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Set keywords, context and tags from the reply, with an empty fallback."""
    read = df.withColumn("_read", _read_json(F.col(reply), ANALYSIS))
    none = F.array().cast(NO_STRINGS)
    return (
        read.withColumn("keywords", F.coalesce("_read.keywords", none))
        .withColumn("context", F.coalesce("_read.context", F.lit("General")))
        .withColumn("tags", F.coalesce("_read.tags", none))
        .drop("_read")
    )


def analyze(notes: DataFrame, completer: Completer | None = None, n: int = 5) -> DataFrame:
    """Extract keywords, context and tags with a text model.

    Without one, the ``n`` most frequent words of a note are its keywords, and
    context and tags are those of an empty reply.  Ids are unique.
    """
    if completer is None:
        terms = frequent_terms(notes, n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term_rank", "term"))).alias("_terms"))
        none = F.array().cast(NO_STRINGS)
        return (
            notes.join(terms, "id", "left")
            .withColumn("keywords", F.coalesce(F.transform("_terms", lambda t: t["term"]), none))
            .withColumns({"context": F.lit("General"), "tags": none})
            .select(*notes.columns, *[c for c in ("keywords", "context", "tags") if c not in notes.columns])
        )
    asked = notes.withColumn("prompt", prompts.analysis_prompt(F.col("content")))
    return parse_analysis(complete(asked, completer)).drop("prompt", "reply")


# ---- offline defaults ---------------------------------------------------------


def frequent_terms(notes: DataFrame, n: int = 5, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Keywords without a model: the ``n`` most frequent words of each note."""
    keys = list(keys)
    # Named explicitly, because adaptive execution would merge partitions by the
    # size of the texts, and these unfold to many times that.
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = notes.repartition(tasks, *keys).select(
        *keys, F.explode(text.word_tokens(F.lower("content"))).alias("term")
    )
    counted = words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n_seen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_seen"), "term")
    return (
        counted.withColumn("term_rank", F.row_number().over(order))
        .filter(F.col("term_rank") <= n)
    )


def distance_rule(neighbors: DataFrame, limit: float, links: int = 2) -> DataFrame:
    """Decisions without a model: strengthen towards near earlier notes.

    A note evolves when its nearest earlier note is within ``limit``.  It is
    then linked to its nearest ``links`` notes and tagged with their ranks.
    """
    near = neighbors.filter(F.col("rank") <= links)
    listed = near.groupBy("note_id", "seq").agg(
        F.min("distance").alias("closest"),
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("near"),
    )
    no_strings = F.array().cast(NO_STRINGS)
    decision = F.struct(
        (F.col("closest") <= limit).alias("should_evolve"),
        F.array(F.lit("strengthen")).alias("actions"),
        F.transform("near", lambda x: x["id"]).alias("suggested_connections"),
        F.transform("near", lambda x: F.concat(F.lit("t"), x["rank"].cast("string"))).alias(
            "tags_to_update"
        ),
        no_strings.alias("new_context_neighborhood"),
        F.array().cast("array<array<string>>").alias("new_tags_neighborhood"),
    )
    return listed.select(F.col("note_id").alias("id"), "seq", decision.alias("decision"))
