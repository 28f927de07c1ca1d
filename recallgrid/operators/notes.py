"""The notes table: defaults, lookups, updates, deletion, consolidation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators.ordered import CHUNK, running_sum
from recallgrid.operators.turns import turn_tags

NO_STRINGS = "array<string>"


def notes_from_turns(turns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One note per turn; the collection is the conversation, the order the turn order.

    ``keep`` names further columns of the turns to carry along.
    """
    conv = F.col("conv_id").cast("string")
    return note_defaults(
        turns.select(
            "conv_id",
            F.col("turn_idx").alias("seq"),
            text.note_id(F.col("conv_id"), F.col("turn_idx"), F.col("content")).alias("id"),
            "content",
            F.nullif("timestamp", F.lit("")).alias("timestamp"),
            conv.alias("category"),
            turn_tags(F.col("conv_id"), F.col("session_id")).alias("tags"),
            *keep,
        )
    )


def note_defaults(notes: DataFrame) -> DataFrame:
    """Complete a notes table to all eleven fields; empty values count as missing.

    A missing id is derived from (conv_id, seq, content) where those exist and
    from the content alone otherwise, so a re-run gives the same ids.
    """
    have = set(notes.columns)

    def old(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    def string(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(old(name, "string"), F.lit("")), default).alias(name)

    def strings(name: str) -> Column:
        return F.coalesce(old(name, NO_STRINGS), F.array().cast(NO_STRINGS)).alias(name)

    now = F.date_format(F.current_timestamp(), text.TIMESTAMP_FORMAT)
    conv = F.col("conv_id") if "conv_id" in have else F.lit("")
    seq = F.col("seq") if "seq" in have else F.lit("")
    filled = [
        string("id", text.note_id(conv, seq, F.col("content"))),
        F.col("content"),
        strings("keywords"),
        strings("links"),
        string("context", F.lit("General")),
        string("category", F.lit("Uncategorized")),
        strings("tags"),
        string("timestamp", now),
        string("last_accessed", now),
        F.coalesce(old("retrieval_count", "int"), F.lit(0)).alias("retrieval_count"),
        strings("evolution_history"),
    ]
    named = {
        "id", "content", "keywords", "links", "context", "category", "tags",
        "timestamp", "last_accessed", "retrieval_count", "evolution_history",
    }
    return notes.select(*[c for c in notes.columns if c not in named], *filled)


def get_by_ids(notes: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Point lookup by a short list, or by a table of ids."""
    if isinstance(ids, DataFrame):
        return notes.join(ids.select("id").distinct(), "id", "left_semi")
    return notes.filter(F.col("id").isin(list(ids)))


def update_notes(
    notes: DataFrame, changes: DataFrame, encode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Set the non-null fields of ``changes`` (one row per id) on the notes.

    Columns the notes do not have are ignored.  With ``encode`` the embedding of
    a note is made anew where its content changed, and only there.
    """
    fields = [c for c in changes.columns if c != "id" and c in notes.columns]
    news = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = notes.join(news, "id", "left")
    out = []
    for name in notes.columns:
        if name == "embedding" and encode is not None and "content" in fields:
            changed = F.col("new_content").isNotNull() & (F.col("new_content") != F.col("content"))
            fresh = encode(F.when(changed, F.col("new_content")))
            out.append(F.when(changed, fresh).otherwise(F.col(name)).alias(name))
        elif name in fields:
            out.append(F.coalesce(f"new_{name}", name).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def unknown_ids(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids asked for that no note has."""
    return wanted.select("id").distinct().join(notes.select("id"), "id", "left_anti")


def delete_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id").distinct(), "id", "left_anti")


def deletion_report(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Whether each id asked for was there to delete."""
    present = notes.select("id", F.lit(True).alias("hit"))
    return (
        ids.select("id")
        .distinct()
        .join(present, "id", "left")
        .select("id", F.coalesce("hit", F.lit(False)).alias("found"))
    )


def latest_changes(log: DataFrame, version: str) -> DataFrame:
    """Per id and column, the last non-null value of a change log."""
    fields = [c for c in log.columns if c not in ("id", version)]
    return log.groupBy("id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c)
            for c in fields
        ]
    )


def consolidate(
    notes: DataFrame,
    log: DataFrame,
    version: str = "version",
    encode: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The collection rebuilt from its notes and all changes logged since."""
    return update_notes(notes, latest_changes(log, version), encode)


def consolidation_points(
    evolved: DataFrame,
    threshold: int,
    group: Sequence[str] = ("conv_id",),
    ordinal: str = "seq",
    chunk: int = CHUNK,
) -> DataFrame:
    """Every ``threshold``-th evolved note of a collection, in insertion order.

    ``evolved`` has one row per note with a boolean ``should_evolve``.
    """
    hit = F.when(F.coalesce("should_evolve", F.lit(False)), 1).otherwise(0)
    counted = running_sum(evolved, group, ordinal, hit, "evolved_count", chunk)
    return counted.filter(
        F.col("should_evolve") & (F.col("evolved_count") % threshold == 0)
    )


def usage_counts(notes: DataFrame, retrieved: DataFrame, when: str = "ts") -> DataFrame:
    """Fill ``retrieval_count`` and ``last_accessed`` from a retrieval log (id, ts)."""
    used = retrieved.groupBy("id").agg(
        F.count(F.lit(1)).cast("int").alias("used"), F.max(when).alias("last_used")
    )
    out = []
    for name in notes.columns:
        if name == "retrieval_count":
            out.append(F.coalesce("used", F.lit(0)).alias(name))
        elif name == "last_accessed":
            out.append(F.coalesce("last_used", name).alias(name))
        else:
            out.append(F.col(name))
    return notes.join(used, "id", "left").select(*out)
