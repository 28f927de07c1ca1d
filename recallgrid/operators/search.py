"""What happens to hits after the vector search: hydration, links, texts, unions.

``hits`` has the question's key columns, ``id``, ``rank`` (from 1) and a
``score`` or ``distance``.  ``notes`` has ``id`` and the note fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.text import note_line

LINE_FIELDS = ["timestamp", "content", "context", "keywords", "tags"]
HIT_FIELDS = ("id", "content", "context", "keywords")


def hydrate_hits(
    hits: DataFrame,
    notes: DataFrame,
    on: Sequence[str] = ("id",),
    fields: Sequence[str] = HIT_FIELDS,
) -> DataFrame:
    """Note fields for every hit; hits whose note is gone are dropped.

    Runs after the top-k cut, so texts are moved for the winners only.
    """
    wanted = [f for f in fields if f not in on]
    return hits.join(notes.select(*on, *wanted), list(on))


def project_chunks(hits: DataFrame) -> DataFrame:
    """Stored string metadata back to fields.

    The content falls back to the stored document, and keyword or tag texts
    that do not read as a JSON list become empty lists.
    """
    empty = F.array().cast("array<string>")
    out = hits
    if "document" in hits.columns:
        out = out.withColumn("content", F.coalesce("content", "document"))
    for name in ("keywords", "tags"):
        if dict(hits.dtypes)[name] == "string":
            parsed = F.from_json(F.col(name), "array<string>", {"mode": "PERMISSIVE"})
            out = out.withColumn(name, F.coalesce(parsed, empty))
    for name in ("context", "timestamp", "category"):
        out = out.withColumn(name, F.coalesce(name, F.lit("")))
    return out


def link_edges(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("src"), F.posexplode("links").alias("pos", "dst"))


def dangling_links(notes: DataFrame) -> DataFrame:
    """Links that lead to no note."""
    return link_edges(notes).join(
        notes.select(F.col("id").alias("dst")), "dst", "left_anti"
    )


def _linked(hits: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing link targets of every hit, in link order."""
    edges = hits.join(notes.select("id", "links"), "id").select(
        *keys, "rank", F.posexplode("links").alias("link_pos", "dst")
    )
    return edges.join(notes.select(F.col("id").alias("dst")), "dst", "left_semi")


def search_with_links(
    hits: DataFrame, notes: DataFrame, keys: Sequence[str], k: int
) -> DataFrame:
    """Direct hits first, then notes they link to, all cut at ``k``.

    Linked notes therefore appear only where there are fewer than ``k`` direct
    hits.  A linked note must exist and not have been listed before; it has no
    score and ``is_neighbor`` is true.
    """
    keys = list(keys)
    direct = hits.filter(F.col("rank") <= k)
    unseen = _linked(direct, notes, keys).join(
        direct.select(*keys, F.col("id").alias("dst")), [*keys, "dst"], "left_anti"
    )
    extra = unseen.groupBy(*keys, "dst").agg(F.min(F.struct("rank", "link_pos")).alias("place"))
    listed = direct.select(
        *keys,
        "id",
        F.lit(False).alias("is_neighbor"),
        F.col("score"),
        F.col("rank").alias("major"),
        F.lit(0).alias("minor"),
    ).unionByName(
        extra.select(
            *keys,
            F.col("dst").alias("id"),
            F.lit(True).alias("is_neighbor"),
            F.lit(None).cast("double").alias("score"),
            F.col("place.rank").alias("major"),
            F.col("place.link_pos").alias("minor"),
        )
    )
    order = Window.partitionBy(*keys).orderBy("is_neighbor", "major", "minor")
    return (
        listed.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*keys, "rank", "id", "score", "is_neighbor")
    )


def _joined_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Concatenate lines per question; a question has at most k * (k + 1)."""
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]
            ),
            "",
        ).alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def related_with_links(
    hits: DataFrame, notes: DataFrame, keys: Sequence[str], k: int
) -> DataFrame:
    """Every hit's line followed by those of up to ``k`` notes it links to.

    The cap is per hit and a note reached twice is written twice.
    """
    keys = list(keys)
    direct = hits.filter(F.col("rank") <= k)
    order = Window.partitionBy(*keys, "rank").orderBy("link_pos")
    followed = (
        _linked(direct, notes, keys)
        .withColumn("step", F.row_number().over(order))
        .filter(F.col("step") <= k)
        .select(*keys, "rank", "step", F.col("dst").alias("id"))
    )
    places = direct.select(*keys, "rank", F.lit(0).alias("step"), "id").unionByName(followed)
    lines = places.join(notes.select("id", *LINE_FIELDS), "id").select(
        *keys, "rank", "step", note_line().alias("line")
    )
    return _joined_lines(lines, keys, ["rank", "step"])


def related_notes_text(
    hits: DataFrame,
    notes: DataFrame,
    keys: Sequence[str],
    k: int = 5,
    questions: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest notes as one text block with their positions from 0.

    With ``questions`` those without any hit get an empty text.
    """
    keys = list(keys)
    index: Column = F.col("rank") - 1
    lines = (
        hits.filter(F.col("rank") <= k)
        .join(notes.select("id", *LINE_FIELDS), "id")
        .select(*keys, "rank", note_line(index).alias("line"))
    )
    blocks = _joined_lines(lines, keys, ["rank"])
    if questions is None:
        return blocks
    return questions.select(*keys).join(blocks, keys, "left").select(
        *keys,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
    )


def hybrid_union(
    first: DataFrame, second: DataFrame, keys: Sequence[str], k: int
) -> DataFrame:
    """Second ranked list appended to the first, without repeats, cut at ``k``."""
    keys = list(keys)
    both = first.select(*keys, "id", "rank", "score", F.lit(0).alias("source")).unionByName(
        second.select(*keys, "id", "rank", "score", F.lit(1).alias("source"))
    )
    once = both.groupBy(*keys, "id").agg(F.min(F.struct("source", "rank", "score")).alias("best"))
    order = Window.partitionBy(*keys).orderBy("best.source", "best.rank")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*keys, "rank", "id", "best.score", "best.source")
    )
