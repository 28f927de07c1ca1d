"""Which chunks hold which evidences: inside a record, and across a corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text
from recallgrid.functions.text import COVERAGE_THRESHOLD, let
from recallgrid.sources.stages import stage

# ---- fixed values: fields of a chunk object that may hold its text, best first
CHUNK_TEXT_FIELDS = ["chunk_content", "content", "text", "raw", "value"]
# ---- end of fixed values -------------------------------------------------------

NO_STRINGS = "array<string>"


def _string_in(value: Column) -> Column:
    """The text of a VARIANT that holds a string, null for any other."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def coerce_chunks(chunks: Column) -> Column:
    """Chunk texts from a VARIANT list of strings or objects.

    Chunks without a usable text are left out, so later ones move up in rank.
    """
    fields = [
        lambda c, name=name: _string_in(F.try_variant_get(c, f"$.{name}", "variant"))
        for name in CHUNK_TEXT_FIELDS
    ]
    items = F.coalesce(F.try_variant_get(chunks, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda c: F.coalesce(_string_in(c), *[get(c) for get in fields]))
    return F.filter(texts, lambda t: t.isNotNull())


def coerce_evidences(evidence: Column, evidences: Column) -> Column:
    """String evidences; the field ``evidence`` wins over ``evidences`` if present."""
    chosen = F.coalesce(evidence, evidences)
    items = F.coalesce(F.try_variant_get(chosen, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, _string_in), lambda t: t.isNotNull())


def coerce_records(raw: DataFrame) -> DataFrame:
    """Retrieval records as read from files, with plain string arrays."""
    return (
        raw.withColumn("evidences", coerce_evidences(F.col("evidence"), F.col("evidences")))
        .withColumn("chunks", coerce_chunks(F.col("chunks")))
        .withColumn("category", text.category_label(F.col("category")))
        .drop("evidence")
    )


def split_no_evidence(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with at least one evidence, and the report of those without."""
    none = F.coalesce(F.size("evidences"), F.lit(0)) <= 0
    return records.filter(~none), records.filter(none)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_compat_all(lists: pd.Series) -> pd.Series:
    def fold(items):
        if items is None:
            return None
        return [None if t is None else unicodedata.normalize("NFKC", t) for t in items]

    return lists.map(fold, na_action="ignore")


def _folded(texts: Column, nfkc: bool) -> Column:
    """Labels stripped, then compatibility folding where a text needs it."""
    bare = F.transform(texts, text.strip_speakers)
    if not nfkc:
        return bare
    exotic = F.exists(bare, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(_fold_compat_all(F.when(exotic, bare)), bare)


def _checked(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold lies above 0 and at most at 1, not at {threshold}")
    return threshold


def _placed(records: DataFrame) -> DataFrame:
    """Records dealt to the session's full number of tasks, by key where they have one.

    Named explicitly, because adaptive execution would merge partitions by the
    size of the texts, and the matching costs many times what reading them does.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in ("source", "idx", "row_id", "question_id") if c in records.columns]
    return records.repartition(n, *(keys or ["evidences", "chunks"]))


def match_in_record(records: DataFrame, threshold: float = COVERAGE_THRESHOLD, nfkc: bool = True) -> DataFrame:
    """Add ``hits``: per chunk, the numbers of the distinct evidences it holds.

    Needs ``chunks`` and ``evidences`` as string arrays in rank order.  All the
    work happens inside the row, where every text is normalised once; records are
    only dealt evenly to tasks before.  Also adds ``gold``, the number of evidences with repeats.
    """

    def numbered(evidences: Column) -> Column:
        distinct = F.array_distinct(
            F.transform(evidences, lambda e: text.normalize_text(e, nfkc=False))
        )
        return F.transform(
            distinct,
            lambda e, i: F.struct(
                i.alias("no"), e.alias("norm"), text.word_tokens(e).alias("tokens")
            ),
        )

    def held(chunk: Column, wanted: Column) -> Column:
        def scan(norm: Column) -> Column:
            return let(
                text.word_tokens(norm),
                lambda tokens: F.transform(
                    F.filter(
                        wanted,
                        lambda e: F.contains(norm, e["norm"])
                        | text.covers(tokens, e["tokens"], threshold),
                    ),
                    lambda e: e["no"],
                ),
            )

        return let(text.normalize_text(chunk, nfkc=False), scan)

    _checked(threshold)
    prepared = _placed(records).withColumn("_chunks", _folded(F.col("chunks"), nfkc)).withColumn(
        "_evidences", _folded(F.col("evidences"), nfkc)
    )
    hits = let(
        numbered(F.col("_evidences")),
        lambda wanted: F.transform(F.col("_chunks"), lambda c: held(c, wanted)),
    )
    return (
        prepared.withColumn("hits", hits)
        .withColumn("gold", F.size("evidences"))
        .drop("_chunks", "_evidences")
    )


# ---- matching by note, before records are nested -------------------------------------


def _hashed(tokens: Column) -> Column:
    """Tokens as 64-bit numbers: compared and moved at a fraction of their texts' cost."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def note_forms(notes: DataFrame, key: Sequence[str], nfkc: bool = True) -> DataFrame:
    """The dictionary of notes: key, ``norm`` and ``tokens`` (distinct, hashed), each note's text handled once."""
    formed = notes.select(*key, text.evidence_form(F.col("content"), nfkc).alias("norm"))
    return formed.withColumn("tokens", F.array_distinct(_hashed(text.word_tokens(F.col("norm")))))


def match_hits(
    hits: DataFrame,
    notes: DataFrame,
    asked: DataFrame,
    question: Sequence[str],
    note: Sequence[str],
    threshold: float = COVERAGE_THRESHOLD,
    nfkc: bool = True,
) -> DataFrame:
    """``asked`` with ``hits`` and ``gold`` as ``match_in_record`` gives them, from hits that carry keys only.

    ``hits``: question and note keys and ``rank``; ``notes``: note keys and
    ``content``; ``asked``: question keys and ``evidences``.  A note's normal form
    and tokens are made once, however many questions retrieve it.  Evidences
    travel to the notes, which are the longer texts; what comes back per hit is a
    few numbers.  Questions without a hit are left out.
    """
    _checked(threshold)
    no_text = asked.withColumn("gold", F.size("evidences"))
    forms = F.array_distinct(F.transform(_folded(F.col("evidences"), nfkc), lambda e: text.normalize_text(e, nfkc=False)))
    wanted = asked.select(
        *question,
        F.transform(
            forms,
            lambda e, i: F.struct(i.alias("no"), e.alias("norm"), _hashed(text.word_tokens(e)).alias("tokens")),
        ).alias("wanted"),
    )
    found = F.transform(
        F.filter(
            "wanted",
            lambda e: F.contains(F.col("norm"), e["norm"]) | text.covers(F.col("tokens"), e["tokens"], threshold),
        ),
        lambda e: e["no"],
    )
    keys = list(dict.fromkeys([*question, *note]))
    # Named explicitly, as adaptive execution would merge partitions by the size of these rows.
    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = (
        hits.select(*keys, "rank")
        .join(wanted, list(question))
        .repartition(n, *note)
        .join(note_forms(notes, note, nfkc), list(note))
        .select(*question, F.struct("rank", found.alias("held")).alias("hit"))
    )
    nested = held.groupBy(*question).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return no_text.join(nested, list(question)).withColumn("hits", F.transform("hits", lambda h: h["held"]))


# ---- corpus-wide matching -------------------------------------------------------

PIECES = f"([{text.WORD_CLASS}]+|[^{text.WORD_CLASS}]+)"
GRAM = 3
SURPLUS = 4
EMPTY_SALTS = 256


def _anchors(wanted: DataFrame, asked: DataFrame, pieces: DataFrame, threshold: float) -> DataFrame:
    """The rarest tokens of every evidence in the corpus, and how many of them a text must have.

    Coverage allows ``m = n - ceil(threshold * n)`` of ``n`` token occurrences to
    be absent, and a substring match at most two (the first and the last may be
    parts of longer words).  With ``spare = max(m, 2)``, any ``spare + s``
    occurrences have ``s`` present in every matching text.  Taking the rarest
    keeps common words out of the join, and ``s = SURPLUS`` instead of one keeps
    out texts that share a rare word by chance.
    """
    # A lone word found as such is found as a part of the text, too.
    lone = (F.col("n") == 1) & (F.col("norm") == F.get("tokens", F.lit(0)))
    tokens = wanted.filter(~lone).select("no", "n", F.posexplode("tokens").alias("pos", "piece"))
    counted = pieces.join(asked, "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("found"))
    seen = asked.join(counted, "piece", "left").select("piece", F.coalesce("found", F.lit(0)).alias("seen"))
    order = Window.partitionBy("no").orderBy("seen", F.desc(F.length("piece")), "pos")
    absent = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).cast("int")
    # One or two tokens: only coverage is decided here, substrings elsewhere.
    spare = F.when(F.col("n") >= 3, F.greatest(absent, F.lit(2))).otherwise(absent)
    need = F.least(F.lit(SURPLUS), F.col("n") - spare)
    return (
        tokens.join(seen, "piece")
        .withColumn("place", F.row_number().over(order))
        .withColumn("need", need)
        .filter(F.col("place") <= spare + F.col("need"))
        .groupBy("piece", "no", "n", "need", F.least("n", spare + F.col("need")).alias("anchors"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _grams(value: Column) -> Column:
    """All substrings of one to ``GRAM`` characters."""
    size = F.length(value)

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.when(
            size >= n, F.transform(starts, lambda i: F.substring(value, i, F.lit(n)))
        ).otherwise(F.array().cast(NO_STRINGS))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, GRAM + 1)]))


def _short_parts(wanted: DataFrame) -> DataFrame:
    """Of every evidence of at most two tokens, ``part``: its longest token, or the whole of it without any.

    Such an evidence may begin and end inside words, so its part must occur
    inside one word or one run of other characters, and at the beginning or end
    of that word where the evidence goes on.
    """
    longest = F.reduce(
        "tokens",
        F.lit(""),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )
    second = F.coalesce(F.array_position("tokens", F.col("part")) == 2, F.lit(False))
    return (
        wanted.filter(F.col("n") <= 2)
        .withColumn("part", F.when(F.col("n") == 0, F.col("norm")).otherwise(longest))
        .select(
            "no",
            "part",
            (second | ~F.startswith("norm", F.col("part"))).alias("begins"),
            (((F.col("n") == 2) & ~second) | ~F.endswith("norm", F.col("part"))).alias("ends"),
            (F.col("norm") == F.col("part")).alias("whole"),
        )
    )


def _holders(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """Pieces and the parts they hold, looked up by the last ``GRAM`` characters of a part."""
    keyed = parts.withColumn("gram", F.expr(f"right(part, {GRAM})"))
    piece, part = F.col("piece"), F.col("part")
    return (
        vocabulary.withColumn("gram", F.explode(_grams(piece)))
        .join(keyed, "gram")
        .filter(F.contains(piece, part))
        .filter((~F.col("begins") | F.startswith(piece, part)) & (~F.col("ends") | F.endswith(piece, part)))
        .select("piece", "part_no")
    )


def match_corpus(
    chunks: DataFrame,
    evidences: DataFrame,
    threshold: float = COVERAGE_THRESHOLD,
    nfkc: bool = True,
) -> DataFrame:
    """All (chunk, evidence) pairs that match, over whole tables.

    ``chunks``: ``doc_id``, ``text``; ``evidences``: ``item_id``, ``text``.
    Candidates come from equi-joins on rare tokens, never from a product of the
    two tables, and are then checked on the whole texts.
    Evidences with equal normal form are matched once.  The evidences' tokens are
    staged first, so that Spark knows how few they are, and only pieces of the
    chunks that some evidence has are ever written or shuffled; evidences of one
    or two words look through the vocabulary, for which all pieces are staged.
    Candidates are staged, too: where they are few, the texts they are checked on
    stay where they are.
    """
    _checked(threshold)
    body = text.evidence_form(F.col("text"), nfkc)
    items = evidences.select("item_id", text.evidence_form(F.col("text"), nfkc).alias("norm"))
    wanted = (
        items.filter(F.col("norm") != "")
        .select("norm")
        .distinct()
        .withColumn("tokens", text.word_tokens(F.col("norm")))
        .withColumn("n", F.size("tokens"))
        .withColumn("no", F.monotonically_increasing_id())
    )
    wanted = stage(wanted, "evidences", heavy=False)
    asked = stage(wanted.select(F.explode("tokens").alias("piece")).distinct(), "asked", heavy=False)
    # A lone blank holds no evidence, as those are trimmed and not empty.
    pieces = chunks.select(
        "doc_id",
        F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(PIECES), F.lit(1)))).alias("piece"),
    ).filter(F.col("piece") != " ")
    some_short = not wanted.filter(F.col("n") <= 2).isEmpty()
    pieces = stage(pieces if some_short else pieces.join(asked, "piece", "left_semi").select("doc_id", "piece"), "pieces")
    lookup = stage(_anchors(wanted, asked, pieces, threshold), "lookup", heavy=False)
    # Ids that several texts share: what is found by id may hold for one of them only.
    shared = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = stage(shared.select("doc_id", F.lit(True).alias("shared")), "shared", heavy=False)
    told = F.col("shared").isNull()
    enough = (F.col("found") + F.col("n") - F.col("anchors")) / F.col("n") >= threshold
    by_words = (
        pieces.join(lookup, "piece")
        .groupBy("doc_id", "no", "n", "anchors")
        .agg(F.sum("weight").alias("found"), F.min("need").alias("need"))
        .filter(F.col("found") >= F.col("need"))
        .join(shared, "doc_id", "left")
        .withColumn("covered", enough & (F.col("anchors") == F.col("n")) & told)
        .select(
            "doc_id",
            "no",
            F.lit(True).alias("by_words"),
            enough.alias("may_cover"),
            "covered",
            (F.col("covered") & (F.col("n") > 2)).alias("sure"),
        )
    )
    found = by_words
    if some_short:
        # Evidences share their parts, and a text may hold a part in many pieces: both count once.
        short, kind = _short_parts(wanted), ["part", "begins", "ends"]
        parts = short.groupBy(*kind).agg(F.min("no").alias("part_no"))
        holders = stage(_holders(pieces.select("piece").distinct(), parts), "holders", heavy=False)
        held = pieces.join(holders, "piece").select("doc_id", "part_no").distinct()
        inside = held.join(short.join(parts, kind).select("part_no", "no", "whole"), "part_no").join(shared, "doc_id", "left")
        no = F.lit(False)
        # A part that is the whole evidence needs no second look.
        by_part = inside.select(
            "doc_id", "no", no.alias("by_words"), no.alias("may_cover"), no.alias("covered"), (F.col("whole") & told).alias("sure")
        )
        found = found.unionByName(by_part)
    found = stage(found, "candidates", heavy=False)
    unsure = found.filter(~F.col("sure")).drop("sure")
    # Each text that is looked at is put in normal form and cut into words once, however many evidences it may hold.
    forms = (
        chunks.join(unsure.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", body.alias("whole"))
        .withColumn("have", F.array_distinct(text.word_tokens(F.col("whole"))))
    )
    contained = F.contains(F.col("whole"), F.col("norm"))
    covers = F.col("may_cover") & (F.col("covered") | text.covers(F.col("have"), F.col("tokens"), threshold))
    # Short evidences that are contained come by their parts, so by words only the others are left.
    matches = (
        F.when(~F.col("by_words"), contained).when(F.col("n") <= 2, ~contained & covers).otherwise(contained | covers)
    )
    checked = forms.join(unsure.join(wanted, "no"), "doc_id").filter(matches).select("doc_id", "norm")
    sure = found.filter(F.col("sure") & F.col("doc_id").isNotNull()).join(wanted, "no").select("doc_id", "norm")
    named = checked.unionByName(sure).join(items, "norm").select("doc_id", "item_id")
    # The empty evidence is part of every text, so all these pairs are the result.
    # Chunks are dealt by salt and only their ids are read.
    salts = F.sequence(F.lit(0), F.lit(EMPTY_SALTS - 1)).cast("array<bigint>")
    empty = items.filter(F.col("norm") == "").select("item_id", F.explode(salts).alias("salt"))
    everywhere = (
        chunks.filter(F.col("text").isNotNull())
        .select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(EMPTY_SALTS)).cast("long").alias("salt"))
        .join(empty, "salt")
        .select("doc_id", "item_id")
    )
    return named.unionByName(everywhere)
