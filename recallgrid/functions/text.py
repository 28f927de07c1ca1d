"""Text functions as Spark column expressions.

All of them stay in the JVM except Unicode compatibility folding, which Spark
SQL has no function for: ``nfkc`` sends only texts with a non-ASCII character
to Python (the others travel as nulls).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# Roles that never open a turn (exact spelling), the typographic characters folded to ASCII, the evidence coverage threshold, the
# time format of notes and the time prefix of a context line.
NON_STARTER_ROLES = ["assistant", "Assistant", "system", "System", "model", "Model"]
PLAIN_CHARS = {"\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " "}
COVERAGE_THRESHOLD = 0.85
TIMESTAMP_FORMAT = "yyyyMMddHHmm"
TIME_PREFIX_PATTERN = r"(?U)^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\s*"
# ---- end of fixed values ----------------------------------------------------

# Character classes are spelled out instead of using Java's Unicode mode, which
# looks up several properties per character: white space (with the four ASCII
# separators), and letters, numbers and the underscore, ASCII first.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_CLASS = r"a-zA-Z0-9_\p{L}\p{N}"
SPACE_CHARS = "".join(
    chr(c)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(first, last + 1)
)
WORDS = f"([{WORD_CLASS}]+)"
# ---- fixed value: a speaker label with its colon; the look-ahead turns most positions down at once
SPEAKER_PATTERN = f"(?=[aAuU])(?<![{WORD_CLASS}])(?iu:user|assistant)[{SPACE_CLASS}]*:[{SPACE_CLASS}]*"
# ---- end of fixed value -------------------------------------------------------


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    A lambda variable is computed once, whereas an attribute used inside a
    lambda may be inlined by the optimizer and evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def _fold_compat(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_compat(text: Column) -> Column:
    """Compatibility composition; ASCII-only text never leaves the JVM."""
    exotic = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold_compat(F.when(exotic, text)), text)


def strip_edges(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """Fold quotes, collapse white space, trim and lower-case."""
    base = fold_compat(text) if nfkc else text
    # One pass maps quotes and every kind of space, so only blanks can repeat.
    fancy = "".join(PLAIN_CHARS)
    others = [c for c in SPACE_CHARS if c != " " and c not in fancy]
    plain = F.translate(
        base, fancy + "".join(others), "".join(PLAIN_CHARS.values()) + " " * len(others)
    )
    return F.lower(F.trim(F.regexp_replace(plain, " {2,}", " ")))


def strip_speakers(text: Column) -> Column:
    """Drop ``user:`` and ``assistant:`` labels wherever they stand."""
    return F.regexp_replace(text, F.lit(SPEAKER_PATTERN), F.lit(""))


def evidence_form(text: Column, nfkc: bool = True) -> Column:
    """The form in which chunks and evidences are compared: labels go first."""
    return normalize_text(strip_speakers(text), nfkc)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))


def split_spaces(text: Column) -> Column:
    """Tokens between white space of any kind."""
    blanks = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.filter(F.split(blanks, " "), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return split_spaces(F.lower(text))


def covers(have: Column, want: Column, threshold: float = COVERAGE_THRESHOLD) -> Column:
    """At least ``threshold`` of the tokens in ``want`` occur in ``have``.

    Repeated tokens of ``want`` count every time.  Each *distinct* absent token
    is absent at least once, so a long list of those settles the answer before
    the exact count is made.
    """
    total = F.size(want)

    def decide(absent: Column) -> Column:
        best = (total - F.size(absent)) / total
        kept = F.size(F.filter(want, lambda t: ~F.array_contains(absent, t)))
        return F.when(best < threshold, F.lit(False)).otherwise(kept / total >= threshold)

    return F.when(total <= 0, F.lit(False)).otherwise(let(F.array_except(want, have), decide))


def contains_or_covers(
    chunk: Column, evidence: Column, threshold: float = COVERAGE_THRESHOLD
) -> Column:
    """Substring or token coverage, on texts already in evidence form."""
    return F.contains(chunk, evidence) | covers(
        word_tokens(chunk), word_tokens(evidence), threshold
    )


def token_f1(prediction: Column, reference: Column) -> Column:
    """Shared distinct tokens over the *list* lengths of both sides."""

    def score(s: Column) -> Column:
        common = F.size(F.array_intersect(s["p"], s["r"]))
        precision = common / F.size(s["p"])
        recall = common / F.size(s["r"])
        return F.when(common <= 0, F.lit(0.0)).otherwise(
            2 * precision * recall / (precision + recall)
        )

    pair = F.struct(
        space_tokens(F.coalesce(prediction, F.lit(""))).alias("p"),
        space_tokens(F.coalesce(reference, F.lit(""))).alias("r"),
    )
    return let(pair, score)


def build_context(chunks: Column, k: int) -> Column:
    """Top ``k`` chunk texts, one clean line per non-empty line."""
    joined = F.array_join(F.filter(F.slice(chunks, 1, k), lambda c: c.isNotNull()), "\n\n")
    lines = F.transform(
        F.split(joined, "\n"),
        lambda line: strip_edges(F.regexp_replace(line, TIME_PREFIX_PATTERN, "")),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def list_text(items: Column) -> Column:
    """An array of strings in bracket notation."""
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


# ---- fixed values: labels of a note line ------------------------------------
LINE_INDEX = "memory index:"
LINE_LABELS = {
    "timestamp": "talk start time:",
    "content": "memory content: ",
    "context": "memory context: ",
    "keywords": "memory keywords: ",
    "tags": "memory tags: ",
}
# ---- end of fixed values ----------------------------------------------------


def note_line(index: Column | None = None) -> Column:
    """Tab-separated description of a note, read from its own columns."""
    parts = []
    if index is not None:
        parts.append(F.concat(F.lit(LINE_INDEX), index.cast("string")))
    for name, label in LINE_LABELS.items():
        column = F.col(name)
        if name in ("keywords", "tags"):
            value = list_text(F.coalesce(column, F.array().cast("array<string>")))
        else:
            value = F.coalesce(column, F.lit(""))
        parts.append(F.concat(F.lit(label), value))
    return F.concat(F.concat_ws("\t", *parts), F.lit("\n"))


def turn_key(turn_idx: Column, timestamp: Column) -> Column:
    return F.concat(turn_idx.cast("string"), F.lit("_"), F.coalesce(timestamp, F.lit("")))


def note_id(conv: Column, seq: Column, content: Column) -> Column:
    """A content-derived id, so that indexing twice gives the same ids."""
    return F.sha2(
        F.concat_ws("\u001f", conv.cast("string"), seq.cast("string"), content), 256
    )


def cutoff_label(k: Column) -> Column:
    """``ALL`` for the missing cut-off, the number otherwise."""
    return F.coalesce(k.cast("string"), F.lit("ALL"))


def category_label(category: Column) -> Column:
    return F.coalesce(F.nullif(category.cast("string"), F.lit("")), F.lit("unknown"))


def parse_time(text: Column) -> Column:
    """A timestamp where the text holds one, null elsewhere."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)), F.try_to_timestamp(text)
    )


def clean_answer(reply: Column) -> Column:
    """Remove reasoning blocks and tags; an empty rest becomes ``N/A``."""
    opening, closing = "<think>", "</think>"
    trimmed = strip_edges(reply)
    kept = (
        F.when(~F.contains(trimmed, F.lit(opening)), trimmed)
        .when(F.contains(trimmed, F.lit(closing)), F.substring_index(trimmed, closing, -1))
        .otherwise(F.substring_index(trimmed, opening, 1))
    )
    bare = strip_edges(F.regexp_replace(kept, "<[^>]+>", ""))
    return F.when(bare == "", F.lit("N/A")).otherwise(bare)


def strip_code_fence(reply: Column) -> Column:
    """The text inside the first code fence, or the reply itself without one.

    Both the fence marked ``json`` and the bare fence give the inside, and a
    fence that is never closed runs to the end of the text.
    """
    marked = F.regexp_extract(reply, r"(?s)```json(.*?)(?:```|\z)", 1)
    bare = F.regexp_extract(reply, r"(?s)```(.*?)(?:```|\z)", 1)
    return strip_edges(
        F.when(F.contains(reply, F.lit("```json")), marked)
        .when(F.contains(reply, F.lit("```")), bare)
        .otherwise(reply)
    )
