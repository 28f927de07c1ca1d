"""Quality rules as a short-circuit cascade of column expressions.

Each rule is a boolean column that is true where a text fails.  ``ordered``
times every rule and counts its rejections on a bounded sample and puts first
what rejects most per second; ``cascade`` evaluates them in one CASE, so a text
that an early rule rejects never pays for a later one.  The order has no effect
on which texts are kept.

A null or empty text has no words and fails ``few_words``; ties of rank go by
rule name; repeated rows are judged each; an empty table gives an empty result
(its rules go by name); a column of the input with the name of a result
is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage

BLANK = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS = 1_000
REPEATS = 3
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long"))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more.

    Windows are compared inside one text by 64-bit hashes of their words' hashes.
    """
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(reach, zero, lambda total, x: total + x)

    def repeated(marks: Column) -> Column:
        placed = F.array_sort(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(order: Column) -> Column:
            def twin(e, j):
                before = F.get(order, F.when(j > 0, j - 1))["h"]
                return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(F.get(order, j + 1)["h"] == e["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(order, twin), lambda e: e["i"]))

        return let(let(placed, places), covered)

    def of_marks(marks: Column) -> Column:
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), zero).otherwise(repeated(marks))

    def of_hashes(own: Column) -> Column:
        # The last places of the text begin no window.
        starts = F.slice(own, 1, F.size(own) - (width - 1))
        marks = F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(own, i + k) for k in range(1, width)]))
        return let(marks, of_marks)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, zero).otherwise(let(hashes, of_hashes))


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    A text is cut into words once and into lines once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = let(
        words_of(text),
        lambda own: F.struct(
            F.size(own).cast("long").alias("n"), F.length(F.array_join(own, "")).cast("long").alias("c"), repeat_words(own).alias("r")
        ),
    )
    lines = let(
        worded_lines(text),
        lambda own: F.struct(F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("d")),
    )
    return (
        df.withColumns({"_counted": counted, "_lines": lines, "n_symbols": symbols(text)})
        .withColumns(
            {
                "n_words": F.col("_counted.n"),
                "word_chars": F.col("_counted.c"),
                "n_repeat_words": F.col("_counted.r"),
                "n_lines": F.col("_lines.n"),
                "n_dup_lines": F.col("_lines.d"),
            }
        )
        .drop("_counted", "_lines")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def base_rules(text: Column) -> dict[str, Column]:
    """The two rules of ``base_failed``, on the text itself."""
    return {
        "few_words": F.size(words_of(text)) < 10,
        "repeated_windows": let(words_of(text), lambda own: 100 * repeat_words(own) > 20 * F.size(own)),
    }


def method_rules(text: Column) -> dict[str, Column]:
    """Mild limits that prose in any language keeps."""
    n_words = F.size(words_of(text))
    return {
        "word_length": let(F.struct(n_words.alias("n"), word_chars(text).alias("c")), lambda s: (s["c"] < 2 * s["n"]) | (s["c"] > 25 * s["n"])),
        "symbols": symbols(text) > n_words,
        "dup_lines": let(worded_lines(text), lambda own: 10 * F.size(F.array_distinct(own)) < 3 * F.size(own)),
        "no_letters": ~text.rlike(r"\p{L}"),
    }


def counted_rules(text: Column) -> dict[str, Column]:
    """All rules on the columns of ``base_statistics``; only letters are looked up in the text."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "word_length": (chars < 2 * n) | (chars > 25 * n),
        "symbols": F.col("n_symbols") > n,
        "dup_lines": 10 * (lines - F.col("n_dup_lines")) < 3 * lines,
        "no_letters": ~text.rlike(r"\p{L}"),
    }


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, drawn evenly from all files; all rows of a smaller table."""
    total = df.count()
    return df if total <= rows else df.sample(rows / total, seed=7)


def ordered(df: DataFrame, rules: dict[str, Column]) -> dict[str, Column]:
    """The rules by rejections per second, measured on a sample; ties by name.

    A rule's cost is the least of several runs over the sample, beyond that of a
    run without a rule.
    """
    sample = stage(sampled(df), "rule-sample")

    def measured(rule: Column) -> tuple[int, float]:
        times = []
        for _ in range(REPEATS):
            started = time.perf_counter()
            rejected = sample.agg(F.count_if(rule), F.count("*")).first()[0]
            times.append(time.perf_counter() - started)
        return rejected, min(times)

    _, empty = measured(F.lit(False))
    rank = {}
    for name, rule in rules.items():
        rejected, seconds = measured(rule)
        rank[name] = -rejected / max(seconds - empty, 1e-3)
    return dict(sorted(rules.items(), key=lambda item: (rank[item[0]], item[0])))


def cascade(rules: dict[str, Column]) -> Column:
    """Whether a row passes: the first rule that it meets ends the chain."""
    chain = F.when(F.lit(False), F.lit(False))
    for rule in rules.values():
        chain = chain.when(rule, F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every text, base_failed, and kept after base and method rules.

    The statistics are asked for anyway, so the cascade runs over them; the order
    is that of the rules' costs on texts.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    counted = counted_rules(text)
    rules = {name: counted[name] for name in ordered(own, base_rules(text) | method_rules(text))}
    return base_statistics(own).withColumn("kept", cascade(rules)).drop("text", "n_lines")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, with their columns; a rule reads only texts that all before it keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.filter(cascade(ordered(df.select(text_col), base_rules(text) | method_rules(text))))
