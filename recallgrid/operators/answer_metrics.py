"""Answer quality: token F1, BLEU, ROUGE and greedy embedding match."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text
from recallgrid.functions.stemming import porter_stem
from recallgrid.operators.neighbors import BLOCK, best_partners

MAX_ORDER = 4  # BLEU n-gram orders
# ---- fixed value: what 13a sets apart everywhere, as the inside of a character class
PUNCTUATION = r"!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~"
# ---- end of fixed value -----------------------------------------------------------


# ---- tokens ---------------------------------------------------------------------


def bleu_tokens(value: Column, tokenize: str = "13a") -> Column:
    """Case-sensitive BLEU tokens: ``13a`` splits punctuation, ``ws`` spaces only."""
    if tokenize == "ws":
        spread = value
    elif tokenize == "13a":
        spread = value
        for name, char in (
            ("<skipped>", ""), ("-\n", ""), ("\n", " "),
            ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        ):
            spread = F.replace(spread, F.lit(name), F.lit(char))
        spread = F.concat(F.lit(" "), spread, F.lit(" "))
        for pattern, put in (
            (f"([{PUNCTUATION}])", " $1 "),
            (r"([^0-9])([.,])", "$1 $2 "),
            (r"([.,])([^0-9])", " $1 $2"),
            (r"([0-9])(-)", "$1 $2 "),
        ):
            spread = F.regexp_replace(spread, pattern, put)
    else:
        raise ValueError(f"unknown tokenizer {tokenize!r}")
    return text.split_spaces(spread)


def rouge_tokens(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda t: t != "")


_STEMS: dict[str, str] = {}  # what a worker has stemmed so far
STEMS_KEPT = 200_000


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_all(lists: pa.Array) -> pa.Array:
    """Stems by dictionary: each distinct token of a batch is looked at once, in a worker's memory of stems."""
    codes = lists.flatten().dictionary_encode()
    if len(_STEMS) > STEMS_KEPT:
        _STEMS.clear()
    made = []
    for token in codes.dictionary.to_pylist():
        if len(token) <= 3:
            made.append(token)
            continue
        if token not in _STEMS:
            _STEMS[token] = porter_stem(token)
        made.append(_STEMS[token])
    stems = pa.array(made, pa.string()).take(codes.indices)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    mask = pa.compute.is_null(lists) if lists.null_count else None
    return pa.ListArray.from_arrays(ends, stems, mask=mask)


def stem_tokens(tokens: Column) -> Column:
    """Porter stems of the tokens longer than three characters."""
    return _stem_all(tokens)


# ---- n-gram overlap ---------------------------------------------------------------


def _grams(tokens: Column, kind: str, max_n: int, is_prediction: bool) -> Column:
    def of_order(n: int) -> Column:
        size = F.size(tokens)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
            lambda i: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(n).alias("n"),
                F.array_join(F.slice(tokens, i, n), " ").alias("gram"),
                F.lit(int(is_prediction)).alias("p"),
                F.lit(int(not is_prediction)).alias("r"),
            ),
        )
        return F.when(size >= n, grams)

    none = F.array().cast("array<struct<kind:string,n:int,gram:string,p:int,r:int>>")
    return F.concat(*[F.coalesce(of_order(n), none) for n in range(1, max_n + 1)])


def _overlaps(
    rows: DataFrame, keys: Sequence[str], sides: Mapping[str, tuple[str, str, int]]
) -> DataFrame:
    """Counts of every n-gram on both sides, for rows already placed by key."""
    grams = F.concat(
        *[
            _grams(F.col(column), kind, max_n, column == pred)
            for kind, (pred, ref, max_n) in sides.items()
            for column in (pred, ref)
        ]
    )
    return (
        rows.select(*keys, F.explode_outer(grams).alias("g"))
        .groupBy(*keys, "g.kind", "g.n", "g.gram")
        .agg(F.sum("g.p").alias("p"), F.sum("g.r").alias("r"))
    )


def _place(rows: DataFrame, key: str) -> DataFrame:
    """Rows hashed by key into the session's full number of shuffle partitions.

    Named explicitly, because adaptive execution would merge partitions by the
    size of the texts, and these unfold to many times that.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key)


def ngram_overlap(
    rows: DataFrame, key: str, sides: Mapping[str, tuple[str, str, int]]
) -> DataFrame:
    """Clipped n-gram counts per row, one record per (row, kind, n).

    ``sides`` maps a kind to its prediction column, reference column (string
    arrays) and highest order.  Rows are placed by ``key`` once, before they are
    unfolded; both aggregations then run where the rows already are.
    """
    return (
        _overlaps(_place(rows, key), [key], sides)
        .filter(F.col("n").isNotNull())
        .groupBy(key, "kind", "n")
        .agg(
            F.sum(F.least("p", "r")).alias("overlap"),
            F.sum("p").alias("pred_total"),
            F.sum("r").alias("ref_total"),
        )
    )


def _shared_grams(preds: Sequence[Sequence[str]], refs: Sequence[Sequence[str]], n: int) -> int:
    """Clipped number of ``n``-grams that both sides have, over all their token lists."""
    have, want = (
        Counter(gram for tokens in side for gram in zip(*(tokens[i:] for i in range(n)))) for side in (preds, refs)
    )
    return sum(min(count, have[gram]) for gram, count in want.items() if gram in have)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _overlap_counts(preds: pd.Series, refs: pd.Series, max_n: pd.Series) -> pd.Series:
    sides = ([[list(t) for t in p], [list(t) for t in r], k] for p, r, k in zip(preds, refs, max_n))
    return pd.Series([[_shared_grams(p, r, n) for n in range(1, k + 1)] for p, r, k in sides])


def _wide(
    rows: DataFrame, keys: Sequence[str], sides: Mapping[str, tuple[str, str, int]]
) -> DataFrame:
    """The same with one row per key and columns like ``bleu2_overlap``.

    ``keys[0]`` identifies the row, which may have no n-gram at all; the other
    keys are carried along, so nothing has to be joined back.  Rows are placed by
    key before, and a row's n-grams are counted where its tokens are: one row per
    n-gram, each with all keys, would be a hundred times the texts.
    """
    columns = [c for pred, ref, _ in sides.values() for c in (pred, ref)]
    nested = rows.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in columns])
    counted = nested.select(
        "*", *[_overlap_counts(pred, ref, F.lit(max_n)).alias(f"_{kind}") for kind, (pred, ref, max_n) in sides.items()]
    )

    def total(column: str, n: int) -> Column:
        return F.aggregate(
            column, F.lit(0).cast("long"), lambda acc, tokens: acc + F.greatest(F.size(tokens) - n + 1, F.lit(0))
        )

    return counted.select(
        *keys,
        *[
            value.alias(f"{kind}{n}_{name}")
            for kind, (pred, ref, max_n) in sides.items()
            for n in range(1, max_n + 1)
            for name, value in (
                ("overlap", F.get(f"_{kind}", F.lit(n - 1))), ("pred_total", total(pred, n)), ("ref_total", total(ref, n))
            )
        ],
    )


def f_score(overlap: Column, pred: Column, ref: Column) -> Column:
    p, r = overlap / pred, overlap / ref
    return F.when(overlap > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def bleu_score(
    overlaps: Sequence[Column], totals: Sequence[Column], pred_len: Column, ref_len: Column
) -> Column:
    """BLEU on 0..1 from corpus sums, with halving floors for orders without a match."""
    zero_orders = F.lit(0)
    logs = F.lit(0.0)
    for overlap, total in zip(overlaps, totals):
        missed = (overlap <= 0).cast("int")
        zero_orders = zero_orders + missed
        floor = 1 / (F.pow(F.lit(2.0), zero_orders) * total)
        logs = logs + F.ln(F.when(overlap > 0, overlap / total).otherwise(floor))
    brevity = F.when(pred_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / pred_len))
    usable = (F.greatest(*overlaps) > 0) & (F.least(*totals) > 0)
    return F.when(usable, brevity * F.exp(logs / len(overlaps))).otherwise(F.lit(0.0))


# ---- longest common subsequence ---------------------------------------------------


def _lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Bit-parallel over whole token lists: one big-integer step per token of b."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        shared = row & places.get(token, 0)
        row = ((row + shared) | (row - shared)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


# ---- scores -------------------------------------------------------------------------


def corpus_bleu(
    answers: DataFrame, key: str = "row_id", tokenize: str = "13a"
) -> DataFrame:
    """One row: corpus BLEU of ``prediction`` against ``reference``."""
    rows = answers.select(
        key,
        bleu_tokens(F.col("prediction"), tokenize).alias("bp"),
        bleu_tokens(F.col("reference"), tokenize).alias("br"),
    )
    stats = ngram_overlap(rows, key, {"bleu": ("bp", "br", MAX_ORDER)})

    def of(n: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(name))), F.lit(0))

    orders = range(1, MAX_ORDER + 1)
    return stats.agg(
        bleu_score(
            [of(n, "overlap") for n in orders],
            [of(n, "pred_total") for n in orders],
            of(1, "pred_total"),
            of(1, "ref_total"),
        ).alias("bleu")
    )


def answer_scores(
    answers: DataFrame,
    key: str = "row_id",
    tokenize: str = "13a",
    stem: bool = True,
    with_bleu: bool = True,
) -> DataFrame:
    """Per answer: token F1, ROUGE-1/2/L and the BLEU counts.

    ``answers``: ``key``, ``prediction``, ``reference`` and any other columns,
    which are kept (texts aside).
    """
    kept = [c for c in answers.columns if c not in (key, "prediction", "reference")]
    pred, ref = (F.coalesce(c, F.lit("")) for c in ("prediction", "reference"))
    rp, rr = rouge_tokens(pred), rouge_tokens(ref)
    if stem:
        rp, rr = stem_tokens(rp), stem_tokens(rr)
    columns = [rp.alias("rp"), rr.alias("rr")]
    sides = {"rouge": ("rp", "rr", 2)}
    if with_bleu:
        columns += [
            bleu_tokens(pred, tokenize).alias("bp"),
            bleu_tokens(ref, tokenize).alias("br"),
        ]
        sides["bleu"] = ("bp", "br", MAX_ORDER)
    # Placed first, so that all text work runs in as many tasks.
    rows = _place(answers, key).select(
        key, *kept, text.token_f1(F.col("prediction"), F.col("reference")).alias("f1"), *columns
    )
    carried = [key, *kept, "f1", "lcs", "pred_len", "ref_len"]
    measured = (
        rows.withColumn("lcs", lcs_length("rp", "rr"))
        .withColumn("pred_len", F.size("rp"))
        .withColumn("ref_len", F.size("rr"))
    )
    wide = _wide(measured, carried, sides)
    return wide.select(
        key,
        *kept,
        "f1",
        *[
            f_score(
                F.col(f"rouge{n}_overlap"),
                F.col(f"rouge{n}_pred_total"),
                F.col(f"rouge{n}_ref_total"),
            ).alias(f"rouge{n}")
            for n in (1, 2)
        ],
        f_score(F.col("lcs"), F.col("pred_len"), F.col("ref_len")).alias("rougeL"),
        *[c for c in wide.columns if c.startswith("bleu")],
    )


def greedy_match(
    tokens: DataFrame, row: str = "row_id", block: int = BLOCK
) -> DataFrame:
    """Per row: greedy cosine match of candidate and reference token vectors.

    ``tokens``: ``row``, ``side`` (``p`` or ``r``), ``tok`` (position) and
    ``embedding``.  The best partner of a token is its nearest neighbour on the
    other side; one comparison serves both sides.
    """
    best = best_partners(tokens, row, block)

    def mean(side: str) -> Column:
        return F.avg(F.when(F.col("side") == side, 1 - F.col("distance")))

    p, r = F.col("precision"), F.col("recall")
    return (
        best.groupBy(row)
        .agg(mean("p").alias("precision"), mean("r").alias("recall"))
        .join(tokens.select(row).distinct(), row, "right")  # also rows with tokens on one side only
        .fillna(0.0, ["precision", "recall"])
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    )


def generation_metrics(
    answers: DataFrame,
    key: str = "row_id",
    tokenize: str = "13a",
    stem: bool = True,
    token_vectors: DataFrame | None = None,
) -> DataFrame:
    """All answer metrics, overall and per ``category``, in one aggregation.

    With ``token_vectors`` (see ``greedy_match``, keyed by ``key``) the mean
    embedding match is added as ``embedding_f1``.
    """
    scores = answer_scores(answers, key, tokenize, stem)
    means = ["f1", "rouge1", "rouge2", "rougeL"]
    extra = []
    if token_vectors is not None:
        match = greedy_match(token_vectors, key).select(key, F.col("f1").alias("embedding_f1"))
        scores = scores.join(match, key, "left").fillna(0.0, ["embedding_f1"])
        extra = ["embedding_f1"]
    sums = scores.groupingSets([[], [F.col("category")]], F.col("category")).agg(
        F.grouping("category").alias("_all"),
        F.count(F.lit(1)).alias("count"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in means + extra],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in scores.columns if c.startswith("bleu")],
    )
    orders = range(1, MAX_ORDER + 1)
    bleu = bleu_score(
        [F.col(f"bleu{n}_overlap") for n in orders],
        [F.col(f"bleu{n}_pred_total") for n in orders],
        F.col("bleu1_pred_total"),
        F.col("bleu1_ref_total"),
    )
    return sums.select(
        F.when(F.col("_all") == 1, "overall").otherwise("category").alias("section"),
        "category",
        "count",
        "f1",
        bleu.alias("bleu"),
        *means[1:],
        *extra,
    )
