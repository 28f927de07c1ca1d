"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

An address becomes a set of tokens (parts of the host, segments and words of
the path).  Spark's FP-growth mines token sets of labelled addresses; a rule
"tokens => block" is kept by its support and confidence, and only if no smaller
rule of at least its confidence is part of it.  Rules match through an inverted index: they
are posted under each of their tokens, addresses look their tokens up, and a
rule fires where it was found as often as it has tokens.

A null address, or one without ``://``, has an empty host and path, no tokens
and the verdict allow; repeated rows are judged each; with no labels nothing is
mined; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage

BLOCK = "label=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_COUNT = 20  # labelled addresses that a rule must hold on at least
MAX_TOKENS = 3

# fixed values: host, path, verdict
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return fold(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in reversed(longest_first):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, words of host labels, and words of the path that aren't numbers."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(host, r"[^a-z0-9]+"), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.split(fold(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("path:"), x))
    every = F.array_distinct(F.concat(labels, words, parts))
    return F.filter(every, lambda x: ~x.rlike(r"^[a-z]+:\d*$"))


def mine(
    labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int, min_count: int = MIN_COUNT
) -> DataFrame:
    """(rule_id, tokens, confidence) of pruned rules; ``labelled`` has tokens and a boolean bad."""
    baskets = labelled.select(
        F.when(F.col("bad"), F.array_union("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")
    ).filter(F.size("items") > 0)
    baskets = stage(baskets, "baskets")
    support = min(1.0, max(min_support, min_count / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    sets = stage(model.freqItemsets.filter(F.size("items") <= max_tokens + 1), "itemsets")
    whole = sets.filter(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("tokens"), "freq")
    blocked = sets.filter(F.array_contains("items", BLOCK)).select(
        F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), F.col("freq").alias("both")
    ).filter((F.size("tokens") > 0) & (F.col("both") >= min_count))
    rules = blocked.join(whole, "tokens").withColumn("confidence", F.col("both") / F.col("freq"))
    rules = stage(rules.filter(F.col("confidence") >= min_confidence).select("tokens", "confidence"), "rules")
    # a smaller rule inside a larger one, at least as sure, makes the larger one idle
    short = rules.select(F.col("tokens").alias("small"), F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    long = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    met = short.join(long, "token").filter((F.size("small") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")))
    idle = met.groupBy("small", "tokens").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("small")).select("tokens").distinct()
    return rules.join(idle, "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens"))


def fired(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) of the addresses where a mined rule fires, through rules posted by token."""
    index = rules.select("rule_id", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    asked = addresses.select("host", "path", F.explode("tokens").alias("token"))
    hits = asked.join(index, "token").groupBy("host", "path", "rule_id", "needed").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") == F.col("needed")).select("host", "path").distinct()


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
) -> DataFrame:
    """page_id, host, path, rule and verdict; a label of quality 0 or toxic 1 marks a bad address."""
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own_rule, own_verdict = rule_columns(F.col("host"), F.col("path"), rules)
    split = stage(split.withColumns({"rule": own_rule, "own": own_verdict}), "urls")
    # Labels repeated for an id count once, bad if any of them is.
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False))) | (F.coalesce(F.col("toxic") == 1, F.lit(False)))
    marked = labels.groupBy(F.col(label_id).alias("page_id")).agg(F.max(bad).alias("bad"))
    tokens = tokens_of(F.col("host"), F.col("path"))
    labelled = split.join(marked, "page_id").select(tokens.alias("tokens"), "bad")
    mined = mine(labelled, min_support, min_confidence, max_tokens)
    distinct = split.filter(F.col("own").isNull()).select("host", "path").distinct().withColumn("tokens", tokens)
    hit = fired(distinct, mined).withColumn("hit", F.lit(True))
    verdict = F.coalesce("own", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return split.join(hit, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
