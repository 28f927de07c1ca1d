"""Site-relative line frequency: boilerplate lines go, the rest of the page stays.

Pages are grouped by host; a line's ratio is the number of its host's pages
that contain it, over all pages of the host.  Lines with a ratio above
``max_ratio`` on at least ``min_pages`` pages are dropped wherever they stand.
Pages with the same text count as one, so copies of a page don't turn its own
lines into boilerplate.  Pages and lines are known by 64-bit hashes, and counted
after a partial count in each task, so a hot host, page or line is no hot key.
The few hashes of each host's boilerplate (at most the host's mean number of
lines over ``max_ratio``) are written down and meet the pages by host in a join
whose small side Spark knows the size of, so texts stay where they are.

A line with white space only is never dropped.  Null texts stay null; a null
host is a host of its own; repeated rows are cleaned each; an empty table gives
an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage

MAX_RATIO = 0.05
MIN_PAGES = 5
WORDED = r"[^\x20\x09-\x0D]"


def url_host(url: Column) -> Column:
    """The host of an address, for tables of web pages."""
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(_host, _bad): the hashes of every host's boilerplate lines; pages have _host, _page (their text's hash) and _lines."""
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("total"))
    lines = pages.select("_host", "_page", F.explode(F.array_distinct("_lines")).alias("line")).filter(F.col("line").rlike(WORDED))
    marks = lines.select("_host", F.xxhash64("line").alias("mark"), "_page").distinct()
    counts = marks.groupBy("_host", "mark").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") >= min_pages)
    far = frequent.alias("f").join(totals.alias("t"), F.col("f._host").eqNullSafe(F.col("t._host")))
    bad = far.filter(F.col("n") > max_ratio * F.col("total"))
    return bad.groupBy(F.col("f._host").alias("_bad_host")).agg(F.collect_list("mark").alias("_bad"))


def drop_boilerplate(
    df: DataFrame,
    host: Column,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``df`` with its text cleaned, n_lines and n_dropped."""
    own = df.drop("n_lines", "n_dropped", "_host", "_lines", "_page", "_bad", "_bad_host", "_kept")
    split = own.withColumn("_host", host).withColumn("_lines", F.split(text_col, "\n"))
    bad = boilerplate(split.select("_host", F.xxhash64(text_col).alias("_page"), "_lines"), max_ratio, min_pages)
    met = split.join(stage(bad, "boilerplate"), F.col("_host").eqNullSafe(F.col("_bad_host")), "left")
    rest = F.filter("_lines", lambda line: ~line.rlike(WORDED) | ~F.array_contains("_bad", F.xxhash64(line)))
    kept = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(rest)
    count = lambda lines: F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return (
        met.withColumn("_kept", kept)
        .withColumns(
            {
                text_col: F.when(F.size("_kept") == F.size("_lines"), F.col(text_col)).otherwise(F.array_join("_kept", "\n")),
                "n_lines": F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(count(F.col("_lines"))).cast("long"),
                "n_dropped": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long"),
            }
        )
        .select(*own.columns, "n_lines", "n_dropped")
    )
