import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import recallgrid  # noqa: E402

cloudpickle.register_pickle_by_value(recallgrid)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and was river stone light winter market garden silver letter quiet morning bridge window paper ocean".split()


@pytest.fixture(scope="session")
def llm_spark(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture
def docs(llm_spark):
    """A documents table from (id, text) pairs, with extra columns whose names clash."""

    def make(rows, source="s"):
        full = [(i, t, "en", source, len(t or "")) for i, t in rows]
        made = llm_spark.createDataFrame(full, SCHEMA)
        clash = "n_words piece shard fp length kept host score _row _key ids text_x".split()
        return made.selectExpr("*", *[f"'clash' as {c}" for c in clash])

    return make


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),
    (None, "no id here"),
    (5, "Ünï cödé 中文 😀 <|endoftext|> x²  two  spaces\n\n end "),
    (6, "word " * 30_000),
    (7, "a" * 20_000),
]
