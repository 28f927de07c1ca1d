import os
import re

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_a_twin_or_is_known_to_have_none():
    without = set(contract.queries()) - set(contract.oracle_sql())
    operators = {q for q in without if not q.startswith("op") and q != "pipeline"}
    assert not operators
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_library_keeps_to_the_rules_for_clusters():
    for folder, _, files in os.walk(os.path.join(ROOT, "recallgrid")):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    source = file.read()
                assert not re.search(r"localCheckpoint|crossJoin|toPandas|tempfile|\.rdd\b(?!\.getNumPartitions)", source), name
                if os.path.basename(folder) != "llm":  # there, models and vocabularies of bounded size are collected
                    assert ".collect()" not in source, name
