import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import matching, reports, retrieval_metrics as rm

RECORDS = "idx int, question_id string, question string, category string, chunks array<string>, evidences array<string>"


def records(spark, *rows):
    return spark.createDataFrame(
        [(i, f"q{i}", f"ask {i}", cat, chunks, evs) for i, (cat, chunks, evs) in enumerate(rows)], RECORDS
    )


def test_worked_counts(spark):
    made = records(spark, ("1", ["nothing", "has red fox", "red fox and blue hen", "late red fox"], ["red fox", "blue hen"]))
    row = rm.per_record_metrics(made, [3]).first()
    assert (row.tp_evidence, row.retrieved, row.gold, row.rel_chunks) == (2, 3, 2, 2)
    assert row.dcg == pytest.approx(1.130930, abs=1e-6) and row.idcg == pytest.approx(1.630930, abs=1e-6)
    assert (row.precision, row.recall, row.f1) == pytest.approx((2 / 3, 1.0, 0.8))
    assert row.ndcg == pytest.approx(0.693426, abs=1e-6)


def test_repeated_evidence_halves_recall(spark):
    row = rm.per_record_metrics(records(spark, ("1", ["red fox"], ["Red  fox", "red fox"])), [None]).first()
    assert (row.k_label, row.tp_evidence, row.gold, row.recall) == ("ALL", 1, 2, 0.5)


def test_legacy_precision(spark):
    made = records(spark, ("1", ["red fox", "a red fox", "the red fox"], ["red fox"]))
    counts = rm.retrieval_counts(made, [3])
    assert rm.counts_to_metrics(counts, "legacy").first().precision == pytest.approx(1 / 3)
    assert rm.counts_to_metrics(counts).first().precision == 1.0
    with pytest.raises(ValueError):
        rm.counts_to_metrics(counts, "other")


def test_speakers_quotes_and_compatibility_forms_match(spark):
    made = records(spark, ("1", ["User: It’s ﬁne"], ["assistant: it's fine"]))
    assert rm.retrieval_counts(made, [1]).first().tp_evidence == 1
    assert rm.retrieval_counts(made, [1], nfkc=False).first().tp_evidence == 0


def test_no_chunks_give_zeros(spark):
    row = rm.per_record_metrics(records(spark, ("1", [], ["x"])), [3]).first()
    assert (row.retrieved, row.precision, row.recall, row.f1, row.ndcg) == (0, 0, 0, 0, 0)


def test_macro_and_micro_differ(spark):
    made = records(spark, ("1", ["red"], ["red"]), ("2", ["a", "b", "c"], ["red"]))
    out = {
        (r.section, r.category): r
        for r in rm.average_metrics(rm.per_record_metrics(made, [None]), [None]).collect()
    }
    overall = out[("overall", None)]
    assert (overall.n, overall.macro_precision, overall.micro_precision) == (2, 0.5, 0.25)
    assert out[("category", "1")].macro_precision == 1.0 and out[("category", "2")].n == 1


def test_report_order(spark):
    made = records(spark, ("b", ["red"], ["red"]), ("a", ["red"], ["red"]))
    out = rm.average_metrics(rm.per_record_metrics(made, [3, 10, None]), [3, 10, None])
    got = [(r.category, r.k_label) for r in reports.in_report_order(out).collect()]
    assert got == [(c, k) for c in (None, "a", "b") for k in ("3", "10", "ALL")]


def test_empty_input_still_lists_cutoffs(spark):
    per_record = rm.per_record_metrics(records(spark, ("1", ["x"], ["x"])), [3, None]).limit(0)
    out = rm.average_metrics(per_record, [3, None]).collect()
    assert sorted((r.k_label, r.n, r.macro_f1, r.micro_ndcg) for r in out) == [("3", 0, 0, 0), ("ALL", 0, 0, 0)]


def test_files_are_kept_apart(spark):
    made = records(spark, ("1", ["red"], ["red"]), ("1", ["a"], ["red"])).withColumn("source", F.col("question_id"))
    out = rm.average_metrics(rm.per_record_metrics(made, [1]), [1], extra_keys=["source"])
    got = {r.source: r.macro_recall for r in out.filter("section = 'overall'").collect()}
    assert got == {"q0": 1.0, "q1": 0.0}


def test_cutoff_spec():
    assert rm.parse_cutoffs(["10", 3, "3", "all"]) == [3, 10, None]
    assert rm.parse_cutoffs([0, 5]) == [5, None]


def test_recall_grows_with_k(spark):
    rng = random.Random(3)
    words = ["red", "fox", "blue", "hen", "owl"]
    rows = [
        ("1", [" ".join(rng.choices(words, k=3)) for _ in range(8)], [" ".join(rng.choices(words, k=2))])
        for _ in range(20)
    ]
    out = rm.per_record_metrics(records(spark, *rows), [1, 3, 5, None]).collect()
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r.idx, r.k or 99)), key=lambda r: r.idx):
        recalls = [r.recall for r in group]
        assert recalls == sorted(recalls) and all(0 <= r <= 1 for r in recalls)


def test_bad_cases(spark):
    schema = "k_label string, idx int, question_id string, precision double, recall double, f1 double, ndcg double"
    scores = spark.createDataFrame(
        [("3", 1, "r1", 0.1, 0.4, 0.2, 0.5), ("3", 2, "r2", 0.1, 0.6, 0.3, 0.5), ("3", 3, "r3", 0.1, 0.9, 0.3, 0.5)],
        schema,
    )
    got = rm.bad_cases(scores, {"recall": 0.5}, {"f1": 2}).collect()
    assert sorted((r.question_id, r.reason) for r in got) == [("r1", "thresh:recall<0.5"), ("r2", "bottom:f1@2")]
    assert rm.bad_cases(scores).count() == 0


def test_coercion(spark):
    raw = spark.createDataFrame(
        [
            ('["a", {"chunk_content": 1, "text": "b"}, {"id": 3}, 7, {"content": "c", "text": "d"}]', None, '["e", 5]', "0"),
            ("null", "[]", '["ignored"]', None),
        ],
        "chunks string, evidence string, evidences string, category string",
    ).select(*[F.parse_json(c).alias(c) for c in ("chunks", "evidence", "evidences")], "category")
    rows = matching.coerce_records(raw).collect()
    assert (rows[0].chunks, rows[0].evidences, rows[0].category) == (["a", "b", "c"], ["e"], "0")
    assert (rows[1].chunks, rows[1].evidences, rows[1].category) == ([], [], "unknown")
    judged, skipped = matching.split_no_evidence(matching.coerce_records(raw))
    assert (judged.count(), skipped.count()) == (1, 1)


def holds(chunk, ev, threshold=0.85):
    if ev in chunk:
        return True
    tokens = re.findall(r"\w+", ev)
    have = set(re.findall(r"\w+", chunk))
    return bool(tokens) and sum(t in have for t in tokens) / len(tokens) >= threshold


def test_corpus_matching_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["red", "fox", "redfox", "hen", "owl", "blue-ish", "a", "??", "it's", "x_1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(40)]
    evidences = ["", "?", "??", "e", "ed f", "dfo", "owl", "zzz", "red fox", "s x", "- ", "ish a hen"]
    evidences += [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)] + ["owl"]
    items = list(enumerate(evidences))
    found = matching.match_corpus(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(items, "item_id int, text string"),
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = found.collect()
    want = [(d, i) for d, t in docs for i, e in items if holds(t.strip(), e.strip())]
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)


def test_short_evidences_look_at_the_right_end_of_words(spark):
    rows = [(1, "a fox", ["a", "fox"], 2), (2, "ox", ["ox"], 1), (3, "ox.", ["ox"], 1)]
    parts = matching._short_parts(spark.createDataFrame(rows, "no long, norm string, tokens array<string>, n int"))
    words = spark.createDataFrame([("fox",), ("redfox",), ("foxes",)], "piece string")
    found = matching._holders(words, parts.withColumnRenamed("no", "part_no")).collect()
    assert sorted((r.part_no, r.piece) for r in found) == [
        (1, "fox"), (1, "foxes"), (2, "fox"), (2, "foxes"), (2, "redfox"), (3, "fox"), (3, "redfox"),
    ]


def test_texts_that_share_an_id_are_matched_one_by_one(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "blue hen"), (1, "red fox"), (None, "red fox")], "doc_id int, text string")
    wanted = ["red", "ed f", "fox red", "red fox hen", "the red blue fox"]
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id int, text string")
    found = matching.match_corpus(docs, items, threshold=0.6)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, i) for i in (0, 0, 1, 1, 2, 2, 3, 3)]


def test_files_are_averaged_and_ranked_apart(spark):
    rows = [("f1", 0, "q", "a", 0.1), ("f1", 1, "q", "b", 0.9), ("f2", 0, "q", "c", 0.2), ("f2", 1, "q", "d", 0.8)]
    frame = spark.createDataFrame(rows, "source string, idx long, question_id string, question string, f1 double").selectExpr(
        "*", "'3' as k_label", "'c' as category", "f1 as precision", "f1 as recall", "f1 as ndcg",
        *[f"1.0D as {c}" for c in rm.COUNTS],
    )
    cases = rm.bad_cases(frame, bottoms={"f1": 1}, by=["source"])
    text = rm.attach_question_text(cases, frame, by=["source"])
    assert sorted((r.source, r.idx, r.question) for r in text.collect()) == [("f1", 0, "a"), ("f2", 0, "c")]
    every = frame.select("source").union(spark.createDataFrame([("f3",)], "source string"))
    got = rm.average_metrics(frame, [3], extra_keys=["source"], records=every).filter("section = 'overall'").collect()
    assert {r.source: r.n for r in got} == {"f1": 2, "f2": 2, "f3": 0}


@pytest.mark.parametrize("threshold", [0, -1, 1.5])
def test_thresholds_outside_their_range_are_refused(spark, threshold):
    from recallgrid.operators import matching

    frame = spark.createDataFrame([(["a"], ["b"])], "chunks array<string>, evidences array<string>")
    with pytest.raises(ValueError):
        matching.match_in_record(frame, threshold)
