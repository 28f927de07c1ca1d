import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import answer_metrics as am
from recallgrid.operators import answers, questions, reports
from recallgrid.plans import evaluate


def table(spark, *pairs, category="1"):
    rows = [(i, category, p, r) for i, (p, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "row_id int, category string, prediction string, reference string")


def test_equal_texts_score_one(spark):
    text = "the cat sat on mats"
    assert am.corpus_bleu(table(spark, (text, text))).first().bleu == pytest.approx(1.0)
    row = am.answer_scores(table(spark, (text, text))).first()
    assert (row.f1, row.rouge1, row.rouge2, row.rougeL) == pytest.approx((1, 1, 1, 1))


def test_rouge_example(spark):
    row = am.answer_scores(table(spark, ("the cat sat on the mat", "the mat sat on cat the")), stem=False).first()
    assert row.rouge1 == 1.0 and row.rougeL == pytest.approx(4 / 6)


def test_stemming_joins_word_forms(spark):
    pair = ("running quickly", "runs quick")
    assert am.answer_scores(table(spark, pair), stem=False).first().rouge1 == 0.0
    assert am.answer_scores(table(spark, ("running cats", "run cat")), stem=True).first().rouge1 == 1.0


def test_lcs_against_the_table_method():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
            prev = row
        assert am._lcs_length(a, b) == prev[-1]


def test_bleu_tokens(spark):
    df = spark.createDataFrame([("Don't pay $1,000.50 (ever), A-1.",)], "t string")
    got = df.select(am.bleu_tokens(F.col("t")).alias("v")).first().v
    assert got == ["Don't", "pay", "$", "1,000.50", "(", "ever", ")", ",", "A-1", "."]


def test_bleu_by_hand(spark):
    # Orders: 3/4, 1/3, then no match twice: floors 1/(2*2) and 1/(4*1).
    got = am.corpus_bleu(table(spark, ("a b c d", "a b x d z")), tokenize="ws").first().bleu
    want = np.exp(1 - 5 / 4) * (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25
    assert got == pytest.approx(want)
    assert am.corpus_bleu(table(spark, ("a b", "a b")), tokenize="ws").first().bleu == 0.0
    assert am.corpus_bleu(table(spark, ("q", "a b c d"), ("w x y z", "m")), tokenize="ws").first().bleu == 0.0
    assert am.corpus_bleu(table(spark).limit(0)).first().bleu == 0.0


def test_empty_answers_count_as_zero(spark):
    out = am.generation_metrics(table(spark, ("", "x y"), ("x y", "x y")), tokenize="ws", stem=False)
    overall = out.filter("section = 'overall'").first()
    assert (overall["count"], overall.f1, overall.rouge1, overall.rougeL) == (2, 0.5, 0.5, 0.5)


def test_greedy_match_by_hand(spark):
    rng = np.random.default_rng(2)
    p, r = rng.normal(size=(4, 3)), rng.normal(size=(6, 3))
    rows = [(1, "p", i, v.tolist()) for i, v in enumerate(p)] + [(1, "r", i, v.tolist()) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "row_id int, side string, tok int, embedding array<float>")
    got = am.greedy_match(df, block=2).first()
    cos = (p @ r.T) / np.linalg.norm(p, axis=1)[:, None] / np.linalg.norm(r, axis=1)[None, :]
    assert got.precision == pytest.approx(cos.max(axis=1).mean(), abs=1e-5)
    assert got.recall == pytest.approx(cos.max(axis=0).mean(), abs=1e-5)


QAS = "conv_id string, q_idx long, question_id string, question string, answer string"


def known(spark):
    rows = [("a", 0, "a_q0", "who?", "Ann"), ("a", 1, "a_q1", "when?", "May"), ("b", 0, "b_q0", "who?", "Bob"), ("b", 1, "b_q1", "why?", "")]
    return spark.createDataFrame(rows, QAS)


def test_ground_truth_order(spark):
    wanted = spark.createDataFrame(
        [("a", "a_q1", "x"), ("a", "zzz", "who?"), ("b", "b_q1", "why?"), ("c", "0", "none")],
        "conv_id string, question_id string, question string",
    )
    got = {r.question_id: r.ground_truth for r in questions.attach_ground_truth(wanted, known(spark), "conv_id").collect()}
    assert got == {"a_q1": "May", "zzz": "Bob", "b_q1": None, "0": None}
    by_place = questions.attach_ground_truth(wanted, known(spark), "conv_id", positional_fallback=True)
    assert {r.question_id: r.ground_truth for r in by_place.collect()}["0"] == "Bob"


def test_generation_stage(spark):
    records = spark.createDataFrame(
        [(1, "a", "a_q0", "who?", "1", ["Ann went", "x"]), (2, "b", "b_q1", "why?", "1", []), (3, "a", "a_q1", "when?", "2", [])],
        "row_id int, conv_id string, question_id string, question string, category string, chunks array<string>",
    )

    def reply(prompt):
        if "when?" in prompt:
            raise RuntimeError("no connection")
        return "<think>hm</think> <b>Ann</b>"

    out = evaluate.evaluate_generation(records, known(spark), answers.row_completer(reply), position="conv_id")
    rows = {r.question_id: r for r in out["per_question"].collect()}
    assert rows["a_q0"].generated_answer == "Ann" and rows["a_q0"].f1 == 1.0 and rows["a_q0"].num_chunks_retrieved == 2
    assert rows["a_q1"].generated_answer == "" and rows["a_q1"].f1 == 0.0
    assert [r.question_id for r in out["missing"].collect()] == ["b_q1"]
    metrics = {(r.section, r.category): r for r in out["metrics"].collect()}
    assert metrics[("overall", None)]["count"] == 2 and metrics[("category", "1")].rouge1 == 1.0


def test_prompt_holds_question_and_context(spark):
    df = spark.createDataFrame([("why?", ["2023-01-15 14:30: so"])], "question string, chunks array<string>")
    row = answers.answer_prompts(df).first()
    assert row.context == "so" and "why?" in row.prompt and re.search(r"\nso\n", row.prompt)


def test_reports(spark):
    gen = am.generation_metrics(table(spark, ("a b", "a b")), tokenize="ws", stem=False)
    scores = reports.scoreboard(generation=gen)
    wide = reports.pivot_scoreboard(scores, ["f1", "rouge1"]).filter("section = 'generation_overall'").first()
    assert (wide.f1, wide.rouge1) == (1.0, 1.0)
    assert all(r.delta == 0 for r in reports.compare_runs(scores, scores).collect())
    with pytest.raises(ValueError):
        reports.scoreboard()


def test_last_writer_goes_by_file_position_not_by_spelling(spark):
    rows = [(f"conv_{i}", i, 0, f"conv_{i}_q0", "same?", f"a{i}") for i in range(12)]
    asked = spark.createDataFrame(
        rows, "conv_id string, conv_idx long, q_idx long, question_id string, question string, answer string"
    )
    wanted = spark.createDataFrame([("x", "zzz", "same?")], "conv_id string, question_id string, question string")
    assert questions.attach_ground_truth(wanted, asked, "conv_idx").first().ground_truth == "a11"
    first = questions.take_conversations(asked, 3, "conv_idx").collect()
    assert sorted(r.conv_id for r in first) == ["conv_0", "conv_1", "conv_2"]


def test_greedy_match_keeps_rows_with_one_side(spark):
    rows = [(1, "p", 0, [1.0, 0.0]), (1, "r", 0, [1.0, 0.0]), (2, "p", 0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "row_id int, side string, tok long, embedding array<double>")
    got = {r.row_id: (r.precision, r.recall, r.f1) for r in am.greedy_match(frame).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}


def test_n_grams_are_counted_inside_the_row(spark):
    said = [(1, "c", "the cat sat on the mat", "the cat on the mat"), (2, "c", "", "a b"), (3, None, "a a a", "a a"), (3, None, "a a a", "a a")]
    scores = am.answer_scores(
        spark.createDataFrame(said, "row_id long, category string, prediction string, reference string"), tokenize="ws", stem=False
    )
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {r.row_id: r for r in scores.collect()}
    assert len(got) == scores.count() == 3
    assert [got[1][f"bleu{n}_overlap"] for n in range(1, 5)] == [5, 3, 1, 0]
    assert [got[1][f"bleu{n}_pred_total"] for n in range(1, 5)] == [6, 5, 4, 3]
    assert [got[2][f"bleu{n}_ref_total"] for n in range(1, 5)] == [2, 1, 0, 0]
    # Rows that are the same answer twice count as one with all their n-grams.
    assert [got[3][f"bleu{n}_overlap"] for n in range(1, 5)] == [4, 2, 0, 0]
