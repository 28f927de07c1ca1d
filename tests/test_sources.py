import json

import pytest
from pyspark.sql import functions as F

from recallgrid.functions.vectors import letter_counts
from recallgrid.operators import ledger, retrieval_metrics
from recallgrid.operators.turns import explode_messages, pair_turns
from recallgrid.plans import evaluate, index, retrieve
from recallgrid.sources import collections, datasets, sinks

DATA = [
    {
        "conv_id": "one",
        "dialogs": [
            {"session_id": "s1", "datetime": "May", "messages": [
                {"role": "user", "content": "I like red foxes"}, {"role": "assistant", "content": "Noted"},
                {"role": "user", "content": "and blue hens"}, {"role": "assistant", "content": "Blue hens, sure"}]},
            {"messages": [{"role": "Ann", "content": "Zebra zone"}]},
        ],
        "qas": [
            {"question": "red foxes?", "answer": 42, "evidences": ["I like red foxes"], "category": 1},
            {"question_id": "x", "question": "zebra zone?", "answer": "Zebra", "evidences": ["zebra zone"]},
            {"question": "", "answer": "-"},
        ],
    },
    {"dialogs": [], "qas": [{"question": "lost?", "answer": "a", "evidences": []}]},
]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "set.json"
    path.write_text(json.dumps(DATA, ensure_ascii=False), encoding="utf-8")
    good, bad = datasets.quarantine(datasets.read_dataset(spark, str(path)))
    assert bad.count() == 0
    return good


def test_dataset_defaults(dataset):
    rows = dataset.orderBy("position").collect()
    assert [r.conv_id for r in rows] == ["one", "conv_1"]
    assert rows[0].qas[0].answer == "42" and rows[0].qas[0].category == "1"


def test_lines_and_broken_rows(spark, tmp_path):
    path = tmp_path / "set.jsonl"
    path.write_text("\n".join([json.dumps(DATA[0]), "{broken", json.dumps(DATA[1])]), encoding="utf-8")
    good, bad = datasets.quarantine(datasets.read_dataset(spark, str(path), lines=True))
    assert sorted(r.conv_id for r in good.collect()) == ["conv_2", "one"]
    assert [(r.position, r._corrupt) for r in bad.collect()] == [(1, "{broken")]


@pytest.mark.parametrize("size", ["64", "1000", "10m"])
def test_positions_do_not_depend_on_splits(spark, tmp_path, size):
    for name, n in (("a", 60), ("b", 7)):
        lines = [json.dumps({"dialogs": [], "qas": [{"question": f"{name}{i} {'x' * (i % 9)}"}]}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        good, _ = datasets.quarantine(datasets.read_dataset(spark, str(tmp_path), lines=True))
        rows = good.select("source", "conv_id", F.col("qas")[0]["question"].alias("q")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 67
    for r in rows:
        assert r.conv_id == f"conv_{r.q.split()[0][1:]}" and r.source.endswith(f"{r.q[0]}.jsonl")


def test_index_retrieve_evaluate(spark, dataset, tmp_path):
    notes = index.index_dataset(dataset, letter_counts)
    rows = notes.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2]
    assert rows[0].content == "User: I like red foxes\nAssistant: Noted"
    assert rows[0].timestamp == "May" and rows[0].tags == ["conv_one", "session_s1"]
    assert rows[2].tags == ["conv_one", "session_unknown"] and rows[2].category == "one"

    records = retrieve.retrieve(dataset, notes, letter_counts, k=2, metric="cosine")
    out = {r.question_id: r for r in records.collect()}
    assert sorted(out) == ["one_q0", "x"]  # no empty question, no unindexed conversation
    assert len(out["x"].chunks) == 2 and out["x"].chunks[0].content == "User: Zebra zone"

    sinks.write_retrieval_records(records, str(tmp_path / "records"))
    back, failed = datasets.read_retrieval_records(spark, str(tmp_path / "records"), lines=True)
    assert failed.count() == 0
    result = evaluate.evaluate_retrieval(back, [1, 2])
    top = {r.k_label: r for r in result["averages"].filter("section = 'overall'").collect()}
    assert top["2"].n == 2 and top["2"].macro_recall == 1.0

    cases = retrieval_metrics.attach_question_text(
        retrieval_metrics.bad_cases(result["per_record"], bottoms={"f1": 1}), back
    )
    sinks.write_bad_cases(cases, str(tmp_path / "bad"))
    sinks.write_bad_cases_csv(cases, str(tmp_path / "bad_csv"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "bad_csv"))
    assert flat.columns == ["k", "idx", "question_id", "reason", "precision", "recall", "f1", "ndcg", "question"]
    assert flat.count() == 2 and spark.read.json(str(tmp_path / "bad")).select("metrics.f1").count() == 2

    meta = spark.createDataFrame([("ir",)], "precision_mode string")
    parts = sinks.eval_sections(meta, result["averages"], result["per_record"], result["skipped"].select("idx", "question_id"), failed)
    sinks.write_eval_report(parts, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/section=macro")).count() == 2


def test_evolution_plan(spark, dataset):
    notes = index.index_dataset(dataset, letter_counts)
    evolved, decisions = index.evolve(notes, metric="cosine", limit=2.0)
    rows = evolved.orderBy("seq").collect()
    assert rows[0].links == [] and rows[1].links == [rows[0].id] and len(rows[2].links) == 2
    assert decisions.count() == 2

    def model(batches):
        for batch in batches:
            yield batch.assign(reply='{"should_evolve": true, "actions": ["strengthen"], "suggested_connections": ["z"], "tags_to_update": ["t"]}')

    evolved, _ = index.evolve(notes, model)
    assert [r.links for r in evolved.orderBy("seq").collect()] == [[], ["z"], ["z"]]


def test_ledgers_resume_indexing(spark, dataset):
    processed = spark.createDataFrame([("one", "0_May"), ("one", "2_")], "conv_id string, turn_key string")
    assert [r.seq for r in index.index_dataset(dataset, letter_counts, processed=processed).collect()] == [1]
    done = spark.createDataFrame([("one",)], "conv_id string")
    assert index.index_dataset(dataset, letter_counts, completed=done).count() == 0


def test_ledgers_of_stored_notes(spark, dataset):
    turns = pair_turns(explode_messages(dataset))
    notes = index.index_dataset(dataset, letter_counts)
    part = ledger.ledger_of(turns, notes.filter("seq <> 1"))
    assert sorted(r.turn_key for r in part.collect()) == ["0_May", "2_"]
    assert ledger.completed_of(turns, part).count() == 0
    assert [r.seq for r in index.index_dataset(dataset, letter_counts, processed=part).collect()] == [1]
    assert [r.conv_id for r in ledger.completed_of(turns, ledger.ledger_of(turns, notes)).collect()] == ["one"]


def test_shapes_of_records(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(json.dumps([
        {"question_id": "a", "chunks": ["plain", {"text": "t"}, {"id": 1}], "evidence": ["e"], "evidences": ["no"], "category": 3},
        {"chunks": [{"content": "c"}], "evidences": ["x", 1]},
        {"question_id": "c"},
    ]), encoding="utf-8")
    rows = datasets.read_retrieval_records(spark, [str(path)])[0].orderBy("idx").collect()
    assert [(r.question_id, r.chunks, r.evidences, r.category) for r in rows] == [
        ("a", ["plain", "t"], ["e"], "3"), ("idx1", ["c"], ["x"], "unknown"), ("c", [], [], "unknown"),
    ]


def some_notes(spark, *ids):
    return spark.createDataFrame([(f"conv{i}", i, f"text {i}") for i in ids], "conv_id string, id string, content string")


@pytest.mark.parametrize("there, extend", [(True, False), (True, True), (False, False), (False, True)])
def test_open_collection(spark, tmp_path, there, extend):
    path = str(tmp_path / "coll")
    if there:
        collections.open_collection(spark, path, partitions=4).add(some_notes(spark, "1"))
    if there and not extend:
        with pytest.raises(collections.CollectionExists, match="already exists"):
            collections.open_collection(spark, path, extend, partitions=4)
        return
    opened = collections.open_collection(spark, path, extend, like=some_notes(spark, "0"), partitions=4)
    assert opened.exists() and opened.read().count() == (1 if there else 0)


def test_last_of_several_rows_with_an_id_is_kept(spark, tmp_path):
    rows = [("c", "x", seq, f"text {seq}") for seq in (3, 9, 10, 1)]
    coll = collections.open_collection(spark, str(tmp_path / "c"))
    coll.add(spark.createDataFrame(rows, "conv_id string, id string, seq int, content string"))
    assert [(r.seq, r.content) for r in coll.read().collect()] == [(10, "text 10")]


def test_collection_life(spark, tmp_path):
    coll = collections.open_collection(spark, str(tmp_path / "c"), partitions=4)
    coll.add(some_notes(spark, "1", "2"))
    coll.add(some_notes(spark, "2", "3", "3"))
    assert sorted(r.id for r in coll.read().collect()) == ["1", "2", "3"]
    assert [r.id for r in coll.conversation("conv2").collect()] == ["2"]
    copy = coll.snapshot(str(tmp_path / "copy"))
    coll.add(some_notes(spark, "4"))
    assert (copy.read().count(), coll.read().count()) == (3, 4)
    assert copy.read().exceptAll(coll.read()).count() == 0
    with pytest.raises(collections.CollectionExists):
        coll.snapshot(copy.path)
    plan = coll.conversation("conv2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_generation_report(spark, tmp_path):
    from recallgrid.operators import answer_metrics

    made = spark.createDataFrame([(1, "1", "a", "a")], "row_id int, category string, prediction string, reference string")
    metrics = answer_metrics.generation_metrics(made, tokenize="ws", stem=False)
    config = spark.createDataFrame([(5,)], "context_k int")
    sinks.write_generation_report(config, metrics, made, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/section=by_category")).first().category == "1"
    assert spark.read.parquet(str(tmp_path / "g/section=overall")).select(F.sum("count")).first()[0] == 1


def test_rows_are_not_shuffled_to_learn_their_position(spark, tmp_path):
    lines = [json.dumps({"question_id": f"q{i}", "chunks": ["a"], "evidences": ["a"]}) for i in range(20)]
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    good, _ = datasets.read_retrieval_records(spark, str(tmp_path), lines=True)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r.idx for r in good.collect()) == sorted([*range(20)] * 2)


def test_a_report_is_averaged_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(value):
        asked.add(1)
        return float(value)

    names = [f"{a}_{m}" for a in ("macro", "micro") for m in ("precision", "recall", "f1", "ndcg")]
    sums = ["tp_evidence", "retrieved", "gold", "rel_chunks", "dcg", "idcg"]
    frame = spark.range(1).select(
        F.lit("overall").alias("section"), F.lit("c").alias("category"), F.lit("3").alias("k_label"), costly("id").alias("n"),
        *[F.lit(0.5).alias(c) for c in [*names, *sums]],
    )
    some = spark.range(1)
    sinks.write_eval_report(sinks.eval_sections(some, frame, some, some, some), str(tmp_path / "report"))
    assert asked.value == 1
