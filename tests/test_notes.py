import json

from pyspark.sql import functions as F

from recallgrid.functions.vectors import letter_counts
from recallgrid.operators import evolution, notes as notes_ops, search

NOTE = "conv_id string, seq int, id string, content string, links array<string>, context string, tags array<string>"


def notes(spark, *rows):
    """(id, links) pairs or ids as a notes table."""
    full = []
    for i, row in enumerate(rows):
        name, links = row if isinstance(row, tuple) else (row, [])
        full.append(("c", i, name, f"text {name}", links, f"about {name}", [f"tag {name}"]))
    return notes_ops.note_defaults(spark.createDataFrame(full, NOTE))


def hits(spark, *ids):
    rows = [("q", name, i, 1.0 / i) for i, name in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "q string, id string, rank int, score double")


def test_links_fill_up_to_k_only(spark):
    stored = notes(spark, ("h1", ["n9", "h2", "missing"]), "h2", "n9")
    rows = search.search_with_links(hits(spark, "h1", "h2"), stored, ["q"], 3).orderBy("rank").collect()
    assert [(r.id, r.is_neighbor) for r in rows] == [("h1", False), ("h2", False), ("n9", True)]
    assert rows[2].score is None
    rows = search.search_with_links(hits(spark, "h1", "h2"), stored, ["q"], 2).orderBy("rank").collect()
    assert [r.id for r in rows] == ["h1", "h2"]


def test_first_way_to_a_linked_note_counts(spark):
    stored = notes(spark, ("h1", ["b", "a"]), ("h2", ["a", "c", "c"]), "a", "b", "c")
    rows = search.search_with_links(hits(spark, "h1", "h2"), stored, ["q"], 9).orderBy("rank").collect()
    assert [r.id for r in rows] == ["h1", "h2", "b", "a", "c"]


def test_related_text_repeats_links_and_caps_them_per_hit(spark):
    stored = notes(spark, ("h1", ["a", "gone", "b", "c"]), ("h2", ["a"]), "a", "b", "c")
    row = search.related_with_links(hits(spark, "h1", "h2"), stored, ["q"], 2).first()
    lines = row.text.splitlines()
    assert [line.split("\t")[1] for line in lines] == [
        f"memory content: text {n}" for n in ("h1", "a", "b", "h2", "a")
    ]


def test_related_text_numbers_lines_and_keeps_empty_questions(spark):
    asked = spark.createDataFrame([("q",), ("lonely",)], "q string")
    rows = {
        r.q: r for r in search.related_notes_text(hits(spark, "h2", "h1"), notes(spark, "h1", "h2"), ["q"], 5, asked).collect()
    }
    assert rows["lonely"].text == "" and rows["lonely"].n_lines == 0
    first, second = rows["q"].text.splitlines()
    assert first.startswith("memory index:0\t") and "text h2" in first
    assert second.startswith("memory index:1\t") and second.endswith("memory tags: ['tag h1']")


def test_dangling_and_hybrid(spark):
    stored = notes(spark, ("h1", ["n9", "gone"]), "n9")
    assert [(r.src, r.pos, r.dst) for r in search.dangling_links(stored).collect()] == [("h1", 1, "gone")]
    both = search.hybrid_union(hits(spark, "a", "b"), hits(spark, "b", "c", "d"), ["q"], 3).orderBy("rank")
    assert [(r.id, r.source) for r in both.collect()] == [("a", 0), ("b", 0), ("c", 1)]


def test_hydration_drops_unknown_ids(spark):
    rows = search.hydrate_hits(hits(spark, "h1", "ghost"), notes(spark, "h1")).collect()
    assert [(r.id, r.content, r.keywords) for r in rows] == [("h1", "text h1", [])]


def test_projection_of_stored_metadata(spark):
    stored = spark.createDataFrame(
        [("1", None, "doc", '["a"]', "broken", None), ("2", "own", "doc", "", None, "ctx")],
        "id string, content string, document string, keywords string, tags string, context string",
    ).withColumn("timestamp", F.lit(None).cast("string")).withColumn("category", F.lit("x"))
    rows = search.project_chunks(stored).orderBy("id").collect()
    assert (rows[0].content, rows[0].keywords, rows[0].tags, rows[0].context) == ("doc", ["a"], [], "")
    assert (rows[1].content, rows[1].keywords, rows[1].timestamp) == ("own", [], "")


def test_update_delete_lookup(spark):
    stored = notes(spark, "a", "b").withColumn("embedding", letter_counts(F.col("content")))
    changes = spark.createDataFrame(
        [("a", "zzz", None, 1), ("ghost", "x", "y", 2)], "id string, content string, context string, other int"
    )
    rows = {r.id: r for r in notes_ops.update_notes(stored, changes, letter_counts).collect()}
    assert (rows["a"].content, rows["a"].context, rows["a"].embedding[25]) == ("zzz", "about a", 3.0)
    assert rows["b"].content == "text b" and "other" not in rows["a"].asDict()
    assert [r.id for r in notes_ops.unknown_ids(stored, changes).collect()] == ["ghost"]
    assert [r.id for r in notes_ops.delete_notes(stored, changes).collect()] == ["b"]
    report = {r.id: r.found for r in notes_ops.deletion_report(stored, changes).collect()}
    assert report == {"a": True, "ghost": False}
    assert notes_ops.get_by_ids(stored, ["b", "x"]).first().id == "b"
    assert notes_ops.get_by_ids(stored, changes).first().id == "a"


def test_consolidation(spark):
    stored = notes(spark, "a", "b")
    log = spark.createDataFrame(
        [("a", 1, "one", "kept"), ("a", 2, "two", None)], "id string, version int, context string, category string"
    )
    rows = {r.id: r for r in notes_ops.consolidate(stored, log).collect()}
    assert (rows["a"].context, rows["a"].category, rows["b"].context) == ("two", "kept", "about b")
    flags = spark.createDataFrame([("c", i, i % 2 == 0) for i in range(13)], "conv_id string, seq long, should_evolve boolean")
    for chunk in (3, 65_536):
        points = notes_ops.consolidation_points(flags, 3, chunk=chunk).orderBy("seq").collect()
        assert [(r.seq, r.evolved_count) for r in points] == [(4, 3), (10, 6)]


def test_usage(spark):
    log = spark.createDataFrame([("a", "2"), ("a", "9"), ("ghost", "1")], "id string, ts string")
    rows = {r.id: r for r in notes_ops.usage_counts(notes(spark, "a", "b"), log).collect()}
    assert (rows["a"].retrieval_count, rows["a"].last_accessed, rows["b"].retrieval_count) == (2, "9", 0)


def decisions(spark, *rows):
    replies = [(i, s, json.dumps(d) if isinstance(d, dict) else d) for i, s, d in rows]
    df = spark.createDataFrame(replies, "id string, seq int, reply string")
    return evolution.parse_decisions(df)


def reply(*actions, links=(), tags=(), contexts=(), neighbor_tags=()):
    return {
        "should_evolve": True, "actions": list(actions), "suggested_connections": list(links),
        "tags_to_update": list(tags), "new_context_neighborhood": list(contexts),
        "new_tags_neighborhood": [list(t) for t in neighbor_tags],
    }


def test_unreadable_and_incomplete_replies_change_nothing(spark):
    made = decisions(
        spark, ("a", 0, "no json"), ("b", 1, {"should_evolve": True, "actions": ["strengthen"]}),
        ("c", 2, {"should_evolve": True}), ("d", 3, None), ("e", 4, reply("strengthen")),
    )
    rows = {r.id: r for r in made.collect()}
    assert [rows[i].decision.should_evolve for i in "abcde"] == [False, False, False, False, True]
    assert [rows[i].readable for i in "abcde"] == [False, True, True, False, True]
    assert rows["a"].decision.actions == []
    assert sorted(r.id for r in evolution.undecodable(made).collect()) == ["a", "d"]


def test_evolution(spark):
    stored = notes(spark, "a", "b", "c", "d")
    made = decisions(
        spark,
        ("c", 2, reply("strengthen", "update_neighbor", links=["a", "x"], tags=["new"], contexts=["ctx a"], neighbor_tags=[["ta"], ["tb"]])),
        ("d", 3, reply("update_neighbor", neighbor_tags=[["later"], ["t2"], ["beyond"]], contexts=[])),
        ("b", 1, "broken"),
    )
    near = spark.createDataFrame(
        [("c", "a", 0), ("c", "b", 1), ("d", "c", 0), ("d", "a", 1)], "note_id string, id string, neighbor_idx int"
    )
    rows = {r.id: r for r in evolution.apply_evolution(stored, made, near).collect()}
    assert (rows["c"].links, rows["c"].tags, rows["c"].context) == (["a", "x"], ["later"], "about c")
    assert (rows["a"].tags, rows["a"].context) == (["t2"], "ctx a")
    assert (rows["b"].tags, rows["b"].context) == (["tb"], "about b")
    assert rows["d"].tags == ["tag d"]


def test_analysis_falls_back(spark):
    def model(batches):
        for batch in batches:
            good = json.dumps({"keywords": ["k"], "context": "c", "tags": ["t"]})
            yield batch.assign(reply=[good if "text a" in p else None for p in batch["prompt"]])

    rows = {r.id: r for r in evolution.analyze(notes(spark, "a", "b"), model).collect()}
    assert (rows["a"].keywords, rows["a"].context, rows["a"].tags) == (["k"], "c", ["t"])
    assert (rows["b"].keywords, rows["b"].context, rows["b"].tags) == ([], "General", [])


def test_analysis_without_a_model(spark):
    frame = spark.createDataFrame([("a", "fox hen fox owl"), ("b", "?!")], "id string, content string")
    rows = {r.id: r for r in evolution.analyze(frame, n=2).collect()}
    assert (rows["a"].keywords, rows["a"].context, rows["a"].tags) == (["fox", "hen"], "General", [])
    assert rows["b"].keywords == []


def test_empty_reply_has_the_shape_of_the_schema(spark):
    from recallgrid.schemas import DECISION

    empty = spark.range(1).select(evolution.empty_reply(DECISION).alias("r")).first().r
    assert empty.should_evolve is False and empty.new_tags_neighborhood == []


def test_words_are_counted_in_the_full_number_of_tasks(spark):
    notes = spark.createDataFrame([("a", "x y x"), ("b", "z")], "id string, content string")
    found = evolution.frequent_terms(notes, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}" in plan
    assert sorted((r.id, r.term, r.n_seen) for r in found.collect()) == [("a", "x", 2), ("b", "z", 1)]
