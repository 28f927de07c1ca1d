import os

import pytest
from pyspark.sql import functions as F

from recallgrid.functions.vectors import letter_counts
from recallgrid.operators import notes as notes_ops
from recallgrid.sources.collections import Collection, CollectionExists, open_collection

SCHEMA = "conv_id string, seq long, content string, category string"


@pytest.fixture
def made(spark, tmp_path):
    rows = [(f"c{c}", i, f"text {c} {i}", "old") for c in range(12) for i in range(3)]
    notes = notes_ops.note_defaults(spark.createDataFrame(rows, SCHEMA))
    collection = open_collection(spark, str(tmp_path / "notes"), partitions=32)
    collection.add(notes.withColumn("embedding", letter_counts(F.col("content"))))
    return collection


def files(collection):
    found = {}
    for folder, _, names in os.walk(collection.path):
        for name in names:
            if name.endswith(".parquet"):
                found[os.path.join(folder, name)] = os.path.getmtime(os.path.join(folder, name))
    return found


def ids(collection, *conversations):
    rows = collection.read().filter(F.col("conv_id").isin(*conversations)).select("id", "conv_id")
    return collection.spark.createDataFrame([tuple(r) for r in rows.collect()], "id string, conv_id string")


def snapshot(collection):
    return {r.id: r.asDict() for r in collection.read().collect()}


def unchanged_elsewhere(collection, before, after, touched):
    places = tuple(f"{os.sep}bucket={b}{os.sep}" for b in touched)
    other = {f: t for f, t in before.items() if not any(p in f for p in places)}
    assert other and other == {f: t for f, t in after.items() if not any(p in f for p in places)}


@pytest.mark.parametrize("hint", [True, False])
def test_update_rewrites_only_touched_folders(made, hint):
    old, before = snapshot(made), files(made)
    wanted = ids(made, "c1", "c4")
    changes = wanted.withColumn("content", F.concat("id", F.lit(" zz"))).withColumn("category", F.lit(None).cast("string"))
    touched = made.update(changes if hint else changes.drop("conv_id"), letter_counts)
    assert touched == made.buckets_of(wanted)
    unchanged_elsewhere(made, before, files(made), touched)
    new, changed = snapshot(made), {r.id for r in wanted.collect()}
    assert set(new) == set(old)
    for i, row in new.items():
        if i in changed:
            assert row["content"] == f"{i} zz" and row["category"] == "old" and row["embedding"][25] == 2.0
            assert row | {"content": 0, "embedding": 0} == old[i] | {"content": 0, "embedding": 0}
        else:
            assert row == old[i]
    made.update(changes, letter_counts)  # a repeated job changes nothing
    assert snapshot(made) == new
    assert made.update(made.spark.createDataFrame([("nobody", "x")], "id string, content string")) == []


def test_delete_may_empty_a_folder(made):
    old, before = snapshot(made), files(made)
    gone = ids(made, "c2", "c7")
    touched = made.delete(gone)
    unchanged_elsewhere(made, before, files(made), touched)
    assert set(snapshot(made)) == {i for i, r in old.items() if r["conv_id"] not in ("c2", "c7")}
    assert made.conversation("c2").count() == 0 and made.conversation("c3").count() == 3
    assert made.delete(gone) == []
    made.delete(made.read().select("id"))
    assert made.read().count() == 0 and made.exists()
    with pytest.raises(CollectionExists):
        open_collection(made.spark, made.path)
    # What was deleted can be added again.
    again = made.spark.createDataFrame([("c2", 0, "text 2 0", "old")], SCHEMA)
    made.add(notes_ops.note_defaults(again).withColumn("embedding", letter_counts(F.col("content"))))
    assert [r.content for r in made.conversation("c2").collect()] == ["text 2 0"]
    assert made.snapshot(made.path + "-copy").read().count() == 1


def test_consolidate_applies_a_log_and_joins_small_files(made):
    base = [r.id for r in ids(made, "c5").collect()]
    for i in range(3, 9):
        more = made.spark.createDataFrame([("c5", i, f"more {i}", "old")], SCHEMA)
        made.add(notes_ops.note_defaults(more).withColumn("embedding", letter_counts(F.col("content"))))
    log = [(base[0], 1, "first", None), (base[0], 2, None, "late"), (base[1], 1, "one", "two"), (base[1], 3, "three", None)]
    before = files(made)
    touched = made.consolidate(made.spark.createDataFrame(log, "id string, version int, context string, category string"))
    after = files(made)
    unchanged_elsewhere(made, before, after, touched)
    new = snapshot(made)
    assert (new[base[0]]["context"], new[base[0]]["category"]) == ("first", "late")
    assert (new[base[1]]["context"], new[base[1]]["category"]) == ("three", "two")
    assert sum(r["conv_id"] == "c5" for r in new.values()) == 9
    own = f"bucket={touched[0]}{os.sep}"
    assert len(touched) == 1 and sum(own in f for f in after) < sum(own in f for f in before)


def test_appends_read_only_keys_of_their_folders(made):
    new = notes_ops.note_defaults(made.spark.createDataFrame([("c9", 7, "late", "x"), ("c9", 7, "later", "x")], SCHEMA))
    new = new.withColumn("embedding", letter_counts(F.col("content")))
    assert made.add(new, key=("conv_id", "seq")) == made.buckets_of(new)
    assert [r.content for r in made.conversation("c9").filter("seq = 7").collect()] == ["later"]
    made.add(new.filter("content = 'late'"), key=("conv_id", "seq"))
    assert made.conversation("c9").filter("seq = 7").count() == 1


def test_collections_of_one_folder_and_missing_paths(spark, tmp_path):
    single = Collection(spark, str(tmp_path / "one"), 1)
    assert not single.exists()
    single.create(notes_ops.note_defaults(spark.createDataFrame([], SCHEMA)))
    assert single.exists() and single.read().count() == 0
