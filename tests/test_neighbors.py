import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions.vectors import distance, embed, letter_counts, letter_encoder
from recallgrid.operators import neighbors
from recallgrid.operators.neighbors import asof_neighbors, retrieve_topk

SCHEMA = "conv_id string, seq long, embedding array<float>"


def vectors(n, dim=5, seed=1):
    return np.random.default_rng(seed).integers(-2, 3, size=(n, dim)).astype(float)


def measure(a, b, metric):
    if metric == "l2sq":
        d = ((a - b) ** 2).sum()
    elif metric == "ip":
        d = 1 - a @ b
    else:
        norms = np.sqrt(a @ a) * np.sqrt(b @ b)
        d = 1 - a @ b / norms if norms > 0 else 1.0
    return round(float(d), 6) + 0.0


def table(spark, groups):
    rows = [(g, i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("block", [3, 1_024])
def test_topk_equals_brute_force(spark, metric, block):
    notes = {"a": vectors(23), "b": vectors(4, seed=2), "lonely": vectors(1, seed=3)}
    asked = {"a": vectors(8, seed=4), "b": vectors(2, seed=5), "nowhere": vectors(2, seed=6)}
    got = retrieve_topk(
        table(spark, asked).withColumnRenamed("seq", "q_idx"), table(spark, notes), 5,
        metric=metric, block=block,
    ).collect()
    want = []
    for g in ("a", "b"):
        for q, v in enumerate(asked[g]):
            best = sorted((measure(v, n, metric), i) for i, n in enumerate(notes[g]))[:5]
            want += [(g, q, i, d, r) for r, (d, i) in enumerate(best, 1)]
    assert sorted((r.conv_id, r.q_idx, r.seq, r.distance, r["rank"]) for r in got) == sorted(want)
    assert all(r.score == pytest.approx(1 - r.distance) for r in got)


@pytest.mark.parametrize("block", [4, 1_024])
def test_asof_sees_only_earlier_notes(spark, block):
    groups = {"a": vectors(19), "b": vectors(3, seed=8)}
    got = asof_neighbors(table(spark, groups), 3, block=block).collect()
    want = []
    for g, vs in groups.items():
        for i, v in enumerate(vs):
            best = sorted((measure(v, vs[j], "l2sq"), j) for j in range(i))[:3]
            want += [(g, i, j, d, r) for r, (d, j) in enumerate(best)]
    assert sorted((r.conv_id, r.seq, r.neighbor_seq, r.distance, r.neighbor_idx) for r in got) == sorted(want)


def test_many_equal_copies_give_k_rows(spark):
    same = np.ones((50, 3))
    got = retrieve_topk(
        table(spark, {"a": same[:2]}).withColumnRenamed("seq", "q_idx"), table(spark, {"a": same}), 4, block=8
    ).collect()
    assert sorted((r.q_idx, r.seq) for r in got) == [(q, s) for q in (0, 1) for s in range(4)]


def test_rank_limit_is_applied_before_the_shuffle(spark):
    notes = table(spark, {"a": vectors(5)})
    df = retrieve_topk(notes.withColumnRenamed("seq", "q_idx"), notes, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nulls_and_ragged_vectors(spark):
    notes = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, None)], SCHEMA)
    assert retrieve_topk(notes.withColumnRenamed("seq", "q_idx"), notes, 3).count() == 1
    bad = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [1.0, 2.0, 3.0])], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        retrieve_topk(bad.withColumnRenamed("seq", "q_idx"), bad, 3).count()
    with pytest.raises(ValueError):
        retrieve_topk(notes, notes, 3, metric="other")


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_column_distance_agrees(spark, metric):
    a, b = vectors(2, seed=11)
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<float>, b array<float>")
    assert row.select(distance(F.col("a"), F.col("b"), metric).alias("d")).first().d == measure(a, b, metric)


def test_encoders(spark):
    df = spark.createDataFrame([("Abba",), ("",), (None,)], "content string")
    counts = [r.v[:2] for r in df.select(letter_counts(F.col("content")).alias("v")).collect()]
    assert counts == [[2.0, 2.0], [0.0, 0.0], [0.0, 0.0]]

    encoded = [r.embedding for r in embed(df, letter_encoder).collect()]
    assert encoded == [r.v for r in df.select(letter_counts(F.col("content")).alias("v")).collect()]

    def lengths(batches):
        for texts in batches:
            yield texts.map(lambda t: [float(len(t or ""))])

    assert [r.embedding for r in embed(df, lengths).collect()] == [[4.0], [0.0], [0.0]]


def test_repeated_keys_are_an_error(spark):
    rows = [("a", 0, [1.0, float(i)]) for i in range(40)]
    notes = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="unique"):
        retrieve_topk(notes.withColumnRenamed("seq", "q_idx"), notes, 3, block=4).count()


@pytest.mark.parametrize("block", [4, 1_024])
def test_sparse_keys_and_one_row_per_tile_pair(spark, block):
    vs = vectors(30, seed=21)
    keys = [7 * i * i + 10**9 for i in range(30)]
    notes = spark.createDataFrame([("a", k, [float(x) for x in v]) for k, v in zip(keys, vs)], SCHEMA)
    got = asof_neighbors(notes, 3, block=block).collect()
    want = []
    for i, v in enumerate(vs):
        best = sorted((measure(v, vs[j], "l2sq"), keys[j]) for j in range(i))[:3]
        want += [(keys[i], j, d) for d, j in best]
    assert sorted((r.seq, r.neighbor_seq, r.distance) for r in got) == sorted(want)


def test_rows_are_sent_once_for_every_tile_of_the_other_side(spark):
    def sides(n):
        rows = spark.createDataFrame([("a", i, [float(i)]) for i in range(n)], "g string, key long, vec array<float>")
        return rows, rows

    dealt = neighbors.deal(*sides(64), ["g"], 16)
    assert dealt.count() == 2 * 64 * 4 and dealt.select("tile_q", "tile_i").distinct().count() == 16
    earlier = neighbors.deal(*sides(64), ["g"], 16, ordered=True)
    assert earlier.count() == 2 * 16 * (4 + 3 + 2 + 1)
    assert neighbors.deal(*sides(10), ["g"], 16).count() == 20


def test_best_partners_of_both_sides_in_one_search(spark):
    a, b = vectors(9, seed=31), vectors(7, seed=32)
    rows = [("x", "p", i, [float(c) for c in v]) for i, v in enumerate(a)] + [("x", "r", i, [float(c) for c in v]) for i, v in enumerate(b)]
    rows += [("alone", "p", 0, [1.0, 0.0, 0.0, 0.0, 0.0])]
    tokens = spark.createDataFrame(rows, "row_id string, side string, tok long, embedding array<float>")
    for block in (2, 1_024):
        found = neighbors.best_partners(tokens, "row_id", block)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = {(r.side, r.tok): r.distance for r in found.collect()}
        want = {("p", i): min(measure(v, w, "cosine") for w in b) for i, v in enumerate(a)}
        want |= {("r", i): min(measure(v, w, "cosine") for v in a) for i, w in enumerate(b)}
        assert got == want
