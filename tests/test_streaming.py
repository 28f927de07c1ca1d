import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from recallgrid.functions.vectors import letter_counts
from recallgrid.operators import ledger, neighbors, turns
from recallgrid.operators import notes as notes_ops
from recallgrid.sources.collections import Collection
from recallgrid.streaming import counting, ingest, numbering, pairing, sessions

TURN = "conv_id string, turn_idx long, session_id string, timestamp string, content string"
MESSAGE = (
    "conv_id string, session_pos long, session_id string, timestamp string, msg_pos long, "
    "role string, content string, kind string"
)


def rows(*keys):
    return [(c, i, "s", "t", f"text {c}{i}" + "ab" * i) for c, i in keys]


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_ingest_resumes_and_stores_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    made = Collection(spark, out, 8)
    seen = []

    def after(notes, batch_id):
        near = ingest.batch_neighbors(notes, made, batch_id, 2)
        seen.extend((r.conv_id, r.seq, r.neighbor_seq, r.distance) for r in near.collect())

    def run():
        finish(ingest.ingest_turns(spark.readStream.schema(TURN).json(source), made, check, letter_counts, after))

    spark.createDataFrame(rows(("a", 0), ("b", 0), ("a", 1)), TURN).coalesce(1).write.mode("append").json(source)
    run()
    spark.createDataFrame(rows(("a", 1), ("a", 2), ("b", 1)), TURN).coalesce(1).write.mode("append").json(source)
    run()
    run()  # nothing new
    stored = made.read()
    assert sorted((r.conv_id, r.seq, r.batch) for r in stored.collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0), ("b", 1, 1)]
    whole = neighbors.asof_neighbors(stored, 2)
    assert sorted(seen) == sorted((r.conv_id, r.seq, r.neighbor_seq, r.distance) for r in whole.collect())


def test_replays_complete_what_was_written(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "out"), 8)
    batch = spark.createDataFrame(rows(("a", 0), ("a", 1), ("b", 0)), TURN)
    ingest.add_turns(batch.filter("conv_id = 'a'"), made, 0)  # the part that was written before it broke off
    again = ingest.add_turns(batch, made, 0)
    assert sorted((r.conv_id, r.seq) for r in again.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    ids = {r.id for r in made.read().collect()}
    later = ingest.add_turns(batch.union(batch), made, 3)
    assert later.count() == 0 and {r.id for r in made.read().collect()} == ids
    # A changed text under a known key is the same turn.
    assert ingest.add_turns(batch.withColumn("content", F.lit("other")), made, 4).count() == 0
    ingest.write_batch(batch, str(tmp_path / "near"), 0)
    ingest.write_batch(batch, str(tmp_path / "near"), 0)
    assert spark.read.parquet(str(tmp_path / "near")).count() == 3


def test_a_batch_reads_only_its_own_folders(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "out"), 64)
    ingest.add_turns(spark.createDataFrame(rows(*[(f"c{i}", 0) for i in range(40)]), TURN), made, 0, letter_counts)
    new = ingest.add_turns(spark.createDataFrame(rows(("c3", 1)), TURN), made, 1, letter_counts)
    assert [(r.conv_id, r.seq) for r in new.collect()] == [("c3", 1)]
    near = ingest.batch_neighbors(new, made, 1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    own = made.buckets_of(new)
    assert len(own) == 1
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [" in line and f" = {own[0]})" in line for line in scans)
    assert [(r.seq, r.neighbor_seq) for r in near.collect()] == [(1, 0)]


def test_the_stream_of_turns_keeps_no_state(spark, tmp_path):
    source, made = str(tmp_path / "in"), Collection(spark, str(tmp_path / "out"), 8)
    for part in range(3):
        spark.createDataFrame(rows(*[("a", 5 * part + i) for i in range(5)]), TURN).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).json(source)
    query = ingest.ingest_turns(stream, made, str(tmp_path / "check"))
    finish(query)
    assert made.read().count() == 15
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert not (tmp_path / "check" / "state").exists()


def test_running_counts_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(1)
    flags = [(f"c{c}", i, rng.choice([True, False, None])) for c in range(3) for i in range(rng.randint(1, 30))]
    schema = "conv_id string, seq long, should_evolve boolean"
    mixed = rng.sample(flags, len(flags))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    states = []
    for part in (mixed[0::2], mixed[1::2] + mixed[:4]):  # some come once more
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        points = counting.consolidation_points_stream(spark.readStream.schema(schema).json(source), 3)
        query = (
            points.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
            .outputMode("append").trigger(availableNow=True).start()
        )
        finish(query)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    whole = notes_ops.consolidation_points(spark.createDataFrame(flags, schema), 3)
    got = spark.read.schema("conv_id string, seq long, evolved_count long").parquet(out).collect()
    assert sorted((r.conv_id, r.seq, r.evolved_count) for r in got) == sorted((r.conv_id, r.seq, r.evolved_count) for r in whole.collect())
    assert states[-1] <= 3 * 2  # nothing but each conversation's count is left


def numbered(spark, source, out, check, ttl_ms=None):
    stream = spark.readStream.schema(MESSAGE).json(source)
    made = numbering.number_turns_stream(pairing.pair_turns_stream(stream, ttl_ms=ttl_ms))
    finish(
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .outputMode("append").trigger(availableNow=True).start()
    )


def test_streamed_numbers_equal_the_batch_job(spark, tmp_path, ttl_ms=3_600_000):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "Ann", None]
    sessions_of = {
        (f"c{c}", s): [(rng.choice(roles), rng.choice(["", f"m{s}{i}", f"n{i}"])) for i in range(rng.randint(1, 9))]
        for c in range(3) for s in range(4)
    }
    messages = [(c, s, f"s{s}", "t", i, role, text, "message") for (c, s), said in sessions_of.items() for i, (role, text) in enumerate(said)]
    ends = [(c, s, None, None, None, None, None, pairing.END) for c, s in sessions_of]
    later, first = rng.sample(messages, len(messages)), [e for e in ends if e[1] in (1, 3)]  # some sessions end before those ahead of them
    own = sessions.streaming_session(spark, 2)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (later[::2], later[1::2] + first, [e for e in ends if e not in first]):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").json(source)
        numbered(own, source, out, check, ttl_ms)
    made = spark.read.parquet(out)
    batch = turns.pair_turns(spark.createDataFrame(messages, MESSAGE))
    fields = ["conv_id", "turn_idx", "session_pos", "session_id", "timestamp", "user_role", "assistant_role", "user_text", "reply_text", "content"]
    streamed = made.filter("kind = 'turn'").select(*fields)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.select(*fields).collect()))
    totals = {r.conv_id: r["count"] for r in batch.groupBy("conv_id").count().collect()}
    closed = made.filter("kind = 'closed'").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn_idx").alias("turns"))
    assert {r.conv_id: (r.n, r.turns) for r in closed.collect()} == {c: (4, totals.get(c, 0)) for c in ("c0", "c1", "c2")}
    # Streamed notes have the ids of the batch job, so its ledgers hold for both.
    notes = notes_ops.notes_from_turns(streamed)
    assert {r.id for r in notes.collect()} == {r.id for r in notes_ops.notes_from_turns(batch).collect()}
    done = ledger.completed_of(batch, ledger.ledger_of(batch, notes))
    assert {r.conv_id for r in done.collect()} == set(totals)


def test_streamed_pairing_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "Ann", None]
    sessions = {
        (f"c{c}", s): [(rng.choice(roles), rng.choice(["", f"m{i}", f"n{i}"])) for i in range(rng.randint(1, 9))]
        for c in range(3) for s in range(2)
    }
    messages = [
        (c, s, f"s{s}", "t", i, role, text, "message")
        for (c, s), said in sessions.items() for i, (role, text) in enumerate(said)
    ]
    first = [m for m in messages if m[4] % 3 != 1]  # leaves gaps that are filled later
    second = [m for m in messages if m[4] % 3 == 1]
    third = [(c, s, None, None, None, None, None, pairing.END) for c, s in sessions]
    late = [("c0", 0, "s0", "t", 0, "user", "again", "message")]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (first, second, third, late):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(MESSAGE).json(source)
        query = (
            pairing.pair_turns_stream(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    made = spark.read.parquet(out)
    batch = turns.pair_turns(spark.createDataFrame(messages, MESSAGE))
    fields = ["conv_id", "session_pos", "user_role", "assistant_role", "user_text", "reply_text", "content"]
    got = sorted(map(str, made.filter("kind = 'turn'").select(*fields).collect()))
    assert got == sorted(map(str, batch.select(*fields).collect()))
    assert made.filter("kind = 'closed'").count() == len(sessions)
    assert [r.user_text for r in made.filter("kind = 'late'").collect()] == ["again"]


class Kept:
    """A value or map of keyed state in memory; ``calls`` counts what is asked of it."""

    def __init__(self):
        self.value, self.items, self.calls = None, {}, 0

    def __getattribute__(self, name):
        if name in ("get", "update", "exists", "getValue", "updateValue", "removeKey", "iterator", "clear"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def exists(self):
        return bool(self.items)

    def getValue(self, key):
        return self.items.get(key)

    def updateValue(self, key, value):
        self.items[key] = value

    def removeKey(self, key):
        del self.items[key]

    def iterator(self):
        return iter(list(self.items.items()))

    def clear(self):
        self.items.clear()


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState

    def calls(self):
        return sum(s.calls for s in self.states.values())


def test_what_a_batch_brings_in_order_is_not_written_to_state():
    said = Row("msg_pos", "session_id", "timestamp", "role", "content", "kind")
    messages = [said(i, "s", "t", "user" if i % 2 == 0 else "assistant", f"m{i}", "message") for i in range(100)]
    handle, pair = Handle(), pairing.TurnPairing()
    pair.init(handle)
    made = list(pair.handleInputRows(("c", 0), iter(messages[3:] + messages[:2]), None))
    assert len(made) == 1 and len(handle.states["ahead"].items) == 97
    made += pair.handleInputRows(("c", 0), iter(messages[2:3]), None)
    assert [r.turn_no for r in made] == list(range(50)) and not handle.states["ahead"].items
    handle, pair = Handle(), pairing.TurnPairing()
    pair.init(handle)
    assert len(list(pair.handleInputRows(("c", 0), iter(messages), None))) == 50
    assert handle.calls() <= 3
    turn = Row("kind", "session_pos", "turn_no", *numbering.FIELDS)
    texts = [None] * len(numbering.FIELDS)
    rows = [turn("turn", s, i, *texts) for s in (1, 0) for i in range(20)] + [turn("closed", s, 20, *texts) for s in (1, 0)]
    handle, chain = Handle(), numbering.SessionChain()
    chain.init(handle)
    made = list(chain.handleInputRows(("c",), iter(rows), None))
    assert sorted(r.turn_idx for r in made if r.kind == "turn") == list(range(40))
    assert handle.calls() <= 3
