import random

from pyspark.sql import functions as F

from recallgrid.operators import ledger, ordered, turns

MESSAGES = (
    "conv_id string, session_pos long, session_id string, timestamp string, msg_pos long, "
    "role string, content string"
)
STOPS = {"assistant", "Assistant", "system", "System", "model", "Model"}


def table(spark, sessions):
    """{(conv, session): [(role, content), ...]} as a messages table."""
    rows = [
        (conv, sess, f"s{sess}", "t", i, role, content)
        for (conv, sess), messages in sessions.items()
        for i, (role, content) in enumerate(messages)
    ]
    return spark.createDataFrame(rows, MESSAGES)


def by_hand(messages):
    """Message by message: openers take the next message if its role differs."""
    out, i = [], 0
    while i < len(messages):
        role, content = messages[i]
        opener = role or "user"
        if opener in STOPS:
            i += 1
            continue
        reply, reply_role, step = "", None, 1
        if i + 1 < len(messages) and (messages[i + 1][0] or "assistant") != opener:
            reply, reply_role, step = messages[i + 1][1] or "", messages[i + 1][0] or "assistant", 2
        if content:
            out.append((i, opener, reply_role if reply else None, content, reply))
        i += step
    return out


def pairs(spark, roles, **kw):
    made = turns.pair_turns(table(spark, {("c", 0): [(r, f"m{i}") for i, r in enumerate(roles)]}), **kw)
    return [(r.user_text, r.reply_text) for r in made.orderBy("turn_idx").collect()]


def test_worked_examples(spark):
    assert pairs(spark, ["system", "user", "assistant", "user", "user", "assistant"]) == [
        ("m1", "m2"), ("m3", ""), ("m4", "m5"),
    ]
    # A system message after a user message counts as the reply.
    assert pairs(spark, ["user", "system", "assistant"]) == [("m0", "m1")]
    assert pairs(spark, ["Ann", "Bob", "Ann"]) == [("m0", "m1"), ("m2", "")]
    assert pairs(spark, ["assistant", "Assistant", "ASSISTANT", "user"]) == [("m2", "m3")]


def test_missing_role_is_user_first_and_assistant_second(spark):
    assert pairs(spark, [None, None, None]) == [("m0", "m1"), ("m2", "")]


def test_empty_texts(spark):
    made = turns.pair_turns(
        table(spark, {("c", 0): [("user", ""), ("assistant", "a"), ("user", "q"), ("assistant", "")]})
    ).collect()
    assert [(r.content, r.assistant_role) for r in made] == [("User: q", None)]


def test_random_sessions_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(turns, "BUCKET", 2)
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "Ann", None]
    sessions = {
        (f"c{c}", s): [
            (rng.choice(roles), rng.choice(["", f"x{c}{s}{i}", f"y{i}"])) for i in range(rng.randint(0, 17))
        ]
        for c in range(6)
        for s in range(5)
    }
    want = []
    for c in range(6):
        idx = 0
        for s in range(5):
            for _, role, reply_role, text, reply in by_hand(sessions[(f"c{c}", s)]):
                want.append((f"c{c}", idx, s, role, reply_role, text, reply))
                idx += 1
    messages = table(spark, sessions)
    for chunk in (2, 3, 65_536):
        got = turns.pair_turns(messages, chunk).select(
            "conv_id", "turn_idx", "session_pos", "user_role", "assistant_role", "user_text", "reply_text"
        )
        assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda w: w[:2]), chunk


def test_running_sum_in_chunks(spark):
    df = spark.range(50).select(
        (F.col("id") % 3).alias("g"), F.expr("id div 3").alias("pos"), (F.col("id") % 4).alias("v")
    )
    got = {
        (r.g, r.pos): r.total
        for r in ordered.running_sum(df, ["g"], "pos", F.col("v"), "total", chunk=4).collect()
    }
    sums = {}
    for i in range(50):
        g, pos = i % 3, i // 3
        sums[(g, pos)] = sums.get((g, pos - 1), 0) + i % 4
    assert got == sums


def test_sum_before_crosses_buckets(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(10)], "g string, o long, v int")
    got = ordered.sum_before(df, ["g"], ["o"], "v", "before", bucket=3).orderBy("o")
    assert [r.before for r in got.collect()] == list(range(10))


def test_ledgers(spark):
    made = turns.pair_turns(
        table(spark, {(c, 0): [("user", "a"), ("assistant", "b"), ("user", "c")] for c in "xyz"})
    )
    done = spark.createDataFrame([("x",)], "conv_id string")
    ledger_rows = spark.createDataFrame([("y", "0_t")], "conv_id string, turn_key string")
    left = ledger.skip_processed_turns(ledger.skip_completed(made, done), ledger_rows)
    assert sorted((r.conv_id, r.turn_idx) for r in left.collect()) == [("y", 1), ("z", 0), ("z", 1)]
    shards = [
        ledger.shard_filter(spark.range(7).withColumnRenamed("id", "conv_idx"), 3, i).count()
        for i in range(3)
    ]
    assert shards == [3, 2, 2]
