"""Messages to turns.

A turn is a message that may open one, plus the next message of the session if
its role differs; both are used up.  Which messages are used up as replies has a
closed form: inside a run of messages that *could* pair with their successor,
every second one is a reply.  So pairing needs the position of the last message
before the current one that could not pair, which is a running maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators.ordered import BUCKET, CHUNK, before, chunk_of

KEYS = ["conv_id", "session_pos", "chunk"]


def explode_messages(dataset: DataFrame) -> DataFrame:
    """One row per message, with defaults for missing session fields."""
    sessions = dataset.select(
        "conv_id", F.posexplode("dialogs").alias("session_pos", "session")
    )
    return sessions.select(
        "conv_id",
        F.col("session_pos").cast("long").alias("session_pos"),
        F.coalesce("session.session_id", F.lit("unknown")).alias("session_id"),
        F.coalesce("session.datetime", F.lit("")).alias("timestamp"),
        F.posexplode("session.messages").alias("msg_pos", "message"),
    ).select(
        "conv_id",
        "session_pos",
        "session_id",
        "timestamp",
        F.col("msg_pos").cast("long").alias("msg_pos"),
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
    )


def can_start(role: Column) -> Column:
    return ~role.isin(*text.NON_STARTER_ROLES)


def _flagged(messages: DataFrame, chunk: int) -> DataFrame:
    """Messages by (conv, session, chunk), each with its successor.

    ``msg_pos`` must run from 0 without gaps inside a session.  The first
    message of each later chunk is also shown to the chunk before it (as a
    guest), which gives that chunk's last message its successor.
    """
    home = chunk_of("msg_pos", chunk)
    at_edge = (F.col("msg_pos") > 0) & (F.col("msg_pos") % chunk == 0)
    placed = messages.select(
        "conv_id",
        "session_pos",
        "session_id",
        "timestamp",
        "msg_pos",
        F.coalesce("role", F.lit("user")).alias("start_role"),
        F.coalesce("role", F.lit("assistant")).alias("reply_role"),
        F.coalesce("content", F.lit("")).alias("content"),
        # Made before the shuffle, so that counting turns moves no texts.
        (F.coalesce("content", F.lit("")) != "").alias("has_text"),
        F.explode(F.when(at_edge, F.array(home, home - 1)).otherwise(F.array(home))).alias("chunk"),
    ).withColumn("guest", F.col("chunk") != home)

    here = Window.partitionBy(*KEYS).orderBy("msg_pos")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    starts = can_start(F.col("start_role"))
    differs = F.coalesce(F.col("next_role") != F.col("start_role"), F.lit(False))
    return (
        placed.withColumn("next_role", F.lead("reply_role").over(here))
        .withColumn("next_content", F.lead("content").over(here))
        .withColumn("pairs", starts & differs)
        .withColumn("opens", starts & F.col("has_text"))
        .withColumn("single", F.when(~F.col("pairs"), F.col("msg_pos")))
        .withColumn("last_single", F.max("single").over(earlier))
    )


def _free(run_start: Column) -> Column:
    """Not used up as a reply: an even number of steps after the run began."""
    return (F.col("msg_pos") - run_start - 1) % 2 == 0


def _chunk_starts(flagged: DataFrame) -> DataFrame:
    """Per chunk: the last single message before it and the number of turns before it.

    Where a chunk begins inside a run of pairing messages, the turns in that
    part depend on how the run began; they are counted for both parities and
    picked once the run's start is known.
    """
    inside = F.col("last_single").isNotNull()
    even = F.col("msg_pos") % 2 == 0
    more = flagged.groupBy(*KEYS).agg(
        F.max(F.when(~F.col("guest"), F.col("single"))).alias("tail"),
        F.count_if(~F.col("guest") & F.col("opens") & inside & _free(F.col("last_single"))).alias(
            "settled"
        ),
        F.count_if(~F.col("guest") & F.col("opens") & ~inside & even).alias("if_even"),
        F.count_if(~F.col("guest") & F.col("opens") & ~inside & ~even).alias("if_odd"),
    )
    # A bucket holds whole sessions, so one placement serves all windows below.
    placed = more.withColumn("bucket", chunk_of("session_pos", BUCKET)).repartition(
        "conv_id", "bucket"
    )
    run_start = F.coalesce(
        F.max("tail").over(before(["conv_id", "bucket", "session_pos"], ["chunk"])), F.lit(-1)
    )
    sized = placed.withColumn("carry", run_start).withColumn(
        "n",
        F.col("settled")
        + F.when(F.col("carry") % 2 == 0, F.col("if_odd")).otherwise(F.col("if_even")),
    )
    totals = sized.groupBy("conv_id", "bucket").agg(F.sum("n").alias("total"))
    bases = (
        totals.withColumn("base", F.sum("total").over(before(["conv_id"], ["bucket"])))
        .filter(F.col("base").isNotNull())
        .drop("total")
    )
    inner = F.sum("n").over(before(["conv_id", "bucket"], ["session_pos", "chunk"]))
    return (
        sized.withColumn("inner", inner)
        .join(bases, ["conv_id", "bucket"], "left")
        .select(
            *KEYS,
            "carry",
            (F.coalesce("inner", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("offset"),
        )
    )


def pair_turns(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Turns of every conversation, numbered from 0 across its sessions.

    Texts are shuffled once, by (conversation, session, chunk); roles and flags a
    second time, for counting.  What crosses chunk borders travels as one small
    row per chunk.
    """
    flagged = _flagged(messages, chunk)
    local = F.row_number().over(Window.partitionBy(*KEYS).orderBy("msg_pos")) - 1
    reply = F.when(F.col("pairs"), F.col("next_content")).otherwise(F.lit(""))
    return (
        flagged.filter(~F.col("guest") & F.col("opens"))
        .join(_chunk_starts(flagged), KEYS)
        .filter(_free(F.coalesce("last_single", "carry")))
        .withColumn("turn_idx", (F.col("offset") + local).cast("long"))
        .select(
            "conv_id",
            "turn_idx",
            "session_pos",
            "session_id",
            "timestamp",
            F.col("start_role").alias("user_role"),
            F.when(reply != "", F.col("next_role")).alias("assistant_role"),
            F.col("content").alias("user_text"),
            reply.alias("reply_text"),
            turn_text(F.col("content"), reply).alias("content"),
        )
    )


def turn_text(user, reply):
    """The note text of a turn; the reply line appears only if there is one."""
    opening = F.concat(F.lit("User: "), user)
    return F.when(reply != "", F.concat(opening, F.lit("\nAssistant: "), reply)).otherwise(opening)


def turn_tags(conv, session):
    return F.array(
        F.concat(F.lit("conv_"), conv.cast("string")), F.concat(F.lit("session_"), session)
    )


def conversations_without_turns(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Report of conversations that gave no turn."""
    return conversations.select("conv_id").join(
        turns.select("conv_id").distinct(), "conv_id", "left_anti"
    )
