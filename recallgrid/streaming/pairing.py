"""Turn pairing on a stream of messages, with keyed state per session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from recallgrid.functions.text import NON_STARTER_ROLES
from recallgrid.operators.turns import turn_text

END = "end"  # value of ``kind`` in the row that closes a session

MESSAGE = "session_id string, timestamp string, role string, content string"
PROGRESS = f"next_pos bigint, turn_no bigint, closed boolean, ahead boolean, pos bigint, {MESSAGE}"

OUTPUT = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("session_pos", T.LongType()),
        T.StructField("kind", T.StringType()),  # turn, late or closed
        T.StructField("msg_pos", T.LongType()),
        T.StructField("turn_no", T.LongType()),  # within the session
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_role", T.StringType()),
        T.StructField("assistant_role", T.StringType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("reply_text", T.StringType()),
    ]
)


MADE = Row(*OUTPUT.names)


class TurnPairing(StatefulProcessor):
    """Pairs messages of one session as they come.

    State: where reading has got to and the opener waiting for its reply, as one
    value, and the messages that arrived ahead of their turn.  What a batch
    brings is paired in memory, so only messages still ahead of a gap are
    written to state, and only those are looked up there.  A session closes with an
    ``end`` row or, after ``idle_ms`` without messages, with a timer; gaps are then
    stepped over.  What comes later for a position already passed is ``late``.
    With ``ttl_ms`` the state of a session goes that long after its last change.
    """

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None) -> None:
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS, self.ttl_ms)
        self.ahead = handle.getMapState("ahead", "pos bigint", MESSAGE, self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        at = _Reading(key, self.progress.get())
        come: dict[int, tuple] = {}
        ending = False
        for m in rows:
            if m.kind == END:
                ending = True
            elif at.closed or m.msg_pos < at.next_pos:
                at.put("late", m.msg_pos, None, m.session_id, m.timestamp, m.role, None, m.content, None)
            else:
                come[m.msg_pos] = (m.session_id, m.timestamp, m.role, m.content)
        while (message := self._next(at, come)) is not None:
            at.take(at.next_pos, message)
            at.next_pos += 1
        if ending:
            self._close(at, come)
        for pos, message in come.items():
            self.ahead.updateValue((pos,), message)
            at.ahead = True
        at.closed = at.closed or ending
        self.progress.update(at.state())
        if self.idle_ms is not None and not at.closed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(
                timer_values.getCurrentProcessingTimeInMs() + self.idle_ms
            )
        yield from at.out

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        at = _Reading(key, self.progress.get())
        if not at.closed:
            self._close(at, {})
            at.closed = True
            self.progress.update(at.state())
        yield from at.out

    def close(self) -> None:
        pass

    def _next(self, at: _Reading, come: dict[int, tuple]) -> tuple | None:
        """The message at the next position, taken from the batch or from state; the newer one counts."""
        message = come.pop(at.next_pos, None)
        if at.ahead:
            held = self.ahead.getValue((at.next_pos,))
            if held is not None:
                self.ahead.removeKey((at.next_pos,))
                at.ahead = self.ahead.exists()
                message = message or tuple(held)
        return message

    def _close(self, at: _Reading, come: dict[int, tuple]) -> None:
        if at.ahead:
            come |= {int(k[0]): tuple(v) for k, v in list(self.ahead.iterator()) if int(k[0]) not in come}
            self.ahead.clear()
            at.ahead = False
        for pos in sorted(come):
            at.take(pos, come[pos])
            at.next_pos = pos + 1
        come.clear()
        at.end()


class _Reading:
    """Where the reading of a session has got to, and the rows made on the way."""

    def __init__(self, key, state: tuple | None) -> None:
        self.key, self.out = key, []
        self.next_pos, self.turn_no, self.closed, self.ahead, *opener = state or (0, 0, False, False, None)
        self.opener = tuple(opener) if opener[0] is not None else None

    def state(self) -> tuple:
        return (self.next_pos, self.turn_no, self.closed, self.ahead, *(self.opener or [None] * 5))

    def put(self, kind: str, *fields) -> None:
        self.out.append(MADE(self.key[0], self.key[1], kind, *fields))

    def take(self, pos: int, message: tuple) -> None:
        """Read the message at ``pos``: as a reply, as an opener, or not at all."""
        session_id, timestamp, role, content = message
        if self.opener is not None:
            opener, self.opener = self.opener, None
            # A gap that was stepped over separates an opener from its reply.
            answers = opener[0] == pos - 1 and (role or "assistant") != opener[3]
            self._emit(opener, role or "assistant" if answers else None, content if answers else None)
            if answers:
                return
        if (role or "user") not in NON_STARTER_ROLES:
            self.opener = (pos, session_id, timestamp, role or "user", content)

    def end(self) -> None:
        if self.opener is not None:
            opener, self.opener = self.opener, None
            self._emit(opener, None, None)
        self.put("closed", self.next_pos, self.turn_no, None, None, None, None, None, None)

    def _emit(self, opener: tuple, role: str | None, content: str | None) -> None:
        pos, session_id, timestamp, user_role, user_text = opener
        if not user_text:
            return
        reply = content or ""
        self.put("turn", pos, self.turn_no, session_id, timestamp, user_role, role if reply else None, user_text, reply)
        self.turn_no += 1


def pair_turns_stream(messages: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Turns as their sessions go on.

    ``messages`` needs ``conv_id, session_pos, session_id, timestamp, msg_pos,
    role, content, kind``; ``kind`` is ``end`` in the row that closes a session.
    The session must use the RocksDB state store.  On closed sessions the turns
    equal those of ``operators.turns.pair_turns``, which is also the way to
    repair a session that has ``late`` rows.  Without ``ttl_ms`` a closed session
    keeps one small row of state for good; with it, what comes for a session
    after that time counts as the beginning of a new one.
    """
    keyed = messages.withColumn("conv_id", F.col("conv_id").cast("string")).groupBy(
        "conv_id", "session_pos"
    )
    made = keyed.transformWithState(
        statefulProcessor=TurnPairing(idle_ms, ttl_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None and ttl_ms is None else "ProcessingTime",
    )
    return made.withColumn(
        "content",
        F.when(F.col("kind") == "turn", turn_text(F.col("user_text"), F.col("reply_text"))),
    )
