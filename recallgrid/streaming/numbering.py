"""Conversation-wide turn numbers for turns that are paired session by session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

FIELDS = ["session_id", "timestamp", "user_role", "assistant_role", "user_text", "reply_text", "content"]
TURN = ", ".join(f"{f} string" for f in FIELDS)
OUTPUT = f"conv_id string, kind string, turn_idx long, session_pos long, {TURN}"
MADE = Row("conv_id", "kind", "turn_idx", "session_pos", *FIELDS)


class SessionChain(StatefulProcessor):
    """Chains the sessions of a conversation in order.

    State: the session that is being numbered and the turns before it; the
    lengths of later sessions that have closed; and turns of later sessions,
    which leave as soon as all sessions before theirs have closed.  What a batch
    brings is chained in memory, and only what has to wait is written to state.
    """

    def init(self, handle) -> None:
        self.progress = handle.getValueState("progress", "session bigint, turns bigint, lengths boolean, held boolean")
        self.lengths = handle.getMapState("lengths", "session bigint", "turns bigint")
        self.held = handle.getMapState("held", "session bigint, turn bigint", TURN)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        session, before, *kept = self.progress.get() or (0, 0, False, False)
        some = dict(zip(("lengths", "held"), kept))  # which states hold anything
        lengths: dict[tuple, tuple] = {}
        held: dict[tuple, tuple] = {}

        def taken(name: str, come: dict[tuple, tuple], at: tuple) -> tuple | None:
            """What waits under a key, from the batch or from state; the newer one counts."""
            value, state = come.pop(at, None), getattr(self, name)
            if some[name]:
                old = state.getValue(at)
                if old is not None:
                    state.removeKey(at)
                    value = value or tuple(old)
            return value

        for m in rows:
            if m.kind == "closed":
                if m.session_pos >= session:
                    lengths[(m.session_pos,)] = (m.turn_no,)
            elif m.kind == "turn":
                fields = tuple(m[f] for f in FIELDS)
                if m.session_pos == session:
                    yield MADE(key[0], "turn", before + m.turn_no, session, *fields)
                elif m.session_pos > session:
                    held[(m.session_pos, m.turn_no)] = fields
        while (length := taken("lengths", lengths, (session,))) is not None:
            yield MADE(key[0], "closed", before + length[0], session, *[None] * len(FIELDS))
            session, before = session + 1, before + length[0]
            number = 0
            while (fields := taken("held", held, (session, number))) is not None:
                yield MADE(key[0], "turn", before + number, session, *fields)
                number += 1
        for name, come in (("lengths", lengths), ("held", held)):
            state = getattr(self, name)
            for at, value in come.items():
                state.updateValue(at, value)
            some[name] = bool(come) or (some[name] and state.exists())
        self.progress.update((session, before, some["lengths"], some["held"]))

    def close(self) -> None:
        pass


def number_turns_stream(paired: DataFrame) -> DataFrame:
    """Turns of ``pair_turns_stream`` with ``turn_idx``, numbered from 0 across the sessions of a conversation.

    Sessions are numbered from 0 without gaps, and each must be closed for the
    next one's turns to come out, also one without messages.  A row of kind
    ``closed`` follows the last turn of a session; its ``turn_idx`` is the number
    of turns so far.  ``late`` rows of the input have no number and are left out.
    On closed conversations the result equals ``operators.turns.pair_turns``.
    """
    keyed = paired.select("conv_id", "session_pos", "kind", "turn_no", *FIELDS).groupBy("conv_id")
    return keyed.transformWithState(
        statefulProcessor=SessionChain(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
