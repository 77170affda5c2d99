"""Sessions as a stream whose events come in any order: the batch rollup, kept in states that leave by event-time timers.

A session's counters are one state; events that came before its first prompt is known, or lie before it, wait in a map by their
seq. A start that turns out to be earlier takes in those that wait behind it, so any order of arrival gives what rollup() gives. Once a
session has ended, or nothing has come for a while, a timer of event time lets its states go; events older than the watermark no
longer count. A stream can begin with the states of a batch rollup.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import mask, session_file, session_title
from .sessions import recorded

SUMS = ("prompts", "turns", "commands", "edits")
_STATE = "first_seq long, title string, started timestamp, ended timestamp, newest timestamp, prompts long, turns long, commands long, edits long"
_OUT = "session_id string, title string, started timestamp, ended timestamp, prompts long, turns long, commands long, edits long"
_FLAT = (
    "first_seq long, title string, started long, ended long, newest long, prompts long, turns long, commands long, edits long, "
    "waiting array<struct<seq: long, prompts: long, turns: long, commands: long, edits: long, title: string, ts: long, ends: boolean>>"
)
_EPOCH = dt.datetime(1970, 1, 1)
_EVENT = "prompts long, turns long, commands long, edits long, title string, ts timestamp, ends boolean"


def _time(x) -> dt.datetime | None:
    return None if x is None or pd.isna(x) else pd.Timestamp(x).to_pydatetime()


def taken(state: tuple | None, frames: Iterator[pd.DataFrame], waiting: Callable[[], dict[int, tuple]]) -> tuple[tuple, dict[int, tuple], list[int]]:
    """A session's state after events, the events (by seq) that wait from now on, and the seqs of those that no longer do."""
    first, title, started, ended, newest, *sums = state or (None, None, None, None, None, 0, 0, 0, 0)
    begins: list[tuple[int, str, dt.datetime]] = []
    held: dict[int, tuple] = {}  # behind the first prompt, or before it is known
    for frame in frames:
        for r in frame.itertuples(index=False):
            seq, ts = int(r.seq), _time(r.ts)
            newest = ts if newest is None else max(newest, ts)
            held[seq] = (*[int(getattr(r, c)) for c in SUMS], r.title, ts, bool(r.ends))
            if r.prompts == 1:
                begins.append((seq, r.title, ts))
    added, removed = {}, []
    earliest = min(begins, default=None, key=lambda b: b[0])
    if earliest and (first is None or earliest[0] < first):
        before, (first, title, started) = first, earliest
        # what waits from the new start on counts now; what the old start took in has counted
        for seq, event in waiting().items():
            if seq >= first and (before is None or seq < before):
                held.setdefault(seq, event)
                removed.append(seq)
    for seq, event in held.items():
        if first is None or seq < first:
            added[seq] = event
        else:
            sums = [a + b for a, b in zip(sums, event, strict=False)]
            if event[6]:
                ended = event[5] if ended is None else max(ended, event[5])
    return (first, title, started, ended, newest, *sums), added, removed


def _row(key: tuple, state: tuple) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *state[1:4], *state[5:])], columns=["session_id", "title", "started", "ended", *SUMS])


def _ms(newest: dt.datetime, wait: dt.timedelta) -> int:
    at = newest + wait
    return int((at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at).timestamp() * 1000)


def _us(t: dt.datetime | None) -> int | None:
    return None if t is None else (t - _EPOCH) // dt.timedelta(microseconds=1)


def _at(us: int | None) -> dt.datetime | None:
    return None if us is None else _EPOCH + dt.timedelta(microseconds=us)


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ended: dt.timedelta, idle: dt.timedelta) -> Iterator[pd.DataFrame]:
    """As Sessions, but a session's state comes and goes with its events, in batches of many sessions; its timer is the state's timeout."""
    if state.hasTimedOut:
        state.remove()
        return
    before, waiting = None, {}
    if state.exists:
        first, title, *times, p, t, c, e, held = state.get
        before = (first, title, *map(_at, times), p, t, c, e)
        waiting = {x[0]: (*x[1:6], _at(x[6]), x[7]) for x in held}
    after, added, removed = taken(before, frames, lambda: waiting)
    for seq in removed:
        del waiting[seq]
    waiting |= added
    state.update((*after[:2], *map(_us, after[2:5]), *after[5:], [(seq, *x[:5], _us(x[5]), x[6]) for seq, x in waiting.items()]))
    state.setTimeoutTimestamp(max(_ms(after[4], ended if after[3] is not None else idle), state.getCurrentWatermarkMs() + 1))
    if after[0] is not None:
        yield _row(key, after)


class Sessions(StatefulProcessor):
    def __init__(self, ended_s: int, idle_s: int):
        self.ended, self.idle = dt.timedelta(seconds=ended_s), dt.timedelta(seconds=idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)
        self.waiting = handle.getMapState("waiting", "seq long", _EVENT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        ended, started = _time(r["ended"]), _time(r["started"])
        self.state.update((int(r["first_seq"]), r["title"], started, ended, ended or started, *[int(r[c]) for c in SUMS]))
        self._wake(ended or started, ended is not None)

    def _wake(self, newest: dt.datetime, ended: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_ms(newest, self.ended if ended else self.idle))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        after, added, removed = taken(before, rows, lambda: {int(seq): tuple(event) for (seq,), event in self.waiting.iterator()})
        for seq in removed:
            self.waiting.removeKey((seq,))
        for seq, event in added.items():
            self.waiting.updateValue((seq,), event)
        self._wake(after[4], after[3] is not None)
        if after[0] is None:
            return
        self.state.update(after)
        yield _row(key, after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_states(rollup: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of sessions.rollup() as states to begin with; firsts (session_id, first_seq): where each begins."""
    return rollup.join(firsts, "session_id").select("session_id", "first_seq", "title", "started", "ended", *SUMS)


def stream(events: DataFrame, late: str = "1 hour", ended_s: int = 3600, idle_s: int = 86_400, begin: DataFrame | None = None) -> DataFrame:
    """The rollup of a stream of events in any order, in update mode.

    late: how far events may lag behind the newest; a session's states leave ended_s after its end, or idle_s after its newest event,
    by event time. begin: first_states() of what came before; only this needs the RocksDB state store, and calls it for each session,
    since the other operator can't begin with states. Without it every batch looks through all states for those that are due.
    """
    title = session_title(mask(F.coalesce("prompt", F.lit(""))))
    ends = F.col("hook_event_name") == "SessionEnd"
    e = recorded(events).select("session_id", "seq", "ts", title.alias("title"), ends.alias("ends"), *SUMS).withWatermark("ts", late)
    sessions = e.groupBy("session_id")
    if begin is not None:
        out = sessions.transformWithStateInPandas(Sessions(ended_s, idle_s), _OUT, "Update", "EventTime", initialState=begin.groupBy("session_id"))
    else:
        waits = dt.timedelta(seconds=ended_s), dt.timedelta(seconds=idle_s)

        def call(key, frames, state):
            yield from advance(key, frames, state, *waits)

        out = sessions.applyInPandasWithState(call, _OUT, _FLAT, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("session_id", session_file(F.col("started"), F.col("session_id"), F.col("title")).alias("file"), "title", "started", "ended", *SUMS)
