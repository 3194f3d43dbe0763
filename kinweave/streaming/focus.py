"""What a session is talking about, kept as state while its turns arrive."""
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from kinweave import settings as S

OUT = "session string, turn int, focus_code string, focus_name string, n_focus int, n_results int"
STATE = "stack string"


def _merge(summary, kind, code, name, ord_):
    """Summary of a turn: top name, first result, how many of each. Rows may come in any order and batch."""
    named, listed, n_named, n_listed = summary
    if kind == "user_mention":
        return max(named, [ord_, code, name]) if named else [ord_, code, name], listed, n_named + 1, n_listed
    return named, min(listed, [ord_, code, name]) if listed else [ord_, code, name], n_named, n_listed + 1


def _walk(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turns = {int(t): tuple(v) for t, v in json.loads(state.get[0]).items()} if state.exists else {}
    touched, seen_ms = set(), state.getCurrentWatermarkMs()
    for pdf in batches:
        seen_ms = max(seen_ms, int(pdf["ts"].max().timestamp() * 1000))
        for turn, kind, code, name, ord_ in pdf[["turn", "kind", "code", "name", "ord"]].itertuples(index=False, name=None):
            turns[int(turn)] = _merge(turns.get(int(turn), (None, None, 0, 0)), kind, code, name, int(ord_))
            touched.add(int(turn))
    out = []
    for turn in sorted(touched):
        near = [turns[t] for t in range(turn - S.FOCUS_TURNS, turn + 1) if t in turns]
        named, listed = [x[0] for x in near if x[0]], [x[1] for x in near if x[1]]
        top = named[-1] if named else listed[0] if listed else [0, None, None]
        out.append((key[0], turn, top[1], top[2], sum(x[2] + x[3] for x in near), turns[turn][3]))
    last = max(turns)
    state.update((json.dumps({t: v for t, v in turns.items() if t >= last - S.FOCUS_TURNS}),))
    state.setTimeoutTimestamp(seen_ms + S.SESSION_GAP_SECONDS * 1000)
    yield pd.DataFrame(out, columns=["session", "turn", "focus_code", "focus_name", "n_focus", "n_results"])


def focus(turns: DataFrame, delay="10 minutes") -> DataFrame:
    """Focus after every turn; a session is forgotten half an hour of event time after its last turn.

    turns (stream): session, turn, ord, kind (user_mention / result_item), code, name, ts.
    """
    return turns.withWatermark("ts", delay).groupBy("session").applyInPandasWithState(_walk, OUT, STATE, "append", "EventTimeTimeout")


CLOSED = OUT + ", ts timestamp"


class _ClosedTurns(StatefulProcessor):
    """Turns of one session. A turn is open until the watermark passes its last row; then its timer emits it, once."""

    def init(self, handle):
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn int", "summary string, last_ms bigint, emitted boolean")

    def _known(self):
        return {turn: (tuple(json.loads(summary)), last, emitted) for (turn,), (summary, last, emitted) in self.turns.iterator()}

    def handleInputRows(self, key, rows, timerValues):
        turns, touched = self._known(), {}
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for turn, kind, code, name, ord_, ms in zip(pdf["turn"], pdf["kind"], pdf["code"], pdf["name"], pdf["ord"], at):
                summary, last, _ = turns.get(int(turn), ((None, None, 0, 0), None, False))
                turns[int(turn)] = (_merge(summary, kind, code, name, int(ord_)), int(ms) if last is None else max(last, int(ms)), False)
                touched.setdefault(int(turn), last)
        for turn, before in touched.items():
            summary, last, _ = turns[turn]
            self.turns.updateValue((turn,), (json.dumps(summary), last, False))
            if before != last:
                self.handle.registerTimer(last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, turns, out = expiredTimerInfo.getExpiryTimeInMs(), self._known(), []
        for turn in sorted(t for t, (_, last, emitted) in turns.items() if not emitted and last <= now):
            near = [turns[t][0] for t in range(turn - S.FOCUS_TURNS, turn + 1) if t in turns]
            named, listed = [x[0] for x in near if x[0]], [x[1] for x in near if x[1]]
            top = named[-1] if named else listed[0] if listed else [0, None, None]
            summary, last, _ = turns[turn]
            out.append((key[0], turn, top[1], top[2], sum(x[2] + x[3] for x in near), summary[3], pd.Timestamp(last, unit="ms")))
            turns[turn] = (summary, last, True)
            self.turns.updateValue((turn,), (json.dumps(summary), last, True))
        if turns and all(emitted for _, _, emitted in turns.values()):
            forget, newest = max(last for _, last, _ in turns.values()) + S.SESSION_GAP_SECONDS * 1000, max(turns)
            if now >= forget:
                self.turns.clear()
            else:
                self.handle.registerTimer(forget)
                for turn in turns:
                    if turn < newest - S.FOCUS_TURNS:
                        self.turns.removeKey((turn,))
        if out:
            yield pd.DataFrame(out, columns=["session", "turn", "focus_code", "focus_name", "n_focus", "n_results", "ts"])

    def close(self):
        pass


def closed_focus(turns: DataFrame, delay="10 minutes") -> DataFrame:
    """Focus after every turn, one row per turn: it is given when the watermark has passed the turn's last row, however many batches its rows
    came in. Rows that come later still are dropped as late. A session is forgotten half an hour of event time after its last turn.

    turns (stream): session, turn, ord, kind (user_mention / result_item), code, name, ts. The state of a session is one small summary
    per turn in view. Needs the RocksDB state store of Spark (see with_timers).
    """
    return turns.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(
        _ClosedTurns(), CLOSED, outputMode="Append", timeMode="EventTime")


@contextmanager
def with_timers(spark):
    """Set the state store that timers need while a query is started, and put the session's own back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
