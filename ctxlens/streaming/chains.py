"""A serial chain of work for each conversation, whose failures stay with the row that failed; and batches that wait for a pause."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_states

CHAIN = "conversation_id string, seq long, number long, result string, error string"


class Chain(StatefulProcessor):
    """Hands a conversation's rows to ``work(memory, text) -> (memory, result)`` one after the other, in order of seq.

    What ``work`` remembers is a text in keyed state. A row on which it raises changes nothing and goes out with its error; the next
    row finds the memory as it was before. Rows not after the last seen one are repeats.
    """

    def __init__(self, work: Callable[[str | None, str | None], tuple[str | None, str | None]]):
        self.work = work

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", "seq long, number long, memory string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, number, memory = self.state.get() if self.state.exists() else (None, 0, None)
        out = []
        for r in pd.concat(rows).sort_values("seq").itertuples():
            if last is not None and r.seq <= last:
                continue
            last, number = int(r.seq), number + 1
            try:
                memory, result = self.work(memory, r.text if isinstance(r.text, str) else None)
                out.append((key[0], last, number, result, None))
            except Exception as e:  # noqa: BLE001 - whatever the work raises belongs to its row
                out.append((key[0], last, number, None, f"{type(e).__name__}: {e}"))
        self.state.update((last, number, memory))
        yield pd.DataFrame(out, columns=["conversation_id", "seq", "number", "result", "error"]).astype({"seq": "int64", "number": "int64"})


def chained(turns: DataFrame, work: Callable) -> DataFrame:
    """CHAIN of a stream of turns (conversation_id, seq, text): each row's result, or its error (``error`` not null: the dead letters)."""
    rows = turns.where("conversation_id IS NOT NULL AND seq IS NOT NULL").select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
    keyed_states(rows.sparkSession)
    return rows.groupBy("conversation_id").transformWithStateInPandas(Chain(work), CHAIN, "append", "None")


class Debounce(StatefulProcessor):
    """Holds a key's events until none has come for ``pause_ms`` (of event time), then lets the batch go."""

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long, text string, at_ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.seq), r.text if isinstance(r.text, str) else None, int(pd.Timestamp(r.at).timestamp() * 1000)) for r in pd.concat(rows).sort_values("seq").itertuples()]
        held = {x[0]: x for x in new} | {s: (s, t, a) for s, t, a in self.held.get()}  # an event that comes again is held once, as it first came
        ready, wait = self._split(sorted(held.values()))
        self._keep(wait)
        yield _batches(key[0], ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(x) for x in self.held.get())
        self._keep([])
        yield _batches(key[0], [held] if held else [])

    def _split(self, events: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
        """Whole batches, those that a later event shows to be over, and what waits."""
        done, now = [], []
        for e in events:
            if now and e[2] - now[-1][2] > self.pause_ms:
                done.append(now)
                now = []
            now.append(e)
        return done, now

    def _keep(self, events: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.held.clear()
        if events:
            self.held.put(events)
            self.handle.registerTimer(max(e[2] for e in events) + self.pause_ms)


def _batches(key: str, batches: list[list[tuple]]) -> pd.DataFrame:
    rows = [(key, b[0][0], b[-1][0], len(b), [e[1] for e in b], max(e[2] for e in b)) for b in batches]
    return pd.DataFrame(rows, columns=["owner_id", "first_seq", "last_seq", "n", "texts", "at_ms"]).astype({"first_seq": "int64", "last_seq": "int64", "n": "int64", "at_ms": "int64"})


def debounced(events: DataFrame, pause_ms: int = 200, late: str = "0 seconds") -> DataFrame:
    """Batches (owner_id, first_seq, last_seq, n, texts, at_ms) of a stream of events (owner_id, seq, text, at).

    A batch goes out once no event has followed its last one for ``pause_ms``, by the events' own time; what the watermark leaves behind is dropped.
    """
    rows = events.where("owner_id IS NOT NULL AND seq IS NOT NULL").select(F.col("owner_id").cast("string").alias("owner_id"), F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"), "at").withWatermark("at", late)
    out = "owner_id string, first_seq long, last_seq long, n long, texts array<string>, at_ms long"
    keyed_states(rows.sparkSession)
    return rows.groupBy("owner_id").transformWithStateInPandas(Debounce(pause_ms), out, "append", "EventTime")
