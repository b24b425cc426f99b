"""Messages of audio connections as a stream: one hello, then frames of the exact size; what breaks the rules closes the connection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_states
from ..sources.audio import FRAME_SAMPLES, SAMPLE_RATE

OUT = "connection_id string, seq long, kind string, conversation_id string, position_ms long, raw binary, code int, reason string"
FRAME_BYTES, FRAME_MS = FRAME_SAMPLES * 4, FRAME_SAMPLES * 1000 // SAMPLE_RATE
#: Codes with which a connection is closed (fixed values): broken rules, and work that fails.
BROKEN, FAILED = 1002, 1011


class Connection(StatefulProcessor):
    """Follows each connection: rows of kind "hello", "frame" (with its place on the stream's clock) and "closed".

    Nothing follows the close. Messages not after the last seen one are repeats, so a source that delivers some again does no harm.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("connection", "seq long, conversation_id string, frames long, closed boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, conversation, frames, closed = self.state.get() if self.state.exists() else (-1, None, 0, False)
        out: list[tuple] = []
        for m in pd.concat(rows).sort_values("seq").itertuples():
            if closed or m.seq <= last:
                continue
            last = int(m.seq)
            code, reason = None, None
            if isinstance(m.text, str):
                if conversation is not None:
                    code, reason = BROKEN, "hello already received"
                else:
                    conversation, reason = _hello(m.text)
                    code = BROKEN if conversation is None else None
                    if code is None:
                        out.append((key[0], last, "hello", conversation, None, None, None, None))
            elif m.raw is None or len(m.raw) != FRAME_BYTES:
                code, reason = BROKEN, f"frames must be {FRAME_BYTES} bytes"
            elif conversation is None:
                code, reason = FAILED, "binary frame before hello"
            else:
                out.append((key[0], last, "frame", conversation, frames * FRAME_MS, bytes(m.raw), None, None))
                frames += 1
            if code is not None:
                closed = True
                out.append((key[0], last, "closed", conversation, None, None, code, reason))
        self.state.update((last, conversation, frames, closed))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"seq": "int64", "position_ms": "Int64", "code": "Int32"})


def _hello(text: str) -> tuple[str | None, str | None]:
    try:
        said = json.loads(text)
        conversation = said.get("conversation_id") if isinstance(said, dict) else None
    except ValueError:
        return None, "bad hello: not JSON"
    return (str(conversation), None) if conversation else (None, "bad hello: conversation_id missing")


def connections(messages: DataFrame) -> DataFrame:
    """OUT of a stream of messages (connection_id, seq, text, raw): text messages have ``text``, binary ones ``raw``. Rows without an id or seq are left out."""
    m = messages.where("connection_id IS NOT NULL AND seq IS NOT NULL").select(F.col("connection_id").cast("string").alias("connection_id"), F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"), F.col("raw").cast("binary").alias("raw"))
    keyed_states(m.sparkSession)
    return m.groupBy("connection_id").transformWithStateInPandas(Connection(), OUT, "append", "None")
