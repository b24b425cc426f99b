"""Turns from the energy of 20 ms windows."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rules:
    """Fixed values of the first provider; the second closes turns at 20 s."""

    threshold: float = 0.01
    silence_ms: float = 250
    least_before_silence_ms: float = 1000
    least_ms: float = 400
    longest_ms: float = 15_000


def turns_of(windows: list[tuple[float, float, float]], rules: Rules = Rules()) -> list[tuple[int, int]]:
    """(start, end) of the turns in windows (start_ms, end_ms, rms) in order.

    A turn starts with speech. It ends after enough silence that follows enough speech, at its longest duration, or at a gap in
    the clock; it counts if it has enough speech, and loses its trailing silence.
    """
    out: list[tuple[int, int]] = []
    start = end = speech = quiet = 0.0
    is_open, previous = False, None

    def close() -> None:
        nonlocal is_open
        if is_open and speech >= rules.least_ms:
            out.append((int(start + 0.5), int(end + 0.5)))
        is_open = False

    for a, b, level in windows:
        if previous is not None and a != previous:
            close()
        previous = b
        silent = level < rules.threshold
        if not is_open:
            if silent:
                continue
            is_open, start, speech, quiet = True, a, 0.0, 0.0
        if silent:
            quiet += b - a
        else:
            speech, quiet, end = speech + b - a, 0.0, b
        if (quiet >= rules.silence_ms and speech >= rules.least_before_silence_ms) or b - start >= rules.longest_ms:
            close()
    close()
    return out


def voice_turns(windows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """stream_id, turn, start_ms, end_ms from windows (stream_id, start_ms, end_ms, rms), one stream at a time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms")
        rows = turns_of(list(zip(pdf["start_ms"], pdf["end_ms"], pdf["rms"], strict=True)), rules)
        out = pd.DataFrame(rows, columns=["start_ms", "end_ms"])
        out.insert(0, "turn", [f"turn-{i}" for i in range(len(rows))])
        out.insert(0, "stream_id", pdf["stream_id"].iloc[0])
        return out

    return windows.groupBy("stream_id").applyInPandas(fold, "stream_id long, turn string, start_ms long, end_ms long")
