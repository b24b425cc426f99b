"""Audio in and out: frames, WAV, raw PCM."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FRAME_SAMPLES, SAMPLE_RATE


def parse_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples in [-1, 1)) of a 16-bit mono RIFF file; other chunks are skipped."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            channels, rate, bits = struct.unpack_from("<HI6xH", body, 2)
            if channels != 1 or bits != 16:
                raise ValueError("only 16-bit mono is read")
        if kind == b"data" and rate:
            return rate, np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype("f4") / 32768
        at += 8 + size + size % 2
    raise ValueError("no audio data")


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """16-bit mono WAV; samples are clipped, negative ones scaled by 32768 and others by 32767, halves up."""
    x = np.clip(np.asarray(samples, "f8"), -1, 1)
    data = np.floor(np.where(x < 0, x * 32768, x * 32767) + 0.5).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data))
    return head + data


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, samples of WAV files, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rate, x = parse_wav(c)
                yield pa.RecordBatch.from_pydict({"path": [p], "sample_rate": pa.array([rate], pa.int32()), "samples": pa.array([x.tolist()], pa.list_(pa.float32()))})

    return files.mapInArrow(run, "path string, sample_rate int, samples array<float>")


def wav_files(clips: DataFrame) -> DataFrame:
    """Adds ``wav``: the WAV encoding of ``samples``."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode_wav(x), na_action="ignore")

    return clips.withColumn("wav", f("samples"))


def valid_pcm(raw: Column) -> Column:
    """Whether a raw body can be 32-bit float samples: not empty, and whole."""
    return F.coalesce((F.octet_length(raw) > 0) & (F.octet_length(raw) % 4 == 0), F.lit(False))


def pcm_frames(messages: DataFrame) -> DataFrame:
    """Frames of a stream: messages(conversation_id, seq, raw) of the exact frame size, with the stream clock in ms.

    The clock counts samples only; messages of another size are left out and don't move it.
    """
    ok = messages.where(F.octet_length("raw") == FRAME_SAMPLES * 4)
    w = Window.partitionBy("conversation_id").orderBy("seq")
    return ok.withColumn("position_ms", ((F.row_number().over(w) - 1) * (FRAME_SAMPLES * 1000 // SAMPLE_RATE)).cast("long"))


def uplink_report(messages: DataFrame) -> DataFrame:
    """Per conversation: frames, bad_sizes, audio_seconds, peak, rms and a verdict.

    Peak and energy are taken per Arrow batch and then summed, so frames are read once where they lie.
    """

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            ids, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            frames = [np.frombuffer(r[: len(r) // 4 * 4], "<f4").astype("f8") for r in raws]
            cols = [len(r) != FRAME_SAMPLES * 4 for r in raws], [float(np.abs(x).max(initial=0)) for x in frames], [float(x @ x) for x in frames], [len(x) for x in frames]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(cols[0], pa.bool_()), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.float64(), pa.float64(), pa.int64()), strict=True)]], ["conversation_id", "bad", "peak", "energy", "n"])

    kind = messages.schema["conversation_id"].dataType.simpleString()
    m = messages.select("conversation_id", F.coalesce("raw", F.lit(b"")).alias("raw")).mapInArrow(measure, f"conversation_id {kind}, bad boolean, peak double, energy double, n long")
    r = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("bad").alias("bad_sizes"), F.max("peak").alias("peak"), F.sqrt(F.try_divide(F.sum("energy"), F.sum("n"))).alias("rms"))
    verdict = F.when(F.col("bad_sizes") > 0, "bad frame sizes").when(F.col("peak") > 0.0005, "ok").otherwise("silent")
    return r.withColumn("audio_seconds", F.col("frames") * FRAME_SAMPLES / SAMPLE_RATE).withColumn("verdict", verdict)


def packetize(chunks: DataFrame, key: str = "conversation_id", seq: str = "seq", samples: str = "samples", size: int = FRAME_SAMPLES) -> DataFrame:
    """(key, frame, samples): chunks of any length cut into frames of ``size``; an incomplete last frame is held back.

    A chunk knows where it starts by a running sum of lengths, so only the pieces of a frame meet.
    """
    w = Window.partitionBy(key).orderBy(seq)
    n = F.size(samples)
    start = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = chunks.where(F.size(samples) > 0).select(key, seq, F.col(samples).alias("x"), start.alias("start"))
    frames = F.sequence(F.col("start").cast("long") - F.pmod("start", F.lit(size)), F.col("start") + F.size("x") - 1, F.lit(size).cast("long"))
    part = placed.select(key, "start", "x", F.explode(frames).alias("at"))
    lo = F.greatest(F.col("at") - F.col("start"), F.lit(0)).cast("int")
    hi = F.least(F.col("at") + size - F.col("start"), F.size("x")).cast("int")
    part = part.select(key, (F.col("at") / size).cast("long").alias("frame"), "start", F.slice("x", lo + 1, hi - lo).alias("x"))
    joined = part.groupBy(key, "frame").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "x"))), lambda s: s["x"])).alias("samples"))
    return joined.where(F.size("samples") == size)
