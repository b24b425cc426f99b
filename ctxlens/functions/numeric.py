"""Vector, score and sample arithmetic as Columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    mag = norm(a) * norm(b)
    return F.when(mag == 0, 0.0).otherwise(dot(a, b) / mag)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(x))


def index_score(cos: Column) -> Column:
    """Cosine as a vector index reports it, in [0, 1]."""
    return (1 + cos) / 2


def raw_cosine(score: Column) -> Column:
    """Cosine back from an index score, clamped, to twelve digits."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * score - 1)), 12)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrated(score: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Probability of a genuine trial."""
    return sigmoid(score * slope + intercept)


def s_norm(score: Column, test_mean: Column, test_std: Column, enrolled_mean: Column, enrolled_std: Column) -> Column:
    return ((score - test_mean) / test_std + (score - enrolled_mean) / enrolled_std) / 2


def rms(samples: Column) -> Column:
    return F.sqrt(dot(samples, samples) / F.size(samples))


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def ms_of_samples(n: Column, rate: int = 16_000) -> Column:
    return js_round(n / rate * 1000)


def resample(samples: Column, source_rate: int, target_rate: int, length_rule: str = "round") -> Column:
    """Linear resampling. length_rule: round, floor (at least 1) or max_round (at least 1)."""
    if source_rate == target_rate:
        return samples.cast("array<double>")
    ratio = source_rate / target_rate
    n = F.size(samples)
    length = {"round": js_round(n / ratio), "floor": F.greatest(F.lit(1), F.floor(n / ratio)), "max_round": F.greatest(F.lit(1), js_round(n / ratio))}[length_rule].cast("int")
    x = samples.cast("array<double>")

    def at(i: Column) -> Column:
        place = i * F.lit(ratio)
        lo = F.least(F.floor(place), n - 1).cast("int")
        hi = F.least(lo + 1, n - 1)
        return F.get(x, lo) + (F.get(x, hi) - F.get(x, lo)) * (place - lo)

    return F.when((n > 0) & (length > 0), F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(F.array().cast("array<double>"))


def int16_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(32768.0))


def float_to_int16(samples: Column) -> Column:
    """Clipped to [-1, 1]; negative values scale by 32768, others by 32767."""
    clip = lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double")))
    return F.transform(samples, lambda s: F.when(clip(s) < 0, js_round(clip(s) * 32768)).otherwise(js_round(clip(s) * 32767)).cast("int"))


def slice_pcm(samples: Column, start_ms: Column, end_ms: Column, rate: int = 16_000) -> Column:
    """Samples of a time span: start rounded down, end up, both clamped."""
    a = F.greatest(F.lit(0), F.floor(start_ms / 1000 * rate)).cast("int")
    b = F.least(F.size(samples), F.ceil(end_ms / 1000 * rate)).cast("int")
    return F.slice(samples, a + 1, F.greatest(F.lit(0), b - a))


def config_number(value: str | None, default: float) -> float:
    """A setting from text: blank or not finite means the default."""
    try:
        x = float(value) if value and value.strip() else math.nan
    except ValueError:
        x = math.nan
    return x if math.isfinite(x) else default
