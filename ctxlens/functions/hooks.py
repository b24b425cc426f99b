"""Hooks for models that the caller brings: they run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embedder(model: Callable[[list], list], dims: int, batch: int = 64) -> Callable[[Column], Column]:
    """A vectorized function from texts (or arrays of samples) to vectors of ``dims`` floats; null stays null.

    ``model`` takes a list and returns a list of vectors; a wrong length is an error.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def f(s: pd.Series) -> pd.Series:
        out: list = [None] * len(s)
        at = [i for i, x in enumerate(s) if x is not None]
        for lo in range(0, len(at), batch):
            part = at[lo : lo + batch]
            for i, v in zip(part, model([s.iloc[i] for i in part]), strict=True):
                if len(v) != dims:
                    raise ValueError(f"a vector of {len(v)} dimensions; {dims} are expected")
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    return f


def checked_vectors(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """Fails on rows whose vector has another length; null is allowed."""
    ok = F.col(column).isNull() | (F.size(column) == dims)
    return rows.withColumn(column, F.when(F.assert_true(ok, F.lit(f"{column} must have {dims} dimensions")).isNull(), F.col(column)))


def over_budget(steps: DataFrame, most: int = 5) -> DataFrame:
    """Requests whose trace has more tool calls than allowed: steps(request_id, tool), tool null for other steps."""
    return steps.groupBy("request_id").agg(F.count("tool").alias("calls")).where(F.col("calls") > most)
