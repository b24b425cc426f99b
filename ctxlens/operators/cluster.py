"""Online speaker clustering of a conversation's turns, as a fold in order of start."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
LINK, NEW_MS, EMBED_MS, NEAR_MS = 0.5, 1500, 250, 1200


class Clusterer:
    """Places turns; those that can't be placed yet are retried, the last first, after each placed one.

    A cluster's centroid moves by the share of new speech in all its speech. Centroids are one matrix, and the spans of all placed
    turns two columns, so a turn is held against all clusters at once.
    """

    def __init__(self):
        self.centroids = np.zeros((0, 0))
        self.speech: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.owners: list[int] = []
        self.waiting: list[tuple[str, int, int, np.ndarray | None]] = []

    def _take(self, c: int, a: int, b: int, v: np.ndarray | None = None) -> None:
        """Adds a turn; without a vector (placed by adjacency or as a last resort) the centroid stays."""
        if v is not None:
            share = (b - a) / (self.speech[c] + b - a)
            self.centroids[c] = self.centroids[c] * (1 - share) + v * share
        self.speech[c] += b - a
        self._span(c, a, b)

    def _span(self, c: int, a: int, b: int) -> None:
        self.starts.append(a)
        self.ends.append(b)
        self.owners.append(c)

    def _open(self, a: int, b: int, v: np.ndarray) -> int:
        c = len(self.speech)
        self.centroids = np.vstack((self.centroids, v)) if c else v[None].astype("f8")
        self.speech.append(b - a)
        self._span(c, a, b)
        return c

    def _best(self, v: np.ndarray) -> tuple[int, float]:
        """The cluster of the largest cosine, the first on a tie; a zero vector is at 0 from all."""
        mag = np.sqrt((self.centroids**2).sum(1)) * np.sqrt(v @ v)
        cos = np.divide(self.centroids @ v, mag, out=np.zeros(len(mag)), where=mag > 0)
        c = int(np.argmax(cos))
        return c, float(cos[c])

    def _closest(self, a: int, b: int, reach: float) -> int | None:
        gap = np.maximum(0, np.maximum(a - np.array(self.ends), np.array(self.starts) - b))
        near = gap.min()
        return min(o for o, g in zip(self.owners, gap.tolist(), strict=True) if g == near) if near <= reach else None

    def _retry(self, last: bool = False) -> list[tuple]:
        out = []
        for i in range(len(self.waiting) - 1, -1, -1) if self.speech else ():
            label, a, b, v = self.waiting[i]
            c, score = self._best(v) if v is not None else (None, None)
            how = "matched"
            if v is not None and score < LINK:
                how = "nearest"
                if not last:
                    continue
            if v is None:
                c, how = self._closest(a, b, np.inf if last else NEAR_MS), "adjacent"
                if c is None:
                    continue
            self._take(c, a, b, v if how == "matched" else None)
            out.append((label, c, score, how))
            del self.waiting[i]
        return out

    def add(self, label: str, a: int, b: int, v: np.ndarray | None) -> list[tuple]:
        """Placements (label, cluster, similarity, reason) that this turn makes possible."""
        if v is None or b - a < EMBED_MS:
            self.waiting.append((label, a, b, None))
            return self._retry()
        c, score = self._best(v) if self.speech else (None, None)
        if c is not None and score >= LINK:
            self._take(c, a, b, v)
            return [(label, c, score, "matched"), *self._retry()]
        if b - a >= NEW_MS or not self.speech:
            return [(label, self._open(a, b, v), score, "created"), *self._retry()]
        self.waiting.append((label, a, b, v))
        return self._retry()

    def flush(self) -> list[tuple]:
        """Best guesses for all that still waits."""
        out = self._retry()
        return out + self._retry(last=True)


def cluster_turns(turns: DataFrame) -> DataFrame:
    """conversation_id, label, cluster_id, similarity, reason of turns (conversation_id, label, start_ms, end_ms, embedding).

    A conversation is folded in one task, in order of (start_ms, label); turns that no cluster can take don't appear.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        c, rows = Clusterer(), []
        for r in pdf.sort_values(["start_ms", "label"]).itertuples():
            rows += c.add(r.label, int(r.start_ms), int(r.end_ms), None if r.embedding is None else np.asarray(r.embedding, "f8"))
        rows += c.flush()
        out = pd.DataFrame(rows, columns=["label", "cluster", "similarity", "reason"])
        out["similarity"] = out["similarity"].astype("float64")
        out.insert(0, "conversation_id", pdf["conversation_id"].iloc[0])
        out.insert(2, "cluster_id", "cluster-" + out["cluster"].astype(str))
        return out[["conversation_id", "label", "cluster_id", "similarity", "reason"]]

    return turns.groupBy("conversation_id").applyInPandas(fold, "conversation_id long, label string, cluster_id string, similarity double, reason string")


def weighted_centroids(turns: DataFrame, key: str) -> DataFrame:
    """key, centroid, speech_ms: means of vectors weighted by duration, not renormalized (the order-free form of the fold)."""
    ms = (F.col("end_ms") - F.col("start_ms")).cast("double")
    part = turns.select(key, ms.alias("ms"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = part.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("ms")) / F.sum("ms")).alias("x"), F.sum("ms").cast("long").alias("ms"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("ms").alias("speech_ms"))


def nearest_in_time(turns: DataFrame, placed: DataFrame, window_ms: int = NEAR_MS) -> DataFrame:
    """label, cluster_id, gap_ms: the placed turn nearest in time to each turn of its conversation, if within the window.

    The nearest earlier and later neighbours, and any overlap, decide; found by an equi-join on time buckets of the window.
    """
    span = lambda a, b: F.sequence(F.floor(a / window_ms), F.floor(b / window_ms))
    t = turns.select("conversation_id", "label", "start_ms", "end_ms").withColumn("bucket", F.explode(span(F.col("start_ms") - window_ms, F.col("end_ms") + window_ms)))
    p = placed.select("conversation_id", "cluster_id", F.col("start_ms").alias("p0"), F.col("end_ms").alias("p1")).withColumn("bucket", F.explode(span(F.col("p0"), F.col("p1"))))
    gap = F.greatest(F.lit(0).cast("long"), F.col("start_ms") - F.col("p1"), F.col("p0") - F.col("end_ms"))
    met = t.join(p, ["conversation_id", "bucket"]).withColumn("gap", gap).where(F.col("gap") <= window_ms)
    best = met.groupBy("conversation_id", "label").agg(F.min(F.struct("gap", "cluster_id")).alias("b"))
    return best.select("conversation_id", "label", F.col("b.cluster_id").alias("cluster_id"), F.col("b.gap").alias("gap_ms"))


def cluster_of_turns(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """Turns in order of start within a conversation, numbered."""
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "label")
    numbered = turns.withColumn("number", F.row_number().over(w))
    return numbered.where(F.col("number") <= limit) if limit else numbered
