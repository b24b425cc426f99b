"""A keyed table as a log of batches: writes follow the batch, reads fold the log, compaction folds it for good.

Under ``folder``: ``log/batch=n/bucket=b`` holds the last row of each key in batch n; ``commits/batch=n`` says that it is whole;
``base/upto=n`` holds the table after batch n, and ``bases/upto=n`` says so. A batch counts once, however often it is appended: what isn't committed
is overwritten, what is committed is left alone. Batches are numbered without gaps, so a lost one is noticed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingBatch(RuntimeError):
    """The log has a gap: a batch before the one at hand was never committed, or its files have gone."""


@dataclass
class LogTable:
    """key: its columns; seq: order within a batch (a later batch wins over an earlier one); created: column that keeps a key's first value."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: list[str]
    seq: str
    created: str
    buckets: int = 64

    def _numbers(self, name: str, column: str) -> list[int]:
        """Committed numbers; one small row for each batch since the last compaction's cleaning."""
        try:
            return sorted(r[0] for r in self.spark.read.parquet(f"{self.folder}/{name}").select(column).distinct().collect())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return []

    def _commit(self, name: str, column: str, number: int) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/{column}={number}")

    def last(self) -> int:
        """Number of the last batch that the table holds, -1 if there is none."""
        return max([*self._numbers("commits", "batch"), *self._numbers("bases", "upto")], default=-1)

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row per key from rows with __batch: the last, with the first ``created``."""
        w = Window.partitionBy(*self.key)
        first = F.min_by(self.created, F.struct("__batch", self.seq)).over(w)
        n = F.row_number().over(w.orderBy(F.col("__batch").desc(), F.col(self.seq).desc()))
        return rows.withColumns({"__first": first, "__n": n}).where("__n = 1").withColumn(self.created, F.col("__first")).drop("__first", "__n")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Writes one batch; False if it is in the table already. Writes about as much as the batch holds, whatever the table's size."""
        last = self.last()
        if batch <= last:
            return False
        if batch > last + 1:
            raise MissingBatch(f"batch {batch} follows {last} in {self.folder}")
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        mine = self._folded(rows.select(*self.schema.names).withColumn("__batch", F.lit(batch))).drop("__batch")
        mine.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/log/batch={batch}")
        self._commit("commits", "batch", batch)
        return True

    def _rows(self) -> tuple[DataFrame, int]:
        """All rows that count, with __batch, and the last batch among them."""
        bases, commits = self._numbers("bases", "upto"), self._numbers("commits", "batch")
        base = max(bases, default=-1)
        later = [b for b in commits if b > base]
        if later != list(range(base + 1, base + 1 + len(later))):
            raise MissingBatch(f"{self.folder} has {later} after {base}")
        stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        read = lambda path, n: self.spark.read.schema(stored).parquet(path).select(*self.schema.names, F.lit(n).alias("__batch"))
        parts = [read(f"{self.folder}/base/upto={base}", base)] if base >= 0 else []
        parts += [read(f"{self.folder}/log/batch={b}", b) for b in later]
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema).withColumn("__batch", F.lit(-1))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out, max([base, *later])

    def read(self) -> DataFrame:
        """The table: one row per key. One shuffle by key of the base and the batches since."""
        return self._folded(self._rows()[0]).select(*self.schema.names)

    def compact(self) -> int:
        """Folds the log into a new base; readers of the old one aren't disturbed, as nothing is overwritten. Returns its batch."""
        rows, upto = self._rows()
        if upto < 0 or upto in self._numbers("bases", "upto"):
            return upto
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        self._folded(rows).drop("__batch").withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/upto={upto}")
        self._commit("bases", "upto", upto)
        return upto
