"""Events for subscribers: a stream's batches as a log of lines, read from any subscriber's place on, with heartbeats in the pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sse_line

#: A pause of so many seconds has a heartbeat (fixed values).
HEARTBEAT_S, HEARTBEAT = 15, ": heartbeat\n\n"


class EventLog:
    """Under ``folder``: ``events/batch=n`` (place, at, line) and ``commits/batch=n``. A batch that is written again replaces itself or changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> list[int]:
        try:
            return sorted(r[0] for r in self.spark.read.parquet(f"{self.folder}/commits").select("batch").distinct().collect())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return []

    def append(self, events: DataFrame, batch: int) -> None:
        """Events (seq, at, type and more columns): a line each, in the order of seq. The sort is over one micro-batch."""
        if batch in self._committed():
            return
        body = F.struct(*[F.col(c) for c in events.columns if c not in ("seq", "at")])
        lines = events.select("seq", "at", F.concat(F.lit("event: "), "type", F.lit("\n"), sse_line(body)).alias("line")).orderBy("seq", "line")
        lines.withColumn("place", F.monotonically_increasing_id()).drop("seq").write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")

    def after(self, batch: int = -1, place: int = -1) -> DataFrame:
        """(batch, place, at, line) of the committed events after a subscriber's last one, in order; its own last row is the next call's argument."""
        later = [b for b in self._committed() if b >= batch]
        if not later:
            return self.spark.createDataFrame([], "batch int, place long, at timestamp, line string")
        rows = self.spark.read.option("basePath", f"{self.folder}/events").parquet(*[f"{self.folder}/events/batch={b}" for b in later])
        rows = rows.where((F.col("batch") > batch) | (F.col("place") > place))
        return rows.select("batch", "place", "at", "line").orderBy("batch", "place")


def with_heartbeats(lines: DataFrame, since, until, every_s: int = HEARTBEAT_S) -> DataFrame:
    """(at, line): the lines (batch, place, at, line) of one subscriber, and a heartbeat at each ``every_s`` seconds between ``since`` and ``until`` by its own clock."""
    ticks = lines.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("timestamp") + F.expr(f"INTERVAL {every_s} SECONDS"), F.lit(until).cast("timestamp"), F.expr(f"INTERVAL {every_s} SECONDS"))).alias("at"))
    beats = ticks.select(F.lit(1).alias("beat"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("place"), "at", F.lit(HEARTBEAT).alias("line"))
    return lines.select(F.lit(0).alias("beat"), "batch", "place", "at", "line").unionByName(beats).orderBy("at", "beat", "batch", "place").select("at", "line")


def publish(events: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends what has come of a stream of events to the log, each batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        EventLog(batch.sparkSession, folder).append(batch, epoch)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
