"""Sources: the seven collections, transcripts, event scripts; and the benchmark tables read as collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT, TABLES


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A collection under its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")


def lookup(table: DataFrame, key: str, value: object, owner: str | None = None) -> DataFrame:
    """The row with an id (of one owner), pushed down to the scan."""
    hit = table.where(F.col(key) == F.lit(value))
    return (hit.where(F.col("owner_id") == owner) if owner is not None else hit).limit(1)


def read_transcript(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A transcript fixture (one JSON document with an array of turns), one row per turn; with ``lines``, a document on each line."""
    turn = "utterance_id STRING, person_id STRING, speaker STRING, text STRING, start_ms BIGINT, end_ms BIGINT"
    doc = spark.read.schema(f"conversation_id STRING, utterances ARRAY<STRUCT<{turn}>>").json(path, multiLine=not lines)
    return doc.select("conversation_id", F.inline("utterances"))


def released(turns: DataFrame, clock: Column | int) -> DataFrame:
    """Turns that a provider with this stream clock has released: those that have ended."""
    return turns.where(F.col("end_ms") <= clock)


def inject(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """Appends rows given as Python values (debug injection)."""
    return table.unionByName(table.sparkSession.createDataFrame(rows, table.schema))


def event_script(spark: SparkSession, events: list[dict], speed: float = 1.0, loops: int = 1, pause_ms: int = 0) -> DataFrame:
    """Scripted events with arrival times: at_ms divided by speed, repeated after the last one."""
    rows = sorted(events, key=lambda e: e.get("at_ms", 0))
    span = (rows[-1].get("at_ms", 0) if rows else 0) + pause_ms
    out = []
    for n in range(loops):
        for e in rows:
            at = int((e.get("at_ms", 0) + n * span) / speed)
            out.append(tuple({**e, "seq": len(out), "at_ms": at}.get(f.name) for f in EVENT))
    return spark.createDataFrame(out, EVENT)


def provider(name: str, **makers):
    """The source that a setting names; an unknown or empty name means the fixture."""
    return makers.get((name or "").strip().lower()) or makers["fixture"]


class Bench:
    """The benchmark tables of one folder as domain tables. Every method is a plan; nothing is read twice on purpose."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def candidates(self) -> DataFrame:
        """Fact candidates: one for each event."""
        claim = F.concat(F.col("event_type"), F.lit(" value "), F.get_json_object("props", "$.k"))
        source = F.pmod(F.col("event_id"), F.lit(100)) * 10 + F.pmod(F.col("event_id"), F.lit(5))
        return self.raw("events").select(
            F.col("event_id").alias("fact_id"), F.col("user_id").alias("person_id"), F.col("event_type").alias("attribute"), claim.alias("claim"),
            source.alias("source_utterance_id"), F.col("ts").alias("valid_from"), F.col("value").alias("weight"),
        )

    def facts(self) -> DataFrame:
        """Candidates with their supersession edges."""
        from ..operators.facts import supersede

        return supersede(self.candidates())

    def people(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("relationship"), (key == 0).alias("is_owner"),
            (F.lit(1_700_000_000_000) + F.pmod(key * 7919, F.lit(1000)) * 1000).alias("created_ms"),
        )

    def promises(self) -> DataFrame:
        """Every fiftieth text speaks of a purchase; each names the customer after the one who made it."""
        verb = F.when(F.col("o_orderkey") % 50 == 0, " purchase").otherwise(" call")
        named = F.lpad(F.pmod(F.col("o_custkey") + 1, F.lit(1500)).cast("string"), 9, "0")
        text = F.concat(F.lower(F.substring("o_orderpriority", 3, 100)), verb, F.lit(" for Customer#"), named)
        status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("cancelled")
        due = F.when(~F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderdate"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("promise_id"), F.col("o_custkey").alias("person_id"), text.alias("text"), status.alias("status"), due.alias("due_at"),
            (F.col("o_orderdate") - F.expr("INTERVAL 10 DAYS")).alias("created_at"),
        )

    def utterances(self) -> DataFrame:
        """Conversation turns on a clock of 60 ms per character; some have no person, the last turn isn't final."""
        from pyspark.sql import Window

        w = Window.partitionBy("conv_id").orderBy("turn")
        span = F.length("text") * 60
        end = F.sum(span).over(w.rowsBetween(Window.unboundedPreceding, 0))
        person = F.when(F.col("turn") % 7 == 6, F.lit(None)).when(F.col("role") == "assistant", F.lit(0)).otherwise(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(150)))
        last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
        return self.raw("conversations").select(
            (F.col("conv_id") * 10 + F.col("turn")).alias("utterance_id"), F.col("conv_id").alias("conversation_id"), F.col("turn"), F.col("role").alias("speaker"),
            person.cast("long").alias("person_id"), "text", (end - span).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), (~last).alias("is_final"),
        )

    def segments(self) -> DataFrame:
        """Diarised spans; some end before the turn does, so that late words have no speaker."""
        u = self.utterances()
        return u.select("conversation_id", "speaker", "start_ms", (F.col("end_ms") - F.pmod(F.col("turn"), F.lit(3)) * 200).alias("end_ms")).where("end_ms > start_ms")

    def words(self) -> DataFrame:
        from ..operators.segments import time_words

        return time_words(self.utterances().select("conversation_id", "utterance_id", "text", "start_ms", "end_ms"))

    def voiceprints(self) -> DataFrame:
        """One print per embedding; label is the person, every ninth label's people are unknown (orphans)."""
        dur = F.lit(500) + F.pmod(F.col("vec_id") * 37, F.lit(6000))
        return self.raw("embeddings").select(F.col("vec_id").alias("voiceprint_id"), F.col("label").cast("long").alias("person_id"), "embedding", dur.alias("duration_ms"))

    def trials(self) -> DataFrame:
        """Scored trials from the labelled documents."""
        return self.raw("labels").join(self.raw("documents"), "doc_id").select(F.col("doc_id").alias("trial_id"), (F.pmod(F.col("n_chars"), F.lit(1000)) / 1000).alias("score"), (F.col("quality") == 1).alias("genuine"), F.col("lang").alias("block"))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
