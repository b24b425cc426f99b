"""Writes as snapshots: each returns the new table. Keys decide, never the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` must be total within a key."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, incoming: DataFrame, key: list[str], seq: str, created: str) -> DataFrame:
    """Sets all columns from the last incoming row of a key, but keeps the first ``created`` value. One shuffle by key."""
    both = table.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key)
    first = F.min_by(created, F.struct("__new", seq)).over(w)
    rank = F.row_number().over(w.orderBy(F.col("__new").desc(), F.col(seq).desc()))
    return both.withColumns({"__first": first, "__n": rank}).where("__n = 1").withColumn(created, F.col("__first")).drop("__new", "__first", "__n")


def insert_once(table: DataFrame, incoming: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``incoming`` that are new under a unique key (null equals null); the first in ``order`` wins within a batch."""
    w = Window.partitionBy(*unique).orderBy(*order)
    fresh = incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    old = table.select(*[F.col(c).alias(f"__{c}") for c in unique])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in unique]
    return fresh.join(old, same, "left_anti")


def repoint(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replaces ids by ``mapping`` (old_id, new_id), unmapped ones stay."""
    m = mapping.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    return table.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def cascade_delete(conversation: Column, utterances: DataFrame, facts: DataFrame, promises: DataFrame, repair: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes a conversation's utterances and the facts and promises they are the source of.

    Returns the tables that remain and one row of counts. A predecessor whose successor goes stays
    superseded, unless ``repair`` makes it current again.
    """
    gone = F.broadcast(utterances.where(F.col("conversation_id") == conversation).select(F.col("utterance_id").alias("__u")))  # those of one conversation
    keep = {
        "utterances": utterances.where(~F.coalesce(F.col("conversation_id") == conversation, F.lit(False))),
        "facts": facts.join(gone, facts["source_utterance_id"] == F.col("__u"), "left_anti"),
        "promises": promises.join(gone, promises["source_utterance_id"] == F.col("__u"), "left_anti"),
    }
    if repair:
        left = keep["facts"]
        ids = left.select(F.col("fact_id").alias("__id"))
        left = left.join(ids, left["superseded_by"] == F.col("__id"), "left")
        lost = F.col("superseded_by").isNotNull() & F.col("__id").isNull()
        keep["facts"] = left.withColumns({"superseded_by": F.when(~lost, F.col("superseded_by")), "superseded_at": F.when(~lost, F.col("superseded_at"))}).drop("__id")
    one = lambda n, t: t.agg(F.count(F.lit(1)).alias(n))
    by_source = lambda t: t.join(gone, t["source_utterance_id"] == F.col("__u"), "left_semi")
    parts = [one("utterances", gone), one("facts", by_source(facts)), one("promises", by_source(promises))]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.join(p)  # single rows
    return keep, counts


def set_status(promises: DataFrame, changes: DataFrame) -> DataFrame:
    """Status after the last change of each promise: changes(promise_id, status, seq); others keep theirs."""
    last = latest(changes.where(F.col("status").isin("open", "done", "cancelled")), ["promise_id"], [F.col("seq")]).select(F.col("promise_id").alias("__p"), F.col("status").alias("__s"))
    return promises.join(last, promises["promise_id"] == F.col("__p"), "left").withColumn("status", F.coalesce("__s", "status")).drop("__p", "__s")


def append_reminders(promises: DataFrame, fire_at: Column) -> DataFrame:
    """Reminder rows; asking twice gives two."""
    return promises.select(F.concat(F.lit("reminder-"), F.col("promise_id").cast("string")).alias("reminder_id"), "promise_id", F.lit("pending").alias("status"), fire_at.alias("fire_at"))


def create_drafts(requests: DataFrame, people: DataFrame, facts: DataFrame, attribute: str = "email") -> DataFrame:
    """Drafts of requests (draft_id, person_id, subject, body, created_at): the address is the person's current fact, never the request's."""
    from ..operators.facts import current

    known = people.select("person_id", F.col("name").alias("to_name"))
    address = current(facts.where(F.col("attribute") == attribute)).select("person_id", F.col("claim").alias("to"))
    df = requests.join(known, "person_id", "left").join(address, "person_id", "left")
    return df.select("draft_id", "person_id", "to_name", "to", "subject", "body", "created_at", F.lit(None).cast("timestamp").alias("sent_at"))


def send_drafts(drafts: DataFrame, asked: DataFrame, at: Column) -> DataFrame:
    """Drafts with sent_at set for those asked for (draft_id, any number of times) that have a recipient; one that is sent stays as it is."""
    wanted = asked.select(F.col("draft_id").alias("__d")).distinct()
    ok = F.col("__d").isNotNull() & F.col("sent_at").isNull() & (F.trim(F.coalesce("to", F.lit(""))) != "")
    return drafts.join(wanted, F.col("draft_id") == F.col("__d"), "left").withColumn("sent_at", F.when(ok, at.cast("timestamp")).otherwise(F.col("sent_at"))).drop("__d")


def drafts_to_send(drafts: DataFrame) -> DataFrame:
    """Drafts, newest first, with whether they may be sent: once only, and with a recipient."""
    ok = F.col("sent_at").isNull() & (F.trim(F.coalesce("to", F.lit(""))) != "")
    return drafts.withColumn("sendable", ok).orderBy(F.col("created_at").desc(), "draft_id")


def write_snapshot(table: DataFrame, path: str) -> None:
    """A whole new version of a table."""
    table.write.mode("overwrite").parquet(path)


def ensure_tables(spark, base: str) -> list[str]:
    """Creates the folders of missing collections with their schemas; returns their names."""
    from ..schemas import TABLES

    made = []
    for name, schema in TABLES.items():
        try:
            spark.read.schema(schema).parquet(f"{base}/{name}").schema
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.createDataFrame([], schema).write.parquet(f"{base}/{name}")
            made.append(name)
    return made
