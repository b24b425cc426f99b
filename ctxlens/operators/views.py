"""Lists and sections as callers see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_name, is_noise, is_unnamed
from ..session import settle
from .facts import live

WAITING = "Waiting for a name"


def numbered(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """Rows sorted by group and a total order, with their place in the group from 1 on: numbered within the sort's ranges and over their sizes, so a
    group of any size is many tasks'. ``group`` isn't null.
    """
    rows = settle(df.orderBy(group, *order).withColumn("__id", F.monotonically_increasing_id())).withColumns({"__part": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__part", group).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))  # a row for each range and group in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.withColumn("__before", before).drop("n")), ["__part", group]).withColumn("place", F.col("__before") + F.col("__i") - F.col("__first") + 1).drop("__id", "__part", "__i", "__first", "__before")


def people_by_name(people: DataFrame, locale: bool = False) -> DataFrame:
    """By name in byte order; with ``locale`` in the order of the Unicode collation."""
    return people.orderBy(F.collate("name", "UNICODE") if locale else F.col("name"), "person_id")


def claims_of_people(facts: DataFrame) -> DataFrame:
    """person_id, claims: live claims in the order of (valid_from, id), joined for search."""
    return live(facts).groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "fact_id", "claim"))), lambda x: x["claim"]), " ").alias("claims"))


def search_people(people: DataFrame, facts: DataFrame, needle: str) -> DataFrame:
    """People whose name, relationship or live claims contain the needle; all if it is blank."""
    needle = needle.strip().lower()
    if not needle:
        return people
    df = people.join(claims_of_people(facts), "person_id", "left")
    return df.where(F.contains(F.lower(F.concat_ws(" ", display_name(F.col("name")), "relationship", "claims")), F.lit(needle))).drop("claims")


def people_sections(people: DataFrame) -> DataFrame:
    """section, place of each person: unnamed ones first, then by initial."""
    unnamed = is_unnamed(F.col("name"))
    section = F.when(unnamed, WAITING).otherwise(F.upper(F.left(F.trim("name"), F.lit(1))))
    df = people.withColumn("section", section).withColumn("first", ~unnamed)
    return numbered(df, "section", "name", "person_id").orderBy("first", "section", "place").drop("first")


def loops(promises: DataFrame, owner: int = 0) -> DataFrame:
    """list (owed, owing, closed) and place by due date, undated last."""
    kind = F.when(F.col("status") != "open", "closed").when(F.col("person_id") == owner, "owing").otherwise("owed")
    return numbered(promises.withColumn("list", kind), "list", F.col("due_at").asc_nulls_last(), "promise_id")


def promises_by_due(promises: DataFrame, status: str | None = None, person: int | None = None) -> DataFrame:
    """By due date, undated first, then by creation."""
    if status is not None:
        promises = promises.where(F.col("status") == status)
    if person is not None:
        promises = promises.where(F.col("person_id") == person)
    return promises.orderBy(F.col("due_at").asc_nulls_first(), "created_at", "promise_id")


def conversation_counts(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("utterances"))


def non_empty(conversations: DataFrame, utterances: DataFrame) -> DataFrame:
    return conversations.join(utterances.select("conversation_id"), "conversation_id", "left_semi")


def participants(utterances: DataFrame, people: DataFrame) -> DataFrame:
    """conversation_id, person_id, name of those who spoke; ids without a person are left out."""
    spoke = utterances.where("person_id IS NOT NULL").select("conversation_id", "person_id").distinct()
    return spoke.join(people.select("person_id", "name"), "person_id").select("conversation_id", "person_id", "name")


def conversations_of(conversations: DataFrame, person: Column) -> DataFrame:
    return conversations.where(F.array_contains("participant_ids", person))


def readable_lines(utterances: DataFrame) -> DataFrame:
    """Lines without noise and without a line that repeats the one before (compared after noise is out, trimmed)."""
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id")
    kept = utterances.where(~is_noise(F.col("text"))).withColumn("previous", F.lag(F.trim("text")).over(w))
    return kept.where(~F.col("previous").eqNullSafe(F.trim("text"))).drop("previous")


def title_transcript(utterances: DataFrame, people: DataFrame, turns: int = 60, chars: int = 6000) -> DataFrame:
    """conversation_id, lines, transcript: named lines within the budget, up to the first one that would exceed it."""
    u = utterances.where(F.trim("text") != "").join(people.select("person_id", "name"), "person_id", "left")
    line = F.concat(F.coalesce(F.nullif("name", F.lit("")), F.lit("Someone")), F.lit(": "), F.trim("text"))
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id")
    u = u.select("conversation_id", "start_ms", "utterance_id", line.alias("line")).withColumn("n", F.row_number().over(w))
    u = u.withColumn("used", F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("n") <= turns) & (F.col("used") <= chars))
    return u.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


def inferred_sources(facts: DataFrame, utterances: DataFrame) -> DataFrame:
    """fact_id, source: the last final utterance (by end, then id) of the fact's person."""
    last = utterances.where("is_final AND person_id IS NOT NULL").groupBy("person_id").agg(F.max(F.struct("end_ms", "utterance_id")).alias("l"))
    return facts.select("fact_id", "person_id").join(last, "person_id", "left").select("fact_id", F.col("l.utterance_id").alias("source"))


def due_notifications(promises: DataFrame, now: Column, already: DataFrame | None = None) -> DataFrame:
    """Open promises due more than a second from now that have no notification yet."""
    due = promises.where((F.col("status") == "open") & (F.col("due_at") > now + F.expr("INTERVAL 1 SECOND")))
    return due if already is None else due.join(already.select("promise_id"), "promise_id", "left_anti")


def cancelled_notifications(scheduled: DataFrame, promises: DataFrame) -> DataFrame:
    """Scheduled notifications to cancel: those whose promise isn't open, or isn't there, any more."""
    return scheduled.join(promises.where("status = 'open'").select("promise_id"), "promise_id", "left_anti")


def public_row(table: DataFrame) -> DataFrame:
    """Without vectors."""
    return table.drop("embedding")


def keyed(rows: DataFrame, group: str, key: str) -> DataFrame:
    """One map from id to row for each group, of a bounded set of rows per group; the last id in a tie wins nothing, ids being unique."""
    others = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*others))))).alias("by_id"))
