"""The event reducer: state from revisable events, as folds per entity in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_unnamed


def _latest(c: str, order: str = "seq"):
    """Value of the last row in which the column isn't null."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)


def utterance_state(events: DataFrame) -> DataFrame:
    """Utterances after all events: the last revision's text and times; a known person or print is never lost.

    An identity event names the person of utterances that exist by then; a later revision with a person overrides it.
    """
    u = events.where("type = 'utterance'")
    first = u.groupBy("utterance_id").agg(F.min("seq").alias("first_seq"))
    named = events.where("type = 'identity'").select("seq", "person_id", "voiceprint_id", F.explode("utterance_ids").alias("utterance_id"))
    named = named.join(first, "utterance_id").where("seq > first_seq").drop("first_seq")
    who = u.select("utterance_id", "seq", "person_id", "voiceprint_id").unionByName(named.select("utterance_id", "seq", "person_id", "voiceprint_id"))
    who = who.groupBy("utterance_id").agg(_latest("person_id"), _latest("voiceprint_id"))
    w = Window.partitionBy("utterance_id").orderBy(F.col("seq").desc())
    last = u.withColumn("n", F.row_number().over(w)).where("n = 1").select("utterance_id", "conversation_id", "text", "start_ms", "end_ms", "is_final")
    return last.join(who, "utterance_id")


def attributing(events: DataFrame) -> DataFrame:
    """Utterances announced as pending and not settled since; one that has a person can't become pending again."""
    pending = events.where("type = 'speaker_pending'").select("seq", F.explode("utterance_ids").alias("utterance_id"), F.lit("pending").alias("what"))
    settled = events.where("type = 'utterance' AND person_id IS NOT NULL").select("seq", "utterance_id", F.lit("settled").alias("what"))
    cleared = events.where("type = 'identity'").select("seq", F.explode("utterance_ids").alias("utterance_id"), F.lit("cleared").alias("what"))
    known = utterance_first_person(events)
    all_ = pending.unionByName(settled).unionByName(cleared).join(known, "utterance_id", "left")
    counted = all_.where("NOT (what = 'pending' AND coalesce(person_seq < seq, false))")
    return counted.groupBy("utterance_id").agg(F.max_by("what", "seq").alias("what")).where("what = 'pending'").select("utterance_id")


def utterance_first_person(events: DataFrame) -> DataFrame:
    """utterance_id, person_seq: when an utterance first had a person."""
    u = events.where("type = 'utterance'")
    first = u.groupBy("utterance_id").agg(F.min("seq").alias("first_seq"))
    named = events.where("type = 'identity'").select("seq", F.explode("utterance_ids").alias("utterance_id")).join(first, "utterance_id").where("seq > first_seq")
    own = u.where("person_id IS NOT NULL").select("utterance_id", "seq")
    return own.unionByName(named.select("utterance_id", "seq")).groupBy("utterance_id").agg(F.min("seq").alias("person_seq"))


def people_state(events: DataFrame) -> DataFrame:
    """person_id, name, voiceprint_id: the first proper name stays, else the last one given."""
    e = events.where("type = 'identity'")
    proper = F.min_by("name", F.when(~is_unnamed(F.col("name")), F.col("seq")))
    return e.groupBy("person_id").agg(F.coalesce(proper, F.max_by("name", "seq")).alias("name"), _latest("voiceprint_id"))


def conversation_state(events: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """conversation_id, title, ended_at, participant_ids in order of first appearance; a title typed by hand wins."""
    e = events.where("conversation_id IS NOT NULL AND type IN ('utterance', 'conversation', 'identity')")
    heads = e.groupBy("conversation_id").agg(
        F.max_by("title", F.when((F.col("type") == "conversation") & F.col("title").isNotNull(), F.col("seq"))).alias("title"),
        F.max_by("ended_at", F.when((F.col("type") == "conversation") & F.col("ended_at").isNotNull(), F.col("seq"))).alias("ended_at"),
    )
    people = e.where("person_id IS NOT NULL AND type != 'conversation'").groupBy("conversation_id", "person_id").agg(F.min("seq").alias("seq"))
    people = people.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "person_id"))), lambda x: x["person_id"]).alias("participant_ids"))
    out = heads.join(people, "conversation_id", "left").withColumn("participant_ids", F.coalesce("participant_ids", F.array().cast("array<string>")))
    if renamed is not None:
        r = renamed.select("conversation_id", F.col("title").alias("typed"))
        out = out.join(r, "conversation_id", "left").withColumn("title", F.coalesce("typed", "title")).drop("typed")
    return out


def fact_state(events: DataFrame) -> DataFrame:
    """fact_id, person_id, attribute, claim, first_seq, superseded_by: a fact event closes its predecessor, if that exists by then.

    A later event for the same fact opens it again, as it replaces the row.
    """
    e = events.where("type = 'fact'")
    rows = e.groupBy("fact_id").agg(F.max_by("person_id", "seq").alias("person_id"), F.max_by("attribute", "seq").alias("attribute"), F.max_by("claim", "seq").alias("claim"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    closing = e.where("superseded_fact_id IS NOT NULL").select(F.col("superseded_fact_id").alias("fact_id"), F.col("fact_id").alias("by"), "seq")
    closed = closing.join(rows.select("fact_id", "last_seq"), "fact_id").where("seq >= last_seq").groupBy("fact_id").agg(F.max_by("by", "seq").alias("superseded_by"))
    return rows.join(closed, "fact_id", "left").drop("last_seq")


def promise_state(events: DataFrame) -> DataFrame:
    """promise_id, person_id, text, status of the last event; the last known due date stays."""
    e = events.where("type = 'promise'")
    return e.groupBy("promise_id").agg(F.max_by("person_id", "seq").alias("person_id"), F.max_by("text", "seq").alias("text"), F.max_by("status", "seq").alias("status"), _latest("due_at"))


def agent_turns(events: DataFrame) -> DataFrame:
    """request_id, steps in order, reply, done of each request, from the assistant's events: types that end in _step and _audio."""
    e = events.where(F.endswith("type", F.lit("_step")) | F.endswith("type", F.lit("_audio")))
    step, audio = F.endswith("type", F.lit("_step")), F.endswith("type", F.lit("_audio"))
    steps = F.array_sort(F.collect_list(F.when(step, F.struct("seq", "step", "message"))))
    ended = F.max_by(audio | F.col("step").isin("denied", "error"), "seq")
    return e.groupBy("request_id").agg(F.transform(steps, lambda s: F.struct(s["step"].alias("step"), s["message"].alias("message"))).alias("steps"), F.max_by("text", F.when(audio, F.col("seq"))).alias("reply"), ended.alias("done"))
