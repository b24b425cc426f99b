"""The change graph: what a new fact replaced, who has heard of it, and which promises it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import change_words
from ..session import settle


def pairs(facts: DataFrame) -> DataFrame:
    """Superseded facts with their successors; a pointer to nothing gives no change."""
    old = facts.where("superseded_by IS NOT NULL").select(
        F.col("fact_id").alias("before_id"), F.col("claim").alias("before_claim"), F.col("source_utterance_id").alias("before_source"),
        F.col("superseded_by").alias("change_id"), "superseded_at",
    )
    new = facts.select(F.col("fact_id").alias("change_id"), "person_id", "attribute", F.col("claim").alias("after_claim"), F.col("source_utterance_id").alias("after_source"), "valid_from")
    return old.join(new, "change_id")


def recorded_through(utterances: DataFrame) -> DataFrame:
    """(utterance_id, people): who had spoken, in a final turn, by the end of an utterance in its conversation.

    A running set per conversation instead of a join on inequality: turns that end together count for each other.
    """
    w = Window.partitionBy("conversation_id").orderBy("end_ms").rangeBetween(Window.unboundedPreceding, 0)
    person = F.when(F.col("is_final"), F.col("person_id"))
    return utterances.select("utterance_id", "conversation_id", F.array_sort(F.collect_set(person).over(w)).alias("people"))


def rooms(changes: DataFrame, utterances: DataFrame) -> DataFrame:
    """Changes with conversation_id, recorded_with and may_have_missed (sorted ids; sources may be missing)."""
    heard = recorded_through(utterances)
    new = heard.select(F.col("utterance_id").alias("after_source"), "conversation_id", F.col("people").alias("new_room"))
    old = heard.select(F.col("utterance_id").alias("before_source"), F.col("people").alias("old_room"))
    none = F.array().cast("array<bigint>")
    df = changes.join(new, "after_source", "left").join(old, "before_source", "left")
    df = df.withColumns({"recorded_with": F.coalesce("new_room", none), "old_room": F.coalesce("old_room", none)})
    missed = F.array_except(F.array_except("old_room", "recorded_with"), F.array("person_id"))
    return df.withColumn("may_have_missed", F.array_sort(missed)).drop("new_room", "old_room")


def _top(df: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("promise_id")
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def names_in(promises: DataFrame, names: DataFrame, head: int = 6) -> DataFrame:
    """(promise_id, name) of the names (distinct, in lower case) that a promise's text contains.

    Places where the first few characters of some name stand are found by a join on these; only there the text is cut to the
    lengths that names with this head have, and what is cut must equal a name. So neither all lengths of names
    nor all names with a common head multiply the text.
    """
    span = names.agg(F.min(F.length("name")).alias("least"), F.max(F.length("name")).alias("most")).first()
    if span.least is None:
        return promises.select("promise_id", F.lit("").alias("name")).limit(0)
    head = min(head, span.least)
    heads = settle(names.groupBy(F.left("name", F.lit(head)).alias("head")).agg(F.collect_set(F.length("name")).alias("lengths")))
    if heads.limit(HEADS + 1).count() <= HEADS:
        heads = F.broadcast(heads)
    text = F.lower("text")
    tails = F.transform(F.sequence(F.lit(1), F.length(text) - head + 1), lambda i: F.substr(text, i, F.lit(span.most)))
    places = promises.where(F.length("text") >= head).select("promise_id", F.explode(tails).alias("tail"))
    places = places.join(heads, F.left("tail", F.lit(head)) == F.col("head"))
    cuts = places.select("promise_id", "tail", F.explode("lengths").alias("n")).where(F.length("tail") >= F.col("n"))
    return cuts.select("promise_id", F.left("tail", F.col("n")).alias("name")).distinct().join(names, "name", "left_semi").select("promise_id", "name")


#: Heads of names up to this many are broadcast (a head has a few characters and a few lengths).
HEADS = 50_000


def affected_promises(changes: DataFrame, promises: DataFrame, people: DataFrame, most: int = 3) -> DataFrame:
    """(change_id, promise_id): the first ``most`` open promises, by id, that a change may touch.

    A promise is touched if it is the person's own, names the person, or shares a keyword with either claim. Each of the
    three conditions is an equi-join, on the person, on names found in the text, and on keywords; since only the first
    few ids count, each key keeps only its first few promises before the join, so that a common keyword or name can't
    multiply.
    """
    promises = promises.where("status = 'open'").select("promise_id", "person_id", "text")
    named = people.select(F.col("person_id"), F.lower(F.trim("name")).alias("name")).where("name != ''")
    subject = changes.select("change_id", "person_id", "before_claim", "after_claim").join(named, "person_id", "left").withColumn("name", F.coalesce("name", F.lit("unknown speaker")))
    subject = settle(subject)  # read by every branch

    own = _top(promises.select("promise_id", "person_id"), "person_id", most)
    found = [subject.select("change_id", "person_id").join(own, "person_id").select("change_id", "promise_id")]

    mentions = names_in(promises.select("promise_id", "text"), subject.select("name").distinct())
    found.append(subject.select("change_id", "name").join(_top(mentions, "name", most), "name").select("change_id", "promise_id"))

    words = F.array_union(change_words(F.col("before_claim")), change_words(F.col("after_claim")))
    wanted = subject.select("change_id", F.explode(words).alias("word"))
    by_word = promises.select("promise_id", F.explode(change_words(F.col("text"))).alias("word"))
    found.append(wanted.join(_top(by_word, "word", most), "word").select("change_id", "promise_id"))

    all_found = found[0].unionByName(found[1]).unionByName(found[2]).distinct()
    return _top(all_found, "change_id", most)


def context_changes(facts: DataFrame, utterances: DataFrame, people: DataFrame, promises: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per change: claims, rooms and affected promises, ids in sorted arrays; ``limit`` takes the newest 1 to 25."""
    changes = pairs(settle(facts))  # both sides of the pairs read it
    if limit is not None:
        changes = changes.orderBy(F.col("superseded_at").desc(), F.col("valid_from").desc(), "change_id").limit(max(1, min(limit, 25)))
    changes = settle(changes)  # three branches and the result read it
    known = people.select(F.col("person_id").alias("p"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Unknown speaker")).alias("person_name"))
    touched = affected_promises(changes, promises, people).groupBy("change_id").agg(F.array_sort(F.collect_list("promise_id")).alias("affected_promises"))
    out = rooms(changes, utterances).join(known, F.col("person_id") == F.col("p"), "left").join(touched, "change_id", "left")
    return out.select(
        "change_id", "person_id", F.coalesce("person_name", F.lit("Unknown speaker")).alias("person_name"), "attribute", "before_id", "before_claim", "after_claim", "valid_from",
        F.when(F.col("conversation_id").isNotNull(), F.col("after_source")).alias("source_utterance_id"), "conversation_id", "recorded_with", "may_have_missed",
        F.coalesce("affected_promises", F.array().cast("array<bigint>")).alias("affected_promises"),
    )


def named(ids: DataFrame, key: str, column: str, people: DataFrame) -> DataFrame:
    """(key, id, name) of the people in an array column; ids without a person are left out."""
    p = people.select(F.col("person_id").alias("id"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Unknown speaker")).alias("name"))
    return ids.select(key, F.explode(column).alias("id")).join(p, "id").select(key, "id", "name")
