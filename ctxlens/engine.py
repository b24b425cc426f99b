"""The memory API over a set of tables: what callers of the service can ask."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import note_key
from .operators import changes, facts, identity, retrieval, views
from .sources import sinks


@dataclass(frozen=True)
class Memory:
    """Tables (people, facts, promises, utterances) as one snapshot; writes return a new one.

    Embeddings and model output come in as columns and tables; ids are any comparable type.
    """

    people: DataFrame
    facts: DataFrame
    promises: DataFrame
    utterances: DataFrame

    # reads

    def get_person(self, person) -> DataFrame:
        return self.people.where(F.col("person_id") == person).limit(1)

    def list_people(self) -> DataFrame:
        return views.people_by_name(self.people)

    def resolve_fact_state(self, person, attribute: str) -> tuple[DataFrame, DataFrame]:
        """(current fact, history) of one slot."""
        return facts.resolve(self.facts, person, attribute), facts.history(self.facts, person, attribute)

    def list_promises(self, status: str | None = None, person=None) -> DataFrame:
        return views.promises_by_due(self.promises, status, person)

    def list_conversations(self, conversations: DataFrame) -> DataFrame:
        return conversations.orderBy(F.col("started_at").desc(), "conversation_id")

    def list_utterances(self, conversation) -> DataFrame:
        return self.utterances.where(F.col("conversation_id") == conversation).orderBy("start_ms", "utterance_id")

    def context_changes(self, limit: int = 10) -> DataFrame:
        return changes.context_changes(self.facts, self.utterances, self.people, self.promises, limit)

    def search_memory(self, query: str, semantic: DataFrame | None = None, lexical: DataFrame | None = None, person=None, mode: str = "fused") -> DataFrame:
        """Facts by fused rank of the given legs (the lexical one is computed if absent), then promises and utterances."""
        pool = self.facts if person is None else self.facts.where(F.col("person_id") == person)
        terms = [t for t in query.lower().split() if t]
        if lexical is None:
            lexical = retrieval.bm25(pool, terms, "fact_id", F.concat_ws(" ", "claim", "attribute")) if terms else pool.select("fact_id", F.lit(0.0).alias("score")).limit(0)
        if semantic is None:
            semantic = lexical.limit(0)
        hits = retrieval.search_facts(self.facts, semantic, lexical, mode)
        return retrieval.search_memory(hits, self.facts, retrieval.search_text(query, self.promises, self.utterances, person))

    def ask(self, query: str, **options) -> DataFrame:
        """Evidence for an answer: search results, without utterances if there is any fact."""
        return retrieval.prefer_facts(self.search_memory(query, **options).withColumn("query_id", F.lit(query)))

    # writes

    def record_facts(self, candidates: DataFrame) -> Memory:
        """Appends candidates that are new under (source, claim); each closes the live fact it replaces by ``supersedes``."""
        fresh = sinks.insert_once(self.facts, candidates, ["source_utterance_id", "claim"], [F.col("fact_id")])
        closing = fresh.where("supersedes IS NOT NULL").groupBy("supersedes").agg(F.min(F.struct("valid_from", "fact_id")).alias("by"))
        old = self.facts.join(closing, self.facts["fact_id"] == F.col("supersedes"), "left")
        old = old.withColumns({"superseded_by": F.coalesce("superseded_by", "by.fact_id"), "superseded_at": F.coalesce("superseded_at", "by.valid_from")}).select(*self.facts.columns)
        new = fresh.withColumns({"superseded_by": F.lit(None).cast(self.facts.schema["superseded_by"].dataType), "superseded_at": F.lit(None).cast(self.facts.schema["superseded_at"].dataType)})
        return replace(self, facts=old.unionByName(new.select(*self.facts.columns)))

    def set_fact(self, person, attribute: str, claim: str, fact_id, at) -> Memory:
        """A value said out loud: no new fact if it is current; else the current fact of the slot is closed. fact_id and at are the caller's."""
        now = facts.resolve(self.facts, person, attribute).first()  # one row
        if now is not None and now["claim"] == claim:
            return self
        kinds = self.facts.schema
        value = {
            "fact_id": F.lit(fact_id), "person_id": F.lit(person), "attribute": F.lit(attribute), "claim": F.lit(claim), "valid_from": F.lit(at),
            "source_utterance_id": F.lit(None) if kinds["source_utterance_id"].dataType.simpleString() != "string" else F.lit(f"spoken-{attribute}-{now['fact_id'] if now else 'initial'}"),
        }
        row = self.facts.sparkSession.range(1).select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds], F.lit(now["fact_id"] if now else None).cast(kinds["fact_id"].dataType).alias("supersedes"))
        return self.record_facts(row)

    def set_birthday(self, person, birthday: str, fact_id, at) -> Memory:
        return self.set_fact(person, "birthday", birthday, fact_id, at)

    def add_note(self, person, text: str, fact_id, at) -> Memory:
        """Appends a note; the same text twice (under text source keys) is one note."""
        kinds = self.facts.schema
        note = {"fact_id": F.lit(fact_id), "person_id": F.lit(person), "attribute": F.lit("note"), "claim": F.lit(text), "valid_from": F.lit(at)}
        if kinds["source_utterance_id"].dataType.simpleString() == "string":
            note["source_utterance_id"] = note_key(F.lit(text))
        row = self.facts.sparkSession.range(1).select(*[note.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds], F.lit(None).cast(kinds["fact_id"].dataType).alias("supersedes"))
        return self.record_facts(row)

    def set_name(self, person, name: str) -> tuple[Memory, DataFrame]:
        """The new snapshot and one relabel event per conversation of the person."""
        people = self.people.withColumn("name", F.when(F.col("person_id") == person, F.lit(name)).otherwise(F.col("name")))
        events = identity.relabel_events(self.utterances.where(F.col("person_id") == person), people)
        return replace(self, people=people), events

    def set_promise_status(self, promise, status: str) -> Memory:
        if status not in ("open", "done", "cancelled"):
            raise ValueError(f"no such status: {status}")
        changed = F.when(F.col("promise_id") == promise, F.lit(status)).otherwise(F.col("status"))
        return replace(self, promises=self.promises.withColumn("status", changed))

    def create_reminder(self, promise, fire_at: Column) -> DataFrame:
        return sinks.append_reminders(self.promises.where(F.col("promise_id") == promise), fire_at)

    def merge(self, merges: DataFrame, inherit_name: bool = False) -> Memory:
        """Merges people by merge_id; facts, promises and utterances follow the oldest one."""
        mapping = identity.merge_mapping(merges, self.people)
        people, moved = identity.merge_people(self.people, {"facts": self.facts, "promises": self.promises, "utterances": self.utterances}, mapping, inherit_name)
        return Memory(people, moved["facts"], moved["promises"], moved["utterances"])

    def delete_conversation(self, conversation, repair: bool = False) -> tuple[Memory, DataFrame]:
        """The snapshot without a conversation and what came of it, and the counts."""
        kept, counts = sinks.cascade_delete(F.lit(conversation), self.utterances, self.facts, self.promises, repair)
        return replace(self, **kept), counts
