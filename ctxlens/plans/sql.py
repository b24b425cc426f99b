"""The memory in SQL: views over the tables and what follows from them, and functions for what takes an argument."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Memory
from ..functions.text import normalize_claim
from ..operators import changes, facts, views

#: Table functions: name -> (parameters, query).
FUNCTIONS = {
    "fact_history": ("person BIGINT, attribute STRING", "SELECT f.* FROM facts f WHERE f.person_id = fact_history.person AND f.slot = fact_history.attribute ORDER BY f.valid_from, f.fact_id"),
    "fact_now": ("person BIGINT, attribute STRING", "SELECT f.* FROM current_facts f WHERE f.person_id = fact_now.person AND f.slot = fact_now.attribute"),
    "loops_of": ("person BIGINT, wanted STRING", "SELECT p.* FROM promises p WHERE p.person_id = loops_of.person AND p.status = loops_of.wanted ORDER BY p.due_at NULLS FIRST, p.created_at, p.promise_id"),
    "said_in": ("conversation BIGINT", "SELECT u.* FROM utterances u WHERE u.conversation_id = said_in.conversation ORDER BY u.start_ms, u.utterance_id"),
    "texts_with": ("needle STRING", "SELECT 'utterance' AS kind, CAST(u.utterance_id AS STRING) AS id, u.person_id, u.text FROM utterances u WHERE contains(lower(u.text), lower(texts_with.needle)) UNION ALL "
        "SELECT 'promise', CAST(p.promise_id AS STRING), p.person_id, p.text FROM promises p WHERE contains(lower(p.text), lower(texts_with.needle))"),
}


def register(spark: SparkSession, memory: Memory) -> list[str]:
    """Temporary views and table functions of a snapshot; returns their names.

    Views: people, facts (with the slot and the normalized claim), promises, utterances, current_facts, superseded_facts, fact_lineage, context_changes, claims_of_people.
    Views are lazy, but for context_changes, whose intermediate results are stored at once.
    """
    slots = memory.facts.withColumns({"slot": F.col("attribute"), "claim_normalized": normalize_claim(F.col("claim"))})
    made = {
        "people": memory.people,
        "facts": slots,
        "promises": memory.promises,
        "utterances": memory.utterances,
        "current_facts": facts.current(memory.facts),
        "superseded_facts": facts.superseded(memory.facts),
        "fact_lineage": facts.lineage(memory.facts),
        "claims_of_people": views.claims_of_people(memory.facts),
        "context_changes": changes.context_changes(memory.facts, memory.utterances, memory.people, memory.promises),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")
    return [*made, *FUNCTIONS]
