"""Append-only facts: supersession, current value, history, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute_aliases, canonical_attribute
from ..session import settle


def _order(ts: str = "valid_from", key: str = "fact_id") -> list:
    return [F.col(ts), F.col(key)]


def supersede(candidates: DataFrame, keys: tuple[str, ...] = ("person_id", "attribute")) -> DataFrame:
    """Facts of candidates that all replace: a repeat of the current claim is no fact; the next fact closes the one before.

    One shuffle by key; two windows over the same order.
    """
    w = Window.partitionBy(*keys).orderBy(*_order())
    kept = candidates.withColumn("__same", F.lag("claim").over(w).eqNullSafe(F.col("claim")) & F.lag("fact_id").over(w).isNotNull()).where("NOT __same").drop("__same")
    return kept.withColumns({"superseded_by": F.lead("fact_id").over(w), "superseded_at": F.lead("valid_from").over(w)})


def live(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("superseded_by").isNull())


def superseded(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("superseded_by").isNotNull())


def current(facts: DataFrame) -> DataFrame:
    """The current fact of each (person, slot): the live one with the latest valid_from, the largest id on a tie."""
    w = Window.partitionBy("person_id", "slot").orderBy(F.col("valid_from").desc(), F.col("fact_id").desc())
    return live(facts).withColumn("slot", canonical_attribute(F.col("attribute"))).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def resolve(facts: DataFrame, person: int, attribute: str) -> DataFrame:
    """Current value of one slot under any of its names."""
    mine = live(facts).where((F.col("person_id") == person) & F.col("attribute").isin(attribute_aliases(attribute)))
    return mine.orderBy(F.col("valid_from").desc(), F.col("fact_id").desc()).limit(1)


def history(facts: DataFrame, person: int, attribute: str) -> DataFrame:
    return facts.where((F.col("person_id") == person) & F.col("attribute").isin(attribute_aliases(attribute))).orderBy(*_order())


def recent(facts: DataFrame, person: int | None = None) -> DataFrame:
    """Live facts, newest first."""
    rows = live(facts) if person is None else live(facts).where(F.col("person_id") == person)
    return rows.orderBy(F.col("valid_from").desc(), F.col("fact_id").desc())


def lineage(facts: DataFrame) -> DataFrame:
    """Each successor with the claim that it replaced."""
    old = facts.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("new_id"), F.col("fact_id").alias("old_id"), F.col("claim").alias("old_claim"))
    return facts.select(F.col("fact_id").alias("new_id"), F.col("claim").alias("new_claim")).join(old, "new_id")


def chains(facts: DataFrame) -> DataFrame:
    """fact_id, root_id, depth of each fact in its supersession chain, along the stored pointers.

    Pointer doubling: a row knows an ancestor and the way to it; each round joins it to that ancestor's own, so a chain of n
    facts takes log2(n) equi-joins. Rows that have reached their root stay out of further joins, and those that haven't
    all point to different facts of a chain, so that no root becomes a hot key. A pointer to a fact that isn't there
    ends the chain.
    """
    edges = facts.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("fact_id"), F.col("fact_id").alias("up"))
    edges = edges.groupBy("fact_id").agg(F.min("up").alias("up"))
    state = facts.select("fact_id").join(edges, "fact_id", "left").select("fact_id", F.coalesce("up", "fact_id").alias("root_id"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNull().alias("done"))
    state = settle(state)
    for _ in range(63):  # a chain of 2**63 facts doesn't exist; pointers in a circle would go on for ever
        if state.where("NOT done").isEmpty():
            return state.drop("done")
        above = state.select(F.col("fact_id").alias("root_id"), F.col("root_id").alias("next"), F.col("depth").alias("more"), F.col("done").alias("last"))
        moved = state.where("NOT done").drop("done").join(above, "root_id").select("fact_id", F.col("next").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), F.col("last").alias("done"))
        state = settle(state.where("done").unionByName(moved))
    raise ValueError("the pointers run in a circle")


def fold_candidates(rows: list[dict], spoken: bool = False) -> list[dict]:
    """Facts of one (person, slot), from candidates in order; each may carry ``relation`` (replace, refine, coexist).

    A candidate already recorded (same source and claim) is skipped; without a current fact it is recorded; one that
    repeats the current claim, or is older than it, is skipped; else it closes the current fact (a refinement keeps its
    valid_from), or stands beside it. ``spoken`` sets values by voice: the source is the transition itself.
    """
    facts: list[dict] = []
    seen = set()
    for r in rows:
        alive = [f for f in facts if f["superseded_by"] is None]
        now = max(alive, key=lambda f: (f["valid_from"], f["fact_id"]), default=None)
        if spoken:
            if now and now["claim"] == r["claim"]:
                continue
            relation = "replace"
        else:
            if (r["source_utterance_id"], r["claim"]) in seen:
                continue
            if now and (now["claim"] == r["claim"] or r["position"] <= now["position"]):
                continue
            relation = r.get("relation") or "replace"
        seen.add((r["source_utterance_id"], r["claim"]))
        new = {**r, "superseded_by": None, "superseded_at": None}
        if now and relation != "coexist":
            now["superseded_by"], now["superseded_at"] = r["fact_id"], r["created_at"]
            if relation == "refine":
                new["valid_from"] = now["valid_from"]
        facts.append(new)
    return facts


_FOLD = "person_id long, slot string, fact_id long, claim string, source_utterance_id long, position long, valid_from timestamp, created_at timestamp, relation string, superseded_by long, superseded_at timestamp"


def reconcile(candidates: DataFrame, spoken: bool = False) -> DataFrame:
    """Facts after reconciling candidates per (person, canonical slot), where relations make the window form insufficient.

    candidates: person_id, attribute, fact_id, claim (normalized), source_utterance_id, position (order of the source),
    valid_from, created_at, relation. They arrive in the order of fact_id. Slots are sorted next to each other and streamed through
    a task; the candidates of one slot are in memory at a time.
    """
    import pandas as pd

    names = [c.split()[0] for c in _FOLD.split(", ")]
    keys = ["person_id", "slot"]

    def run(batches):
        key, held = None, []

        def out(rows: list[dict]) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names)
            frame["superseded_by"] = frame["superseded_by"].astype("Int64")
            frame["superseded_at"] = pd.to_datetime(frame["superseded_at"])
            return frame

        for pdf in batches:
            done = []
            for r in pdf.to_dict("records"):
                if (r["person_id"], r["slot"]) != key:
                    done += fold_candidates(held, spoken)
                    key, held = (r["person_id"], r["slot"]), []
                held.append(r)
            if done:
                yield out(done)
        if held:
            yield out(fold_candidates(held, spoken))

    rows = candidates.withColumn("slot", canonical_attribute(F.col("attribute"))).select(*[n for n in names if not n.startswith("superseded")])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fact_id").mapInPandas(run, _FOLD)


def guard(candidates: DataFrame, window: DataFrame, final_turn: DataFrame) -> DataFrame:
    """Model output that may be used: its source is the final turn, and its person is in the window."""
    a = candidates.join(final_turn.select("source_utterance_id"), "source_utterance_id", "left_semi")
    return a.join(window.select("person_id").distinct(), "person_id", "left_semi")


def predates(candidates: DataFrame, currents: DataFrame, utterances: DataFrame) -> DataFrame:
    """candidate_id, stale: whether a candidate's source is not later than that of the fact it would replace.

    The same source is stale; within a conversation the starts decide, across conversations the creation times; a
    source that is missing on either side can't make a candidate stale. ``candidates`` (candidate_id, source_utterance_id,
    current_id), ``currents`` (fact_id, source_utterance_id).
    """
    u = utterances.select(F.col("utterance_id"), "conversation_id", "start_ms", "created_at")
    new = u.select(F.col("utterance_id").alias("source_utterance_id"), F.col("conversation_id").alias("nc"), F.col("start_ms").alias("ns"), F.col("created_at").alias("na"))
    old = u.select(F.col("utterance_id").alias("old_source"), F.col("conversation_id").alias("oc"), F.col("start_ms").alias("os"), F.col("created_at").alias("oa"))
    pairs = candidates.join(currents.select(F.col("fact_id").alias("current_id"), F.col("source_utterance_id").alias("old_source")), "current_id")
    df = pairs.join(new, "source_utterance_id", "left").join(old, "old_source", "left")
    known = F.when(F.col("nc") == F.col("oc"), F.col("ns") <= F.col("os")).otherwise(F.col("na") <= F.col("oa"))
    stale = F.when(F.col("source_utterance_id") == F.col("old_source"), True).when(F.col("nc").isNull() | F.col("oc").isNull(), False).otherwise(known)
    return df.select("candidate_id", stale.alias("stale"))
