"""Attribution of voices to people; enrolment, naming and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ATTRIBUTION_THRESHOLD, EMBED_MIN_MS, OWNER_THRESHOLD
from ..sources.sinks import repoint
from .retrieval import knn
from .scoring import decide


def with_people(hits: DataFrame, people: DataFrame) -> DataFrame:
    """Hits whose person exists. The k nearest are taken before, so orphans use up places among them."""
    return hits.join(people.select("person_id"), "person_id", "left_semi")


def best_per_person(hits: DataFrame) -> DataFrame:
    """Distinct people of each query by their best cosine: query_id, person_id, score, place."""
    best = hits.groupBy("query_id", "person_id").agg(F.max("cosine").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "person_id")
    return best.withColumn("place", F.row_number().over(w))


def attribute(clusters: DataFrame, voiceprints: DataFrame, people: DataFrame, threshold: float = ATTRIBUTION_THRESHOLD, margin: float = 0.0, floor_ms: int = EMBED_MIN_MS, final: bool = False) -> DataFrame:
    """One decision per cluster (query_id, query, speech_ms): kind, person_id, score.

    kind: pending (less speech than the floor), match, uncertain, or new. All clusters of a batch are held against the same
    snapshot of prints; a final ambiguous cluster takes the best person.
    """
    k = 12 if margin > 0 else 3
    prints = voiceprints.select("voiceprint_id", "person_id", "embedding")
    hits = knn(prints, clusters.where(F.col("speech_ms") >= floor_ms), k, "voiceprint_id").join(prints.select("voiceprint_id", "person_id"), "voiceprint_id")
    ranked = best_per_person(with_people(hits.where(F.col("cosine") >= threshold), people))
    wide = ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("place") == 1, F.col("person_id"))).alias("person_id"),
    )
    nan = F.lit(float("nan"))
    d = decide(F.coalesce("best", nan), F.coalesce("second", nan), threshold, threshold, margin)
    df = clusters.select("query_id", "speech_ms").join(wide, "query_id", "left").withColumn("d", d)
    ambiguous = (F.col("d.kind") == "uncertain") & F.lit(final)
    kind = F.when(F.col("speech_ms") < floor_ms, "pending").when(ambiguous, "match").otherwise(F.col("d.kind"))
    return df.select("query_id", kind.alias("kind"), F.when(kind == "match", F.col("person_id")).alias("person_id"), F.when(F.col("speech_ms") >= floor_ms, F.col("best")).alias("score"))


def attribute_minting(clusters: DataFrame, voiceprints: DataFrame, people: DataFrame, group: str, threshold: float = ATTRIBUTION_THRESHOLD, floor_ms: int = EMBED_MIN_MS) -> DataFrame:
    """query_id, kind (pending, match, new), person_id: clusters in order, where the print of a new person is known to the next.

    clusters: group, seq, query_id, query, speech_ms. Known prints are searched for all clusters at once; only what a group
    has minted itself is met in a fold over the group (a session or tenant), in whose memory its new voices are. Of the three
    nearest prints, minted ones included, those below the threshold and those of nobody drop out. Ids come out as text; a
    new person's is "person-" and the query's.
    """
    import numpy as np
    import pandas as pd

    prints = voiceprints.select("voiceprint_id", F.col("person_id").alias("__p"), "embedding")
    here = people.select(F.col("person_id").alias("__p"), F.lit(True).alias("here"))
    hits = knn(prints, clusters.where(F.col("speech_ms") >= floor_ms), 3, "voiceprint_id").join(prints.drop("embedding"), "voiceprint_id").join(here, "__p", "left")
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cosine", F.when(F.col("here"), F.col("__p").cast("string")).alias("person")))).alias("hits"))
    kind = clusters.schema["query_id"].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        minted, names, out = [], [], []
        for r in pdf.sort_values("seq").itertuples():
            if not r.speech_ms >= floor_ms:
                out.append((r.query_id, "pending", None))
                continue
            v = np.asarray(r.query, "f8")
            v = v / (np.linalg.norm(v) or 1)
            near = [(h["cosine"], h["person"]) for h in (r.hits if r.hits is not None else [])]
            near += zip(np.round(np.array(minted) @ v, 12).tolist(), names, strict=True) if minted else []
            near = [p for c, p in sorted(near, key=lambda h: -h[0])[:3] if c >= threshold and p is not None]
            if not near:
                minted.append(v)
                names.append(f"person-{r.query_id}")
            out.append((r.query_id, "match", near[0]) if near else (r.query_id, "new", names[-1]))
        return pd.DataFrame(out, columns=["query_id", "kind", "person_id"])

    rows = clusters.select(group, "seq", "query_id", "query", "speech_ms").join(hits, "query_id", "left")
    return rows.groupBy(group).applyInPandas(fold, f"query_id {kind}, kind string, person_id string")


def attribute_in_order(clusters: list[tuple], prints: list[tuple], threshold: float = ATTRIBUTION_THRESHOLD) -> list[tuple]:
    """Attribution one cluster after the other, where a minted print is visible to the next: (query_id, kind, person_id).

    clusters: (query_id, vector); prints: (person_id, vector). For the small batches of a live session.
    """
    import numpy as np

    known = [(p, np.asarray(v, "f8")) for p, v in prints]
    out = []
    for q, v in clusters:
        v = np.asarray(v, "f8")
        cos = [(float(v @ x / (np.linalg.norm(v) * np.linalg.norm(x) or 1)), p) for p, x in known]
        best = max(cos, default=(-1.0, None), key=lambda c: c[0])
        if best[0] >= threshold:
            out.append((q, "match", best[1]))
        else:
            out.append((q, "new", f"person-{q}"))
            known.append((f"person-{q}", v))
    return out


def owner_gate(queries: DataFrame, voiceprints: DataFrame, people: DataFrame, threshold: float = OWNER_THRESHOLD) -> DataFrame:
    """query_id, is_owner, confidence: the best of the owner's prints; no owner or no print gives (false, 0)."""
    owner = people.where("is_owner").select("person_id")
    mine = voiceprints.join(owner, "person_id", "left_semi")
    best = knn(mine, queries, 1, "voiceprint_id").select("query_id", F.col("cosine").alias("confidence"))
    out = queries.select("query_id").join(best, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out.select("query_id", (F.col("confidence") >= threshold).alias("is_owner"), "confidence")


def owner_confidence(utterances: DataFrame, gate: DataFrame, key: str = "utterance_id", lagged: bool = False) -> DataFrame:
    """Utterances with the confidence of the owner gate (query_id, confidence) for them, 0 where there is none.

    ``lagged``: the last one known before the utterance in its conversation, as a live caller has it while a voice is looked up.
    """
    g = gate.select(F.col("query_id").alias("__q"), F.col("confidence").alias("__c"))
    df = utterances.join(g, F.col(key) == F.col("__q"), "left")
    if lagged:
        w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("__c", F.last("__c", ignorenulls=True).over(w))
    return df.withColumn("confidence", F.coalesce("__c", F.lit(0.0))).drop("__q", "__c")


def wake_allowed(command, person_id, owner_id, confidence, threshold: float = OWNER_THRESHOLD):
    """Whether a wake command counts: there is one, the owner said it, and the voice is known well enough; null fails."""
    return F.coalesce(command.isNotNull() & (person_id == owner_id) & (confidence >= threshold), F.lit(False))


def stamp(utterances: DataFrame, decisions: DataFrame) -> DataFrame:
    """Utterances with the person of their cluster where it is matched: decisions(cluster_id, person_id)."""
    d = decisions.where("person_id IS NOT NULL").select(F.col("cluster_id").alias("__c"), F.col("person_id").alias("__p"))
    return utterances.join(d, utterances["cluster_id"] == F.col("__c"), "left").withColumn("person_id", F.coalesce("__p", "person_id")).drop("__c", "__p")


def enroll(voiceprints: DataFrame, people: DataFrame, prints: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(voiceprints, people) with new prints; a print without a person brings one (``name``, else "Unknown"; id of the print).

    A vector of another length, a missing one, or a person who doesn't exist is an error when either result is computed.
    """
    known = people.select(F.col("person_id").alias("__p"))
    fits = F.coalesce(F.size("embedding") == dims, F.lit(False))
    there = F.col("person_id").isNull() | F.col("__p").isNotNull()
    checked = prints.join(known, F.col("person_id") == F.col("__p"), "left")
    fine = F.assert_true(fits, F.lit(f"voiceprints must have {dims} dimensions")).isNull() & F.assert_true(there, F.lit("unknown person")).isNull()
    checked = checked.withColumn("embedding", F.when(fine, F.col("embedding")))
    owner = F.coalesce("person_id", F.col("voiceprint_id").cast(people.schema["person_id"].dataType))
    columns = {"person_id": owner, "name": F.coalesce("name", F.lit("Unknown"))}
    fresh = checked.where("person_id IS NULL AND embedding IS NOT NULL").select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in people.schema])
    return voiceprints.unionByName(checked.withColumn("person_id", owner).select(*voiceprints.columns)), people.unionByName(fresh)


def relabel_events(utterances: DataFrame, people: DataFrame) -> DataFrame:
    """One event per (person, conversation): person_id, conversation_id, utterance_ids in order."""
    mine = utterances.join(people.select("person_id"), "person_id", "left_semi")
    return mine.groupBy("person_id", "conversation_id").agg(F.array_sort(F.collect_list("utterance_id")).alias("utterance_ids"))


def merge_mapping(merges: DataFrame, people: DataFrame, strict: bool = True) -> DataFrame:
    """(old_id, new_id) of merge requests (merge_id, person_id): the oldest person of each survives, the smaller id on a tie.

    A request counts if it names at least two different people and all exist; if not ``strict``, who doesn't exist is ignored.
    """
    asked = merges.distinct().join(people.select("person_id", "created_ms", F.lit(1).alias("here")), "person_id", "left")
    asked = asked if strict else asked.where("here = 1")
    ok = asked.groupBy("merge_id").agg(F.count(F.lit(1)).alias("n"), F.count("here").alias("found"), F.min(F.struct("created_ms", "person_id")).alias("first")).where("n >= 2 AND n = found")
    return asked.join(ok, "merge_id").where(F.col("person_id") != F.col("first.person_id")).select(F.col("person_id").alias("old_id"), F.col("first.person_id").alias("new_id"))


def merge_people(people: DataFrame, tables: dict[str, DataFrame], mapping: DataFrame, inherit_name: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """People without the merged ones, and the tables with their person_id repointed.

    The survivor keeps its own name; with ``inherit_name`` an empty one takes the first non-empty name of those merged.
    """
    gone = mapping.select(F.col("old_id").alias("__old"))
    left = people.join(gone, people["person_id"] == F.col("__old"), "left_anti")
    if inherit_name:
        named = mapping.join(people.where(F.trim("name") != ""), mapping["old_id"] == people["person_id"]).groupBy("new_id").agg(F.min(F.struct("created_ms", "person_id", "name")).alias("first"))
        left = left.join(named, left["person_id"] == named["new_id"], "left").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("first.name"), F.col("name"))).drop("new_id", "first")
    return left, {name: repoint(t, "person_id", mapping) for name, t in tables.items()}


def baseline_verdicts(turns: DataFrame, voiceprints: DataFrame, threshold: float = ATTRIBUTION_THRESHOLD, floor_ms: int = EMBED_MIN_MS) -> DataFrame:
    """Turns (query_id, query, person_id, duration_ms) attributed one by one: verdict pending, right, wrong or new."""
    hits = knn(voiceprints.select("voiceprint_id", "embedding"), turns.select("query_id", "query"), 1, "voiceprint_id").join(voiceprints.select("voiceprint_id", F.col("person_id").alias("found")), "voiceprint_id")
    df = turns.join(hits.select("query_id", "cosine", "found"), "query_id", "left")
    verdict = F.when(F.col("duration_ms") < floor_ms, "pending").when(~F.coalesce(F.col("cosine") >= threshold, F.lit(False)), "new").when(F.col("found") == F.col("person_id"), "right").otherwise("wrong")
    return df.withColumn("verdict", verdict)
