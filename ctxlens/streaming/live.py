"""Attribution of voices while a conversation runs: clusters, attempts and minted prints as keyed state, with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.vector_index import VectorIndex, usable
from ..schemas import ATTRIBUTION_THRESHOLD, EMBED_MIN_MS
from ..session import keyed_states, settle

#: Prints that an attempt looks at, at most; people of the index that are broadcast, at most.
NEAREST, PEOPLE = 12, 100_000
OUT = "conversation_id string, cluster_id string, seq long, attempt long, kind string, person_id string, voiceprint_id string, score double, final boolean"


def choose(known: list[tuple[float, str | None, str]], minted: list[tuple[float, str, str]], threshold: float, margin: float) -> tuple[str, float | None, str | None, str | None]:
    """(kind, score, person, print) by the nearest prints; known and minted: (cosine, person or None if there is nobody, print).

    Of the three nearest (twelve with a margin), prints below the threshold and those of nobody drop out after the cut; a person counts once.
    """
    near = sorted([*known, *minted], key=lambda h: -h[0])[: NEAREST if margin > 0 else 3]
    people: dict[str, tuple[float, str]] = {}
    for cosine, person, voice in near:
        if cosine >= threshold and person is not None:
            people.setdefault(person, (cosine, voice))
    ranked = list(people.items())
    if not ranked:
        return "new", None, None, None
    person, (score, voice) = ranked[0]
    if margin > 0 and len(ranked) > 1 and score - ranked[1][1][0] < margin:
        return "ambiguous", score, person, voice
    return "match", score, person, voice


class Attribution(StatefulProcessor):
    """Decides on a conversation's clusters, event by event in order of seq.

    A cluster is tried at the floor of speech; while it stays ambiguous, again after as much new speech. After ``tries`` ambiguous
    attempts, at the end of the session, or ``idle_ms`` after its last event, the final attempt takes the best. A new voice becomes a
    person whose print the conversation's later clusters meet. Events not after the last seen one of their cluster are repeats.
    """

    def __init__(self, threshold: float, margin: float, floor_ms: int, tries: int, idle_ms: int):
        self.threshold, self.margin, self.floor_ms, self.tries, self.idle_ms = threshold, margin, floor_ms, tries, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "cluster_id string", "seq long, attempts long, at_ms long, done boolean, speech_ms long, query array<double>, cosines array<double>, people array<string>, voices array<string>")
        self.minted = handle.getMapState("minted", "person_id string", "voice array<double>")

    def close(self) -> None:
        pass

    def _try(self, conversation: str, cluster: str, s: dict, final: bool) -> tuple:
        v = np.array(s["query"], "f8")
        v = v / (np.linalg.norm(v) or 1)
        own = [(round(float(np.array(voice, "f8") @ v), 12), person, f"voice-{person}") for (person,), (voice,) in self.minted.iterator()]
        own.sort(key=lambda h: h[1])
        kind, score, person, voice = choose(list(zip(s["cosines"], s["people"], s["voices"], strict=True)), own, self.threshold, self.margin)
        if kind == "ambiguous" and final:
            kind = "match"
        s["attempts"], s["at_ms"], s["done"] = s["attempts"] + 1, s["speech_ms"], kind != "ambiguous"
        if kind == "new":
            person, voice = f"person-{cluster}", f"voice-person-{cluster}"
            self.minted.updateValue((person,), (v.tolist(),))
        return conversation, cluster, s["seq"], s["attempts"], kind, None if kind == "ambiguous" else person, None if kind == "ambiguous" else voice, score, final

    def _save(self, cluster: str, s: dict) -> None:
        self.clusters.updateValue((cluster,), tuple(s[k] for k in ("seq", "attempts", "at_ms", "done", "speech_ms", "query", "cosines", "people", "voices")))

    def _load(self, cluster: str) -> dict:
        if not self.clusters.containsKey((cluster,)):
            return {"seq": -1, "attempts": 0, "at_ms": 0, "done": False}
        return dict(zip(("seq", "attempts", "at_ms", "done", "speech_ms", "query", "cosines", "people", "voices"), self.clusters.getValue((cluster,)), strict=True))

    def _last_attempts(self, conversation: str) -> list[tuple]:
        out = []
        for cluster in sorted(k for (k,) in self.clusters.keys()):
            s = self._load(cluster)
            if not s["done"] and s["attempts"] and s["speech_ms"] >= self.floor_ms:
                out.append(self._try(conversation, cluster, s, True))
                self._save(cluster, s)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows)
        hits: dict[tuple, list] = {}
        for h in events[events["cosine"].notna()].itertuples():
            hits.setdefault((h.cluster_id, h.seq), []).append((h.cosine, h.voiceprint_id, h.person_id if isinstance(h.person_id, str) else None))
        out, moment = [], 0
        for e in events[events["cosine"].isna()].sort_values(["seq", "cluster_id"]).itertuples():
            s = self._load(e.cluster_id)
            moment = max(moment, int(pd.Timestamp(e.at).timestamp() * 1000))
            if e.seq <= s["seq"]:
                continue
            near = sorted(hits.get((e.cluster_id, e.seq), []), key=lambda h: (-h[0], h[1]))[:NEAREST]  # of all prints of the index, so more can't matter
            s |= {"seq": int(e.seq), "speech_ms": int(e.speech_ms), "query": [float(x) for x in e.query], "cosines": [float(h[0]) for h in near], "people": [h[2] for h in near], "voices": [h[1] for h in near]}
            final = bool(e.ending) or s["attempts"] >= self.tries
            if not s["done"] and s["speech_ms"] >= self.floor_ms and (final or not s["attempts"] or s["speech_ms"] - s["at_ms"] >= self.floor_ms):
                out.append(self._try(key[0], e.cluster_id, s, final))
            self._save(e.cluster_id, s)
            if e.ending:
                out += self._last_attempts(key[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(s["attempts"] and not s["done"] for s in [self._load(k) for (k,) in list(self.clusters.keys())]):
            self.handle.registerTimer(moment + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._last_attempts(key[0]))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return df.astype({"seq": "int64", "attempt": "int64", "score": "float64", "final": "bool"})


def attribute_live(speech: DataFrame, index: VectorIndex, people: DataFrame, late: str = "10 seconds", threshold: float = ATTRIBUTION_THRESHOLD, margin: float = 0.0, floor_ms: int = EMBED_MIN_MS, tries: int = 3, idle_ms: int = 30_000) -> DataFrame:
    """Decisions of a stream of speech (conversation_id, cluster_id, seq, at, speech_ms, query, ending), as OUT.

    speech_ms and query: all speech of the cluster so far and its pooled voice; a missing or unusable voice is passed over. Prints come from an index
    tagged by person: each event meets the lists that can hold a print at the threshold, and the static ``people`` say which of
    the hits' people exist. The index and the people are those of the run's start; what a conversation mints itself is in its state at once.
    """
    about = ["conversation_id", "cluster_id", "seq", "at", "speech_ms", "query", "ending"]
    events = speech.where(usable("query")).select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("cluster_id").cast("string").alias("cluster_id"), F.col("seq").cast("long").alias("seq"), "at", F.col("speech_ms").cast("long").alias("speech_ms"), F.col("query").cast("array<double>").alias("query"), F.coalesce("ending", F.lit(False)).alias("ending"))
    which = F.to_json(F.struct("conversation_id", "cluster_id", "seq", "at"))
    found = index.above(events.select(which.alias("query_id"), "query"), threshold, NEAREST)
    e = F.from_json("query_id", "conversation_id string, cluster_id string, seq long, at timestamp")
    here = settle(people.select(F.col("person_id").cast("string").alias("tag")).join(index.tags(), "tag", "left_semi").distinct().withColumn("here", F.lit(True)))  # of those with a print
    here = F.broadcast(here) if here.limit(PEOPLE + 1).count() <= PEOPLE else here.hint("merge")
    found = found.join(here, "tag", "left").select(e.alias("e"), "id", F.when(F.col("here"), F.col("tag")).alias("person_id"), "cosine")
    none = lambda kind: F.lit(None).cast(kind)
    hits = found.select("e.*", none("long").alias("speech_ms"), none("array<double>").alias("query"), none("boolean").alias("ending"), F.col("id").alias("voiceprint_id"), "person_id", "cosine")
    both = events.select(*about, none("string").alias("voiceprint_id"), none("string").alias("person_id"), none("double").alias("cosine")).unionByName(hits).withWatermark("at", late)
    keyed_states(both.sparkSession)
    return both.groupBy("conversation_id").transformWithStateInPandas(Attribution(threshold, margin, floor_ms, tries, idle_ms), OUT, "append", "EventTime")
