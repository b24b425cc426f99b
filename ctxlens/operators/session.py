"""A recording session in one plan: from words, spans and turn embeddings to attributed utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EMBED_MIN_MS, HOLDBACK_MS
from . import cluster, identity, segments


def session_utterances(words: DataFrame, spans: DataFrame, turns: DataFrame, clock_ms: Column | int | None = None, holdback_ms: int = HOLDBACK_MS) -> DataFrame:
    """conversation_id, run, speaker (cluster), text, start_ms, end_ms, is_final.

    words and spans carry the provider's turn labels; turns (conversation_id, label, start_ms, end_ms, embedding) are
    clustered, and labels resolved through the clusters. Words outside any span are not uttered by anyone and are left
    out. An utterance is final if it ends the holdback before the clock; without a clock all are.
    """
    clusters = cluster.cluster_turns(turns).select("conversation_id", "label", "cluster_id")
    labelled = segments.resolve_alias(segments.label_words(words, spans), clusters)
    out = segments.assemble(labelled).where(F.col("speaker") != segments.UNKNOWN)
    final = F.lit(True) if clock_ms is None else F.col("end_ms") <= clock_ms - holdback_ms
    return out.withColumn("is_final", final)


def session_decisions(spans: DataFrame, turns: DataFrame, voiceprints: DataFrame, people: DataFrame, floor_ms: int = EMBED_MIN_MS, **options) -> DataFrame:
    """query_id (conversation:cluster), kind, person_id, score: attribution of every cluster by its pooled voice.

    A cluster's vector is the mean of its turns' vectors by duration; its speech is the sum of the spans of its labels.
    """
    placed = cluster.cluster_turns(turns).select("conversation_id", "label", "cluster_id")
    key = F.concat_ws(":", "conversation_id", "cluster_id")
    pooled = turns.where(F.col("embedding").isNotNull()).join(placed, ["conversation_id", "label"]).withColumn("query_id", key)
    centroid = cluster.weighted_centroids(pooled, "query_id").select("query_id", F.col("centroid").alias("query"))
    speech = segments.speech_per_speaker(segments.resolve_alias(spans, placed)).select(F.concat_ws(":", "conversation_id", "speaker").alias("query_id"), "speech_ms")
    return identity.attribute(centroid.join(speech, "query_id"), voiceprints, people, floor_ms=floor_ms, **options)


def partial_turns(events: DataFrame) -> DataFrame:
    """conversation_id, seq, label, text, start_ms, end_ms: what a streaming transcriber's events say of its turns so far.

    events: conversation_id, seq, type (started, delta, stopped, completed), item_id, at_ms, text. A turn's label is claimed
    by the first event of its item and kept, so that the finished text revises the partial one. A start is not before the last
    stop that came earlier; a turn lasts at least 1 ms. Folded per conversation in order of arrival.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds: dict[str, list] = {}
        said: dict[str, str] = {}
        last_end, opened, labels, out = 0, None, 0, []

        def claim(item: str, start: int) -> list:
            nonlocal labels
            if item not in bounds:
                bounds[item] = [f"turn-{labels}", start, start]
                labels += 1
            return bounds[item]

        def tell(seq: int, turn: list, end: int, text: str) -> None:
            out.append((seq, turn[0], text, turn[1], max(end, turn[1] + 1)))

        for e in pdf.sort_values("seq").itertuples():
            if e.type == "started":
                opened = max(e.at_ms, last_end)
                claim(e.item_id, opened)
            elif e.type == "delta" and e.text:
                turn = claim(e.item_id, max(e.at_ms if opened is None else opened, last_end))
                said[e.item_id] = said.get(e.item_id, "") + e.text
                if said[e.item_id].strip():
                    tell(e.seq, turn, e.at_ms, said[e.item_id].strip())
            elif e.type == "stopped":
                last_end = max(last_end, e.at_ms)
                claim(e.item_id, opened or 0)[2] = e.at_ms
                opened = None
            elif e.type == "completed" and e.text and e.text.strip():
                turn = claim(e.item_id, opened or 0)
                tell(e.seq, turn, turn[2] if turn[2] > turn[1] else e.at_ms, e.text.strip())
                bounds.pop(e.item_id)
                said.pop(e.item_id, None)
        frame = pd.DataFrame(out, columns=["seq", "label", "text", "start_ms", "end_ms"])
        frame.insert(0, "conversation_id", pdf["conversation_id"].iloc[0])
        return frame

    return events.groupBy("conversation_id").applyInPandas(fold, "conversation_id long, seq long, label string, text string, start_ms long, end_ms long")
