"""Schemas of the memory store. Optional fields are nullable; a missing field and null are the same."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
FLOATS = T.ArrayType(T.FloatType(), False)


def _table(required: list[tuple[str, T.DataType]], optional: list[tuple[str, T.DataType]] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, k, False) for n, k in required] + [T.StructField(n, k, True) for n, k in optional])


TABLES = {
    "people": _table([("_id", S), ("owner_id", S), ("name", S), ("created_at", TS), ("updated_at", TS)], [("relationship", S), ("is_owner", B)]),
    "voiceprints": _table([("_id", S), ("owner_id", S), ("person_id", S), ("embedding", FLOATS), ("duration_ms", L), ("created_at", TS)], [("source_utterance_id", S)]),
    "conversations": _table([("_id", S), ("owner_id", S), ("started_at", TS), ("participant_ids", T.ArrayType(S))], [("ended_at", TS), ("title", S)]),
    "utterances": _table(
        [("_id", S), ("owner_id", S), ("conversation_id", S), ("text", S), ("start_ms", L), ("end_ms", L), ("is_final", B), ("created_at", TS), ("updated_at", TS)],
        [("person_id", S), ("voiceprint_id", S)],
    ),
    "facts": _table(
        [("_id", S), ("owner_id", S), ("person_id", S), ("attribute", S), ("claim", S), ("claim_normalized", S), ("primary_source_utterance_id", S), ("valid_from", TS), ("created_at", TS)],
        [("embedding", FLOATS), ("superseded_at", TS), ("superseded_by", S)],
    ),
    "promises": _table(
        [("_id", S), ("owner_id", S), ("person_id", S), ("source_utterance_id", S), ("text", S), ("text_normalized", S), ("status", S), ("created_at", TS)],
        [("due_at", TS), ("due_phrase", S)],
    ),
    "reminders": _table([("_id", S), ("owner_id", S), ("promise_id", S), ("status", S), ("fire_at", TS), ("created_at", TS)]),
}

SEGMENT = T.StructType([T.StructField("speaker", S), T.StructField("start_ms", L), T.StructField("end_ms", L)])
WORD = T.StructType([T.StructField("text", S), T.StructField("start_ms", L), T.StructField("end_ms", L), T.StructField("turn", S)])
TRIAL = T.StructType([T.StructField("score", D), T.StructField("genuine", B)])

#: Events on the bus, one wide row for the eight kinds; ``seq`` is the order of arrival.
EVENT = T.StructType(
    [T.StructField("seq", L, False), T.StructField("type", S, False)]
    + [T.StructField(n, S) for n in ("conversation_id", "utterance_id", "person_id", "voiceprint_id", "text", "name", "title", "fact_id", "superseded_fact_id", "attribute", "claim", "promise_id", "status", "request_id", "step", "message")]
    + [T.StructField(n, L) for n in ("start_ms", "end_ms", "at_ms")]
    + [T.StructField("is_final", B), T.StructField("due_at", TS), T.StructField("ended_at", TS), T.StructField("utterance_ids", T.ArrayType(S))]
)

#: Fixed values of the domain.
OWNER_PERSON = 0
EMBED_MIN_MS = 3000
ATTRIBUTION_THRESHOLD = 0.6
OWNER_THRESHOLD = 0.6
LOOKBACK = 8
SLOW_PASS_EVERY = 25
TONIGHT_HOUR = 21
SAMPLE_RATE = 16_000
FRAME_SAMPLES = 1600
HOLDBACK_MS = 300
SPEAKER_DIMS = 192
TEXT_DIMS = 768
PROMISE_STATUS = ("open", "done", "cancelled")
RELATIONS = ("replace", "refine", "coexist")
