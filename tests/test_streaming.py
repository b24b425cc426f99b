import pandas as pd
import pytest
from pyspark.sql import functions as F

from ctxlens.operators.vector_index import Shape, VectorIndex
from ctxlens.schemas import EVENT
from ctxlens.sources.log_table import LogTable
from ctxlens.streaming import live, reducer, streams


def events(spark, *rows):
    return spark.createDataFrame([tuple({**r, "seq": i}.get(f.name) for f in EVENT) for i, r in enumerate(rows)], EVENT)


def drain(q):
    q.processAllAvailable() if q.isActive else None
    q.awaitTermination(60)


def test_reducer(spark):
    u = lambda **k: {"type": "utterance", "conversation_id": "c", "utterance_id": "u1", "text": "a", "is_final": False, **k}
    e = events(
        spark, {"type": "identity", "conversation_id": "c", "person_id": "p0", "name": "Speaker 1", "utterance_ids": ["u1"]}, u(), {"type": "speaker_pending", "conversation_id": "c", "utterance_ids": ["u1", "u2"]},
        u(person_id="p1", text="b"), u(text="c", is_final=True), {"type": "speaker_pending", "conversation_id": "c", "utterance_ids": ["u1"]}, {"type": "identity", "conversation_id": "c", "person_id": "p0", "name": "Ann", "utterance_ids": []},
        {"type": "identity", "conversation_id": "c", "person_id": "p0", "name": "Other", "utterance_ids": []}, {"type": "conversation", "conversation_id": "c", "title": "T"},
        {"type": "fact", "fact_id": "f1", "person_id": "p1", "attribute": "x", "claim": "1"}, {"type": "fact", "fact_id": "f2", "person_id": "p1", "attribute": "x", "claim": "2", "superseded_fact_id": "f1"},
        {"type": "promise", "promise_id": "q", "person_id": "p1", "text": "t", "status": "open"}, {"type": "promise", "promise_id": "q", "person_id": "p1", "text": "t", "status": "done"},
        {"type": "agent_step", "request_id": "r", "step": "reason", "message": "m"}, {"type": "agent_audio", "request_id": "r", "text": "done"},
    )
    r = reducer.utterance_state(e).first()
    assert (r.text, r.person_id, r.is_final) == ("c", "p1", True)
    assert [x.utterance_id for x in reducer.attributing(e).collect()] == ["u2"]
    assert {x.person_id: x.name for x in reducer.people_state(e).collect()} == {"p0": "Ann"}
    c = reducer.conversation_state(e, spark.createDataFrame([("c", "Mine")], "conversation_id string, title string")).first()
    assert (c.title, c.participant_ids) == ("Mine", ["p0", "p1"])
    assert {x.fact_id: x.superseded_by for x in reducer.fact_state(e).collect()} == {"f1": "f2", "f2": None}
    assert reducer.promise_state(e).first().status == "done"
    t = reducer.agent_turns(e).first()
    assert t.reply == "done" and t.done and len(t.steps) == 1


@pytest.fixture
def folder(spark, tmp_path):
    def write(df, parts=3, order="seq"):
        pdf = df.orderBy(order).toPandas()
        size = -(-len(pdf) // parts)
        for i in range(parts):
            spark.createDataFrame(pdf.iloc[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        return f"{tmp_path}/in/*", tmp_path

    return write


def test_windows_stream_equals_batch(spark, folder):
    e = spark.range(200).select(F.col("id").alias("seq"), F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"))
    path, tmp = folder(e)
    stream = streams.replay(spark, path, e.schema)
    q = streams.emit(streams.tumbling(stream, "1 hour", "10 days"), "tumbling_out", f"{tmp}/ck", "complete")
    drain(q)
    assert sorted(map(tuple, spark.table("tumbling_out").collect())) == sorted(map(tuple, streams.tumbling(e, "1 hour").collect()))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "seq long, user_id long, ts timestamp, event_type string, value double"
    for i, secs in enumerate(([0, 10], [100_000], [100_001], [5], [200_000])):
        spark.createDataFrame([(i, 1, pd.Timestamp(s, unit="s").to_pydatetime(), "x", 1.0) for s in secs], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = streams.replay(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
    q = streams.emit(streams.tumbling(stream, "1 hour", "1 hour"), "late_out", f"{tmp_path}/ck")
    drain(q)
    got = {r.window_start.timestamp(): r.n for r in spark.table("late_out").collect()}
    assert got[0.0] == 2


def test_stateful_operators(spark, folder):
    d = spark.createDataFrame([(i, 1 + i % 2, "a" if i < 6 else "b", True) for i in range(12)], "seq long, conversation_id long, text string, is_final boolean")
    path, tmp = folder(d)
    q = streams.emit(streams.changed_only(streams.replay(spark, path, d.schema), "conversation_id", "text"), "changed_out", f"{tmp}/ck1")
    drain(q)
    assert sorted(tuple(r) for r in spark.table("changed_out").collect()) == [(1, 0, "a"), (1, 6, "b"), (2, 1, "a"), (2, 7, "b")]
    q = streams.emit(streams.every_nth_final(streams.replay(spark, path, d.schema), 3), "nth_out", f"{tmp}/ck2")
    drain(q)
    assert sorted(tuple(r) for r in spark.table("nth_out").collect()) == [(1, 3), (1, 6), (2, 3), (2, 6)]


def test_upsert_stream(spark, folder):
    d = spark.createDataFrame([(i, i % 4, f"t{i}", i) for i in range(12)], "seq long, id long, text string, created long")
    path, tmp = folder(d)
    q = streams.upsert_stream(streams.replay(spark, path, d.schema), f"{tmp}/out", ["id"], "seq", "created", f"{tmp}/ck")
    q.awaitTermination(60)
    table = LogTable(spark, f"{tmp}/out", d.schema, ["id"], "seq", "created")
    assert table.last() == 2
    got = table.read()
    assert sorted((r.id, r.text, r.created) for r in got.collect()) == [(0, "t8", 0), (1, "t9", 1), (2, "t10", 2), (3, "t11", 3)]


def test_interventions():
    def ev(i, t, at, **k):
        return {"seq": i, "type": t, "person_id": "p", "is_final": True, "cue": True, "attribute": "move", "fact_id": f"f{i}", "superseded_fact_id": "old", "at_ms": at, **k}

    e = pd.DataFrame([ev(0, "utterance", 0), ev(1, "fact", 31_000), ev(2, "utterance", 40_000), ev(3, "fact", 50_000, attribute="mood"), ev(4, "fact", 51_000), ev(5, "fact", 52_000), ev(6, "utterance", 53_000), ev(7, "fact", 60_000), ev(8, "fact", 61_000)])
    found, state = streams.interventions(e, ({}, [], None))
    assert [f[0] for f in found] == ["f4", "f8"] and state[2] == 61_000


def test_retry_gate_ends_with_a_final_attempt(spark, folder):
    # a is tried at each 3 s of new speech, three times, and then once for good; b at the end of the session; c has too little speech
    a = [("a", ms, False) for ms in (1000, 3000, 4000, 6500, 9000, 9600, 9700, 20_000)]
    d = [(i, *r) for i, r in enumerate([*a, ("b", 3500, None), ("b", 3600, True), ("b", 9000, True), ("c", 2000, True)])]
    d = spark.createDataFrame(d, "seq long, cluster_id string, speech_ms long, ending boolean")
    path, tmp = folder(d)
    q = streams.emit(streams.retry_gate(streams.replay(spark, path, d.schema)), "retry_out", f"{tmp}/ck")
    drain(q)
    got = sorted((r.cluster_id, r.attempt, r.speech_ms, r.final) for r in spark.table("retry_out").collect())
    assert got == [("a", 1, 3000, False), ("a", 2, 6500, False), ("a", 3, 9600, False), ("a", 4, 9700, True), ("b", 1, 3500, False), ("b", 2, 3600, True)]


def speech_rows(spark, tmp, parts, prints, **options):
    """Decisions of a live run over parts of speech; each part is a file, and a new run of the query starts with each."""
    schema = "conversation_id string, cluster_id string, seq long, at timestamp, speech_ms long, query array<double>, ending boolean"
    people = spark.createDataFrame([(p,) for p in ("ann", "bob")], "person_id string")
    index = VectorIndex.build(spark.createDataFrame(prints, "voiceprint_id string, person_id string, embedding array<double>"), f"{tmp}/index", "voiceprint_id", tag="person_id", shape=Shape(block=2))
    for i, part in enumerate(parts):
        rows = [(c, k, seq, pd.Timestamp(at + 1000, unit="s").to_pydatetime(), ms, v, end) for c, k, seq, at, ms, v, end in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/in/{i}")
        stream = streams.replay(spark, f"{tmp}/in/*", spark.createDataFrame([], schema).schema)
        streams.append_to(live.attribute_live(stream, index, people, **options), f"{tmp}/out", f"{tmp}/ck").awaitTermination(120)
    return [(r.conversation_id, r.cluster_id, r.attempt, r.kind, r.person_id, r.final) for r in spark.read.parquet(f"{tmp}/out").orderBy("conversation_id", "seq", "cluster_id", "attempt").collect()]


PRINTS = [("v1", "ann", [1.0, 0.0, 0.0]), ("v2", "bob", [0.0, 1.0, 0.0]), ("v3", "gone", [0.0, 0.0, 1.0])]


def test_live_attribution_mints_and_matches(spark, tmp_path):
    new = [-1.0, -1.0, 0.0]
    parts = [
        [("c", "k0", 0, 0, 1000, [1.0, 0.0, 0.0], False), ("c", "k1", 1, 1, 3000, new, False), ("d", "k2", 0, 1, 3000, new, None)],
        [("c", "k0", 2, 2, 3500, [1.0, 0.1, 0.0], False), ("c", "k3", 3, 3, 4000, [-1.0, -0.9, 0.0], False), ("c", "k1", 1, 3, 9000, [1.0, 0.0, 0.0], False), ("c", "k4", 4, 3, 4000, None, False)],
        [("c", "k5", 5, 4, 4000, [0.0, 0.0, 1.0], False), ("c", "k0", 6, 5, 9000, [0.0, 1.0, 0.0], False)],
    ]
    got = speech_rows(spark, tmp_path, parts, PRINTS, threshold=0.6)
    # a new voice is known to its conversation in the next run; another conversation mints its own; repeats and settled clusters are left alone;
    # the print of a person who has gone doesn't count
    assert got == [("c", "k1", 1, "new", "person-k1", False), ("c", "k0", 1, "match", "ann", False), ("c", "k3", 1, "match", "person-k1", False), ("c", "k5", 1, "new", "person-k5", False), ("d", "k2", 1, "new", "person-k2", False)]


def test_live_attribution_tries_again_and_ends(spark, tmp_path):
    both = [1.0, 0.95, 0.0]
    parts = [
        [("c", "k", 0, 0, 3000, both, False), ("c", "k", 1, 1, 5000, both, False), ("c", "k", 2, 2, 6000, both, False), ("e", "k", 0, 0, 3000, both, False), ("t", "k", 0, 0, 3000, both, False)],
        [("c", "k", 3, 3, 9000, both, False), ("c", "k", 4, 4, 9100, both, False), ("e", "x", 1, 3, 100, [0.0, 0.0, 1.0], True)],
        [("u", "k", 0, 500, 100, both, False)],  # its time makes the timer of t due
        [("u", "k", 1, 501, 100, both, False)],
    ]
    got = speech_rows(spark, tmp_path, parts, PRINTS, threshold=0.6, margin=0.1, idle_ms=60_000)
    assert [g for g in got if g[0] == "c"] == [("c", "k", 1, "ambiguous", None, False), ("c", "k", 2, "ambiguous", None, False), ("c", "k", 3, "ambiguous", None, False), ("c", "k", 4, "match", "ann", True)]
    assert [g for g in got if g[0] == "e"] == [("e", "k", 1, "ambiguous", None, False), ("e", "k", 2, "match", "ann", True)]
    assert [g for g in got if g[0] == "t"] == [("t", "k", 1, "ambiguous", None, False), ("t", "k", 2, "match", "ann", True)]
    assert not [g for g in got if g[0] == "u"]


def test_live_context_in_two_levels_equals_the_fold(spark):
    import random

    rng = random.Random(6)
    rows, at = [], 0
    for i in range(600):
        at += rng.randrange(0, 6000)
        said = rng.random() < 0.4
        rows.append((f"o{i % 3}", i, "utterance" if said else rng.choice(["fact", "fact", "other"]), rng.choice(["p", "q", None]), rng.choice(["actually it moved", "plain talk", None]), rng.choice([True, True, False]), rng.choice(["move", "mood"]), f"f{i // 2}", rng.choice(["old", None]), at))
    schema = "owner_id string, seq long, type string, person_id string, text string, is_final boolean, attribute string, fact_id string, superseded_fact_id string, at_ms long"
    d = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in streams.live_context(d).collect())
    pdf = d.withColumn("cue", F.coalesce(streams.has_change_cue(F.col("text")), F.lit(False))).toPandas().astype(object)
    pdf = pdf.where(pdf.notna(), None)
    want = sorted((o, *f) for o, part in pdf.groupby("owner_id") for f in streams.interventions(part, ({}, [], None))[0])
    assert got == want and len(got) >= 4
