"""Serial chains with isolated errors, and batches that wait for a pause, over restarts."""

import pandas as pd

from ctxlens.sources.event_log import EventLog, publish, with_heartbeats
from ctxlens.streaming import chains, ingest, streams


def run(spark, tmp, parts, schema, make):
    """Rows of a query over parts, started anew for each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/in/{i}")
        stream = streams.replay(spark, f"{tmp}/in/*", spark.createDataFrame([], schema).schema)
        streams.append_to(make(stream), f"{tmp}/out", f"{tmp}/ck").awaitTermination(120)
    return spark.read.parquet(f"{tmp}/out").collect()


def test_a_failing_turn_does_not_stop_its_conversation(spark, tmp_path):
    def tally(memory, text):
        if text == "boom":
            raise ValueError("no such turn")
        n = int(memory or 0) + len(text or "")
        return str(n), f"{text}:{n}"

    parts = [[("a", 0, "xx"), ("a", 1, "boom"), ("b", 0, "boom")], [("a", 3, "y"), ("a", 2, "zzz"), ("a", 1, "again"), ("b", 1, None), ("b", 1, "twice"), (None, 5, "nobody")], [("a", 4, "boom"), ("a", 5, "w")]]
    got = sorted((r.conversation_id, r.seq, r.number, r.result, r.error) for r in run(spark, tmp_path, parts, "conversation_id string, seq long, text string", lambda s: chains.chained(s, tally)))
    bad = "ValueError: no such turn"
    assert got == [("a", 0, 1, "xx:2", None), ("a", 1, 2, None, bad), ("a", 2, 3, "zzz:5", None), ("a", 3, 4, "y:6", None), ("a", 4, 5, None, bad), ("a", 5, 6, "w:7", None), ("b", 0, 1, None, bad), ("b", 1, 2, "None:0", None)]


def test_batches_wait_for_a_pause(spark, tmp_path):
    at = lambda ms: pd.Timestamp(1_000_000 + ms, unit="ms").to_pydatetime()
    parts = [
        [("o", 0, "a", at(0)), ("o", 1, "b", at(150)), ("p", 0, "x", at(100))],
        [("o", 2, "c", at(340)), ("o", 1, "b", at(340))],  # within the pause of b; b comes again
        [("o", 3, "d", at(900)), ("q", 0, "z", at(5000))],  # a new batch for o; by q's time all others are over
        [("q", 1, "late", at(9000))],
        [("r", 0, "end", at(20_000))],
        [("r", 1, "end", at(40_000))],
    ]
    got = sorted((r.owner_id, r.first_seq, r.last_seq, list(r.texts)) for r in run(spark, tmp_path, parts, "owner_id string, seq long, text string, at timestamp", chains.debounced))
    assert got[:5] == [("o", 0, 2, ["a", "b", "c"]), ("o", 3, 3, ["d"]), ("p", 0, 0, ["x"]), ("q", 0, 0, ["z"]), ("q", 1, 1, ["late"])]


def test_connections_say_hello_and_send_whole_frames(spark, tmp_path):
    frame, hello = b"\1" * ingest.FRAME_BYTES, '{"conversation_id": "talk"}'
    parts = [
        [("a", 0, hello, None), ("a", 1, None, frame), ("b", 0, None, frame), ("c", 0, "not json", None), ("d", 0, "{}", None), ("e", 0, hello, None)],
        [("a", 1, None, frame), ("a", 3, None, frame), ("a", 2, None, frame), ("b", 1, hello, None), ("e", 1, hello, None), ("f", 0, hello, None), ("f", 1, None, b"short")],
        [("a", 4, None, None), ("a", 5, None, frame), (None, 0, hello, None)],
    ]
    got = run(spark, tmp_path, parts, "connection_id string, seq long, text string, raw binary", ingest.connections)
    rows = sorted((r.connection_id, r.seq, r.kind, r.position_ms, r.code) for r in got)
    bad, failed = ingest.BROKEN, ingest.FAILED
    assert [r for r in rows if r[0] == "a"] == [("a", 0, "hello", None, None), ("a", 1, "frame", 0, None), ("a", 2, "frame", 100, None), ("a", 3, "frame", 200, None), ("a", 4, "closed", None, bad)]
    assert [r for r in rows if r[0] != "a"] == [("b", 0, "closed", None, failed), ("c", 0, "closed", None, bad), ("d", 0, "closed", None, bad), ("e", 0, "hello", None, None), ("e", 1, "closed", None, bad), ("f", 0, "hello", None, None), ("f", 1, "closed", None, bad)]
    assert all(bytes(r.raw) == frame and r.conversation_id == "talk" for r in got if r.kind == "frame")


def test_a_subscriber_that_comes_back_gets_each_event_once(spark, tmp_path):
    at = lambda s: pd.Timestamp(1000 + s, unit="s").to_pydatetime()
    schema = "seq long, at timestamp, type string, fact_id string"
    log, seen, place = EventLog(spark, f"{tmp_path}/log"), [], (-1, -1)
    assert log.after().count() == 0
    for i, rows in enumerate([[(1, at(1), "fact", "f1"), (0, at(0), "fact", "f0")], [(2, at(40), "fact", "f2")], [(3, at(41), "promise", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        publish(streams.replay(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema), f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination(60)
        if i != 1:  # the subscriber is away for a batch
            new = log.after(*place).collect()
            seen += [r.line for r in new]
            place = (new[-1].batch, new[-1].place)
    assert seen == ['event: fact\ndata: {"type":"fact","fact_id":"f0"}\n\n', 'event: fact\ndata: {"type":"fact","fact_id":"f1"}\n\n', 'event: fact\ndata: {"type":"fact","fact_id":"f2"}\n\n', 'event: promise\ndata: {"type":"promise"}\n\n']
    log.append(spark.createDataFrame([(9, at(9), "fact", "again")], schema), 1)  # a batch that is written again
    assert log.after(*place).count() == 0 and log.after().count() == 4
    beats = [r.line.startswith(": heartbeat") for r in with_heartbeats(log.after(), at(0), at(50)).collect()]
    assert beats == [False, False, True, True, False, False, True]


def test_keyed_states_in_a_session_with_the_default_store(spark, tmp_path):
    plain = spark.newSession()
    name = "spark.sql.streaming.stateStore.providerClass"
    plain.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    own = lambda tmp, schema, parts, make: run(plain, f"{tmp_path}/{tmp}", parts, schema, make)
    assert [r.result for r in own("chain", "conversation_id string, seq long, text string", [[("a", 0, "x")]], lambda s: chains.chained(s, lambda m, t: (t, t)))] == ["x"]
    assert plain.conf.get(name).endswith("RocksDBStateStoreProvider")
    plain.conf.set(name, "some.other.Provider")  # a store that was chosen stays
    chains.keyed_states(plain)
    assert plain.conf.get(name) == "some.other.Provider"
