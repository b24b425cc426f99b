import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxlens.engine import Memory
from ctxlens.functions import hooks
from ctxlens.operators import changes, cluster, facts, identity, retrieval, scoring, segments, session, views, voice_activity
from ctxlens.sources import audio, sinks
from ctxlens.schemas import TABLES
from ctxlens.sources.tables import event_script, provider, read_table, read_transcript, released

DAY = lambda n: dt.datetime(2024, 1, n)
FACT = "fact_id long, person_id long, attribute string, claim string, source_utterance_id long, valid_from timestamp"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_supersession(spark):
    c = spark.createDataFrame([(1, 1, "move", "sep 1", 10, DAY(1)), (2, 1, "move", "sep 1", 11, DAY(2)), (3, 1, "move", "sep 15", 12, DAY(3)), (4, 1, "move", "sep 1", 13, DAY(4)), (5, 2, "job", "baker", 14, DAY(1))], FACT)
    f = facts.supersede(c)
    assert rows(f, "fact_id", "superseded_by") == [(1, 3), (3, 4), (4, None), (5, None)]
    assert rows(facts.current(f), "person_id", "fact_id") == [(1, 4), (2, 5)]
    assert [r.fact_id for r in facts.history(f, 1, "move_date").collect()] == [1, 3, 4]
    assert rows(facts.chains(f), "fact_id", "root_id", "depth") == [(1, 1, 0), (3, 1, 1), (4, 1, 2), (5, 5, 0)]
    assert rows(facts.lineage(f), "old_claim", "new_claim") == [("sep 1", "sep 15"), ("sep 15", "sep 1")]


def test_reconcile_relations(spark):
    cols = "person_id long, attribute string, fact_id long, claim string, source_utterance_id long, position long, valid_from timestamp, created_at timestamp, relation string"
    c = spark.createDataFrame(
        [
            (1, "preference", 1, "likes tea", 10, 10, DAY(1), DAY(1), None), (1, "food_preference", 2, "likes green tea", 11, 11, DAY(2), DAY(2), "refine"),
            (1, "preference", 3, "likes cake", 12, 12, DAY(3), DAY(3), "coexist"), (1, "preference", 4, "likes tea", 9, 9, DAY(4), DAY(4), "replace"), (1, "preference", 5, "likes cake", 13, 13, DAY(5), DAY(5), "replace"),
        ],
        cols,
    )
    got = {r.fact_id: (r.superseded_by, r.valid_from) for r in facts.reconcile(c).collect()}
    assert got == {1: (2, DAY(1)), 2: (None, DAY(1)), 3: (None, DAY(3))}


def test_set_fact_by_voice_goes_back(spark):
    cols = "person_id long, attribute string, fact_id long, claim string, source_utterance_id long, position long, valid_from timestamp, created_at timestamp, relation string"
    c = spark.createDataFrame([(1, "birthday", i, claim, 0, i, DAY(i), DAY(i), None) for i, claim in ((1, "a"), (2, "b"), (3, "a"), (4, "a"))], cols)
    assert rows(facts.reconcile(c, spoken=True), "fact_id", "superseded_by") == [(1, 2), (2, 3), (3, None)]


def test_change_graph(spark):
    f = spark.createDataFrame([(1, 7, "move", "moves september 1", 100, DAY(1), 2, DAY(3)), (2, 7, "move", "moves september 15", 202, DAY(3), None, None), (3, 7, "job", "x", 100, DAY(1), 99, DAY(2))], FACT + ", superseded_by long, superseded_at timestamp")
    u = spark.createDataFrame([(100, 1, 7, 10, True), (101, 1, 8, 5, True), (102, 1, 9, 8, True), (103, 1, 5, 9, False), (200, 2, 7, 5, True), (201, 2, 8, 6, True), (202, 2, 7, 9, True)], "utterance_id long, conversation_id long, person_id long, end_ms long, is_final boolean")
    p = spark.createDataFrame([(7, "Yan"), (8, "Maya"), (9, " ")], "person_id long, name string")
    pr = spark.createDataFrame([(1, 1, "help YAN pack", "open"), (2, 7, "send boxes", "open"), (3, 7, "old", "done"), (4, 1, "rent a van to moves", "open"), (5, 1, "unrelated", "open"), (6, 7, "more", "open")], "promise_id long, person_id long, text string, status string")
    r = changes.context_changes(f, u, p, pr, limit=99).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.person_name, r.recorded_with, r.may_have_missed, r.affected_promises, r.conversation_id) == ("Yan", [7, 8], [9], [1, 2, 4], 2)
    assert rows(changes.named(spark.createDataFrame([(1, [9, 8, 77])], "k long, ids array<long>"), "k", "ids", p), "id", "name") == [(8, "Maya"), (9, "Unknown speaker")]


def test_segments_and_utterances(spark):
    w = spark.createDataFrame([(1, 1, i, t, a, z) for i, (t, a, z) in enumerate([("hi", 0, 100), ("there", 90, 210), ("you", 300, 400), ("all", 500, 600)])], "conversation_id long, utterance_id long, position int, text string, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, "A", 0, 150), (1, "B", 150, 380), (1, "C", 150, 160)], "conversation_id long, speaker string, start_ms long, end_ms long")
    labelled = segments.label_words(w, s, bucket_ms=100)
    assert rows(labelled, "position", "speaker") == [(0, "A"), (1, "C"), (2, "B"), (3, "unknown")]
    alias = spark.createDataFrame([(1, "C", "B")], "conversation_id long, label string, cluster_id string")
    u = segments.assemble(segments.resolve_alias(labelled, alias))
    assert rows(u, "run", "speaker", "text", "end_ms") == [(1, "A", "hi", 100), (2, "B", "there you", 400), (3, "unknown", "all", 600)]
    assert segments.finalized(u, 400).count() == 2
    assert rows(segments.speakers_over(s, 100), "speaker") == [("A",), ("B",)]


def test_subtract_overlaps_matches_a_timeline(spark):
    random.seed(3)
    data = [(c, i, random.choice("AB"), a := random.randrange(100), a + 1 + random.randrange(40)) for c in range(3) for i in range(12)]
    got = segments.subtract_overlaps(spark.createDataFrame(data, "conversation_id long, seq long, speaker string, start_ms long, end_ms long")).collect()
    for c in range(3):
        owner = {}
        for cc, seq, _, a, z in data:
            if cc == c:
                owner.update({t: seq for t in range(a, z)})
        held = {t: r.seq for r in got if r.conversation_id == c for t in range(r.start_ms, r.end_ms)}
        assert held == owner


def test_clusterer(spark):
    rng = np.random.default_rng(1)
    voices = [v / np.linalg.norm(v) for v in rng.standard_normal((3, 32))]
    near = lambda i: (voices[i] + 0.05 * rng.standard_normal(32)).tolist()
    turns = [("t0", 0, 2000, near(0)), ("t1", 2000, 2900, near(1)), ("t2", 3000, 5000, near(1)), ("t3", 5100, 5200, None), ("t4", 9000, 9400, near(2)), ("t5", 5200, 8000, near(0))]
    df = spark.createDataFrame([(1, *t) for t in turns], "conversation_id long, label string, start_ms long, end_ms long, embedding array<double>")
    got = {r.label: (r.cluster_id, r.reason) for r in cluster.cluster_turns(df).collect()}
    assert got["t0"] == ("cluster-0", "created") and got["t1"] == ("cluster-1", "matched") and got["t2"] == ("cluster-1", "created")
    assert got["t3"] == ("cluster-1", "adjacent") and got["t5"] == ("cluster-0", "matched") and got["t4"][1] == "nearest"


def test_voice_activity(spark):
    level = [0.0] * 10 + [0.5] * 60 + [0.0] * 20 + [0.5] * 10 + [0.0] * 40 + [0.5] * 30
    w = [(1, 20.0 * i, 20.0 * i + 20, x) for i, x in enumerate(level)]
    got = rows(voice_activity.voice_turns(spark.createDataFrame(w, "stream_id long, start_ms double, end_ms double, rms double")), "turn", "start_ms", "end_ms")
    # 1.2 s of speech and 250 ms of silence close a turn; 200 ms of speech alone don't count, and stay open over silence
    assert got[0] == ("turn-0", 200, 1400)
    assert voice_activity.turns_of([(0, 20, 1.0), (40, 60, 1.0)]) == []
    long = [(20.0 * i, 20.0 * i + 20, 1.0) for i in range(1000)]
    assert voice_activity.turns_of(long) == [(0, 15000), (15000, 20000)]


def test_retrieval(spark):
    f = spark.createDataFrame([(i, 1, "a", f"c{i}", None if i % 2 else 99) for i in range(1, 9)], "fact_id long, person_id long, attribute string, claim string, superseded_by long")
    sem = spark.createDataFrame([(i, float(10 - i)) for i in range(1, 9)], "fact_id long, score double")
    lex = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "fact_id long, score double")
    assert [r.fact_id for r in retrieval.search_facts(f, sem, lex, "fused", 4).collect()] == [1, 7, 3, 5]
    assert [r.fact_id for r in retrieval.search_facts(f, sem, None, "manual", 4).collect()] == [1, 3]
    empty = retrieval.search_text("a bb", spark.createDataFrame([(1, 1, "bb", "open")], "promise_id long, person_id long, text string, status string"), spark.createDataFrame([], "utterance_id long, person_id long, text string"))
    assert empty.count() == 0


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 6)).astype("f8")  # many ties, some zero vectors
    v[7] = 0
    data = [(f"r{i:03}", x.tolist()) for i, x in enumerate(v)] + [("odd", [1.0, 2.0]), ("none", None), ("nan", [float("nan")] * 6), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    r = spark.createDataFrame(data, "id string, e array<double>").repartition(3)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 7)] + [(900, None), (901, [3.0, 4.0])], "query_id long, query array<double>")
    mag = np.linalg.norm(v, axis=1)
    for block in (5, 4096):
        got = {}
        for x in retrieval.knn(r, q, 4, "id", "e", block=block).collect():
            got.setdefault(x.query_id, {})[x["rank"]] = (x.id, x.cosine)
        assert got.pop(901) == {1: ("odd", pytest.approx(11 / 5 / 5**0.5))}
        assert set(got) == set(range(0, 300, 7))
        for i, hits in got.items():
            m = mag * mag[i]
            cos = np.round(np.divide(v @ v[i], m, out=np.zeros(300), where=m > 0), 12)
            want = sorted(range(300), key=lambda j: (-cos[j], j))[:4]
            assert [hits[n][0] for n in (1, 2, 3, 4)] == [f"r{j:03}" for j in want]
    assert retrieval.knn(r, q.limit(0), 2, "id", "e").count() == 0


@pytest.mark.parametrize("least", [None, 0.3])
def test_neighbours_of_all_rows(spark, monkeypatch, least):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (200, 6)).astype("f8")  # many ties, some zero vectors
    v[7], v[20:60] = 0, v[20]  # more exact copies than neighbours are wanted
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (902, None), (903, [float("nan")] * 6), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6)]
    r = spark.createDataFrame(data, "id long, e array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "CELLS", 100)
    mag = np.outer(*[np.linalg.norm(v, axis=1)] * 2)
    cos = np.round(np.divide(v @ v.T, mag, out=np.zeros_like(mag), where=mag > 0), 12)
    want = {(q, j, n + 1) for q in range(200) for n, j in enumerate(sorted((j for j in range(200) if j != q and (least is None or cos[q, j] >= least)), key=lambda j: (-cos[q, j], j))[:4])}
    want |= {(900, 901, 1), (901, 900, 1)}
    for block, side in ((16, 3), (8192, 16)):
        got = {(x.query_id, x.id, x["rank"]) for x in retrieval.neighbours(r, 4, "id", least, "e", block=block, side=side).collect()}
        assert got == want
    assert retrieval.neighbours(r.limit(0), 4, "id", least, "e").count() == 0


def test_label_words_keeps_equal_words(spark):
    w = spark.createDataFrame([(1, 1, 0, "a", 0, 10)] * 2 + [(1, 1, 1, "b", 25_000, 25_010)], "conversation_id long, utterance_id long, position int, text string, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, "A", 0, 30_000), (1, None, 0, 5), (1, "B", 24_000, 26_000)], "conversation_id long, speaker string, start_ms long, end_ms long")
    assert rows(segments.label_words(w, s), "text", "speaker") == [("a", "A"), ("a", "A"), ("b", "A")]


def test_chains_of_any_length(spark):
    n = 70
    data = [(i, i + 1 if i < n - 1 else None) for i in range(n)] + [(200, 999), (300, None)]
    got = rows(facts.chains(spark.createDataFrame(data, "fact_id long, superseded_by long")), "fact_id", "root_id", "depth")
    assert got == [(i, 0, i) for i in range(n)] + [(200, 200, 0), (300, 300, 0)]


def test_names_in_texts(spark):
    texts = ["call Ann and anna-maria", "ANNA", "an", "", "the anna marianne club", None]
    names = ["ann", "anna", "anna-maria", "marianne", "zoe", "a.b"]
    p = spark.createDataFrame(list(enumerate(texts)), "promise_id long, text string")
    got = rows(changes.names_in(p, spark.createDataFrame([(n,) for n in names], "name string")), "promise_id", "name")
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if t and n in t.lower())
    assert changes.names_in(p, spark.createDataFrame([], "name string")).count() == 0


def test_equal_error_rate_of_uneven_scores(spark):
    rng = np.random.default_rng(2)
    x = [(float(s), bool(g)) for s, g in zip(np.round(np.exp(8 * rng.standard_normal(400)), 3), rng.random(400) < 0.5, strict=True)]
    g, o = [s for s, k in x if k], [s for s, k in x if not k]
    want = min((abs(sum(s >= t for s in o) / len(o) - sum(s < t for s in g) / len(g)), t) for t, _ in x)[1]
    assert scoring.equal_error_rate(spark.createDataFrame(x, "score double, genuine boolean")).first().threshold == want


def test_decisions(spark):
    d = lambda b, r: tuple(spark.range(1).select(scoring.decide(F.lit(b), F.lit(r), 2.0, 1.0, 0.5).alias("d")).first().d)
    inf, nan = float("inf"), float("nan")
    assert d(3.0, 1.0) == ("match", None, 3.0, 2.0) and d(3.0, nan) == ("match", None, 3.0, inf)
    assert d(3.0, 2.8)[:2] == ("uncertain", "ambiguous") and d(1.5, 0.0)[:2] == ("uncertain", "below_accept")
    assert d(0.5, 0.0)[:3] == ("new", None, 0.5) and d(nan, 0.0)[:3] == ("new", None, -inf)


def test_scoring(spark):
    t = spark.createDataFrame([("a", 0.9), ("a", 0.7), ("a", float("nan")), ("b", 0.2), ("c", None)], "k string, score double")
    got = {r.k: (r.mean, r.std) for r in scoring.cohort_stats(t, "k", 2).collect()}
    assert got["a"] == (pytest.approx(0.8), pytest.approx(0.02**0.5)) and got["b"] == (0.2, 1e-6) and got["c"] == (0.0, 1e-6)
    sim = scoring.simulate()
    df = spark.createDataFrame([(s, bool(g)) for _, _, g, s in sim], "score double, genuine boolean")

    def rates(th):
        g, i = [s for _, _, x, s in sim if x], [s for _, _, x, s in sim if not x]
        return sum(s >= th for s in i) / len(i), sum(s < th for s in g) / len(g)

    best = min(((round(abs(rates(s)[0] - rates(s)[1]), 12), s) for *_, s in sim))
    r = scoring.equal_error_rate(df).first()
    assert r.threshold == best[1] and r.eer == pytest.approx(sum(rates(best[1])) / 2)
    assert scoring.equal_error_rate(df.where("genuine")).first()[:] == (0.0, 0.0)
    slope, _ = scoring.fit_calibration(df)
    assert slope > 0 and scoring.fit_calibration(df.where("genuine")) == (0.0, 10.0) and scoring.fit_calibration(df.where("NOT genuine")) == (0.0, -10.0) and scoring.fit_calibration(df.limit(0)) == (1.0, 0.0)


def test_identity(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.8, 0.6]), (3, 77, [0.0, 1.0])], "voiceprint_id long, person_id long, embedding array<double>")
    p = spark.createDataFrame([(1, "Ann", True, 5), (2, "Bo", False, 3), (4, "", False, 1)], "person_id long, name string, is_owner boolean, created_ms long")
    q = spark.createDataFrame([(10, [1.0, 0.0], 4000), (11, [0.0, 1.0], 4000), (12, [1.0, 0.0], 10)], "query_id long, query array<double>, speech_ms long")
    assert rows(identity.attribute(q, v, p), "query_id", "kind", "person_id") == [(10, "match", 1), (11, "match", 2), (12, "pending", None)]
    assert {r.query_id: r.kind for r in identity.attribute(q, v, p, margin=0.5).collect()}[10] == "uncertain"
    assert rows(identity.owner_gate(q.select("query_id", "query"), v, p), "query_id", "is_owner")[0] == (10, True)
    assert identity.attribute_in_order([("a", [0, 1]), ("b", [0.1, 1])], []) == [("a", "new", "person-a"), ("b", "match", "person-a")]
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (3, 1), (3, 99)], "merge_id long, person_id long")
    mapping = identity.merge_mapping(m, p)
    assert rows(mapping, "old_id", "new_id") == [(1, 4), (2, 4)]
    left, moved = identity.merge_people(p, {"v": v}, mapping, inherit_name=True)
    assert rows(left, "person_id", "name") == [(4, "Bo")] and rows(moved["v"], "voiceprint_id", "person_id") == [(1, 4), (2, 4), (3, 77)]


def test_sinks(spark):
    t = spark.createDataFrame([(1, "a", 0, 0)], "id long, text string, rev long, created long")
    new = spark.createDataFrame([(1, "b", 2, 2), (1, "c", 1, 1), (2, "d", 1, 1)], t.schema)
    assert rows(sinks.upsert(t, new, ["id"], "rev", "created"), "id", "text", "created") == [(1, "b", 0), (2, "d", 1)]
    again = sinks.upsert(sinks.upsert(t, new, ["id"], "rev", "created"), new, ["id"], "rev", "created")
    assert rows(again, "id", "text", "created") == [(1, "b", 0), (2, "d", 1)]
    fresh = sinks.insert_once(t, spark.createDataFrame([(5, "a", 1, 1), (6, None, 1, 1), (7, None, 1, 1)], t.schema), ["text"], [F.col("id")])
    assert rows(fresh, "id") == [(6,)]


def test_engine(spark):
    people = spark.createDataFrame([(1, "Ann", "friend", False, 1)], "person_id long, name string, relationship string, is_owner boolean, created_ms long")
    f = facts.supersede(spark.createDataFrame([(1, 1, "move", "september first", 10, DAY(1))], FACT))
    pr = spark.createDataFrame([(1, 1, "bring boxes", "open", DAY(9), DAY(1), 10)], "promise_id long, person_id long, text string, status string, due_at timestamp, created_at timestamp, source_utterance_id long")
    u = spark.createDataFrame([(10, 1, 1, "I move september first", 0, 5, True)], "utterance_id long, conversation_id long, person_id long, text string, start_ms long, end_ms long, is_final boolean")
    m = Memory(people, f, pr, u)
    m2 = m.record_facts(spark.createDataFrame([(2, 1, "move", "september fifteenth", 11, DAY(2), 1), (3, 1, "move", "september first", 10, DAY(2), 1)], FACT + ", supersedes long"))
    assert rows(m2.facts, "fact_id", "superseded_by") == [(1, 2), (2, None)]
    got = m2.search_memory("september boxes").orderBy("place").collect()
    assert [(r.kind, r.id) for r in got] == [("fact", 2), ("promise", 1), ("utterance", 10)]
    assert [r.kind for r in m2.ask("september boxes").collect()].count("utterance") == 0
    m3, counts = m2.delete_conversation(1)
    assert counts.first()[:] == (1, 1, 1) and rows(m3.facts, "fact_id", "superseded_by") == [(2, None)]
    assert m2.set_name(1, "Anna")[1].count() == 1 and m2.set_promise_status(1, "done").list_promises("open").count() == 0
    with pytest.raises(ValueError):
        m.set_promise_status(1, "lost")


def test_views(spark):
    u = spark.createDataFrame([(1, 1, 7, "Hello there", 0), (2, 1, 7, "...", 1), (3, 1, 7, " Hello there ", 2), (4, 1, None, "Bye now", 3)], "utterance_id long, conversation_id long, person_id long, text string, start_ms long")
    assert rows(views.readable_lines(u), "utterance_id") == [(1,), (4,)]
    p = spark.createDataFrame([(7, "Ann")], "person_id long, name string")
    assert views.title_transcript(u, p, chars=30).first().transcript == "Ann: Hello there\nAnn: ..."
    runs = segments.header_runs(u)
    assert rows(runs, "utterance_id", "header") == [(1, True), (2, False), (3, False), (4, True)]


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(4000) / 10).astype("f4")
    wav = audio.encode_wav(x)
    rate, back = audio.parse_wav(wav)
    assert rate == 16000 and np.abs(back - x).max() < 1e-4
    (tmp_path / "a.wav").write_bytes(wav)
    assert audio.read_wavs(spark, str(tmp_path)).selectExpr("size(samples)").first()[0] == 4000
    with pytest.raises(ValueError):
        audio.parse_wav(b"RIFF0000WAVX")
    c = spark.createDataFrame([(1, 0, [1.0] * 30), (1, 1, []), (1, 2, [2.0] * 25), (1, 3, [3.0] * 100)], "conversation_id long, seq long, samples array<double>")
    frames = {r.frame: r.samples for r in audio.packetize(c, size=50).collect()}
    assert sorted(frames) == [0, 1, 2] and frames[0] == [1.0] * 30 + [2.0] * 20 and frames[1] == [2.0] * 5 + [3.0] * 45
    m = spark.createDataFrame([(1, 0, bytes(6400)), (1, 1, bytes(5)), (1, 2, bytes(6400))], "conversation_id long, seq long, raw binary")
    assert rows(audio.pcm_frames(m), "seq", "position_ms") == [(0, 0), (2, 100)] and audio.uplink_report(m).first().verdict == "bad frame sizes"
    r = audio.uplink_report(spark.createDataFrame([(1, np.full(1600, 0.5, "<f4").tobytes())], "conversation_id long, raw binary")).first()
    assert (r.verdict, r.peak, r.rms, r.audio_seconds) == ("ok", 0.5, 0.5, 0.1)


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"conversation_id": "c", "utterances": [{"utterance_id": "u1", "text": "hi", "start_ms": 0, "end_ms": 5}, {"utterance_id": "u2", "text": "ho", "start_ms": 5, "end_ms": 9}]}')
    t = read_transcript(spark, str(tmp_path / "t.json"))
    assert rows(released(t, 5), "utterance_id") == [("u1",)]
    e = event_script(spark, [{"type": "fact", "at_ms": 100}, {"type": "utterance", "at_ms": 0}], speed=2.0, loops=2)
    assert [(r.type, r.at_ms) for r in e.orderBy("seq").collect()] == [("utterance", 0), ("fact", 50), ("utterance", 50), ("fact", 100)]
    assert provider("X", fixture=1, x=2) == 2 and provider(None, fixture=1) == 1


def test_session(spark):
    rng = np.random.default_rng(2)
    voice = np.eye(16)[:2]
    turns = spark.createDataFrame([(1, f"turn-{i}", 2000 * i, 2000 * i + 2000, (voice[i % 2] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(4)], "conversation_id long, label string, start_ms long, end_ms long, embedding array<double>")
    spans = turns.select("conversation_id", F.col("label").alias("speaker"), "start_ms", "end_ms")
    words = spark.createDataFrame([(1, i, 0, f"w{i}", 2000 * i + 100, 2000 * i + 300) for i in range(5)], "conversation_id long, utterance_id long, position int, text string, start_ms long, end_ms long")
    got = session.session_utterances(words, spans, turns, clock_ms=4500)
    assert rows(got, "run", "speaker", "text", "is_final") == [(1, "cluster-0", "w0", True), (2, "cluster-1", "w1", True), (3, "cluster-0", "w2", False), (4, "cluster-1", "w3", False)]
    prints = spark.createDataFrame([(1, 7, voice[0].tolist())], "voiceprint_id long, person_id long, embedding array<double>")
    people = spark.createDataFrame([(7, "Ann")], "person_id long, name string")
    d = session.session_decisions(spans, turns, prints, people)
    assert rows(d, "query_id", "kind", "person_id") == [("1:cluster-0", "match", 7), ("1:cluster-1", "new", None)]


def test_partial_turns(spark):
    e = [(1, "started", "a", 900, None), (2, "delta", "a", 1000, "hel"), (3, "delta", "a", 1100, "lo"), (4, "stopped", "a", 1500, None), (5, "started", "b", 1400, None), (6, "delta", "b", 1600, "yes"), (7, "completed", "a", 1700, "Hello."), (8, "completed", "b", 1800, "Yes."), (9, "delta", "c", 1900, "x")]
    got = session.partial_turns(spark.createDataFrame([(1, *x) for x in e], "conversation_id long, seq long, type string, item_id string, at_ms long, text string"))
    assert rows(got, "seq", "label", "text", "start_ms", "end_ms") == [(2, "turn-0", "hel", 900, 1000), (3, "turn-0", "hello", 900, 1100), (6, "turn-1", "yes", 1500, 1600), (7, "turn-0", "Hello.", 900, 1500), (8, "turn-1", "Yes.", 1500, 1800), (9, "turn-2", "x", 1500, 1900)]


def test_predates(spark):
    u = spark.createDataFrame([(1, 1, 0, DAY(2)), (2, 1, 50, DAY(1)), (3, 2, 0, DAY(3))], "utterance_id long, conversation_id long, start_ms long, created_at timestamp")
    now = spark.createDataFrame([(10, 1), (11, 99)], "fact_id long, source_utterance_id long")
    c = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 10), (4, 3, 11), (5, 1, 11)], "candidate_id long, source_utterance_id long, current_id long")
    assert rows(facts.predates(c, now, u), "candidate_id", "stale") == [(1, True), (2, False), (3, False), (4, False), (5, False)]


def test_spoken_facts(spark):
    empty = spark.createDataFrame([], "fact_id string, person_id string, attribute string, claim string, source_utterance_id string, valid_from timestamp, superseded_by string, superseded_at timestamp")
    m = Memory(None, empty, None, None)
    for i, value in enumerate(["July 14", "July 15", "July 15", "July 14"]):
        m = m.set_birthday("p", value, f"f{i}", DAY(i + 1))
    assert rows(m.facts, "fact_id", "superseded_by", "source_utterance_id") == [("f0", "f1", "spoken-birthday-initial"), ("f1", "f3", "spoken-birthday-f0"), ("f3", None, "spoken-birthday-f1")]
    m = m.add_note("p", "Likes tea", "n1", DAY(9)).add_note("p", "Likes tea", "n2", DAY(10))
    assert m.facts.where("attribute = 'note'").count() == 1


def test_hooks(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id long, text string")
    out = d.withColumn("v", hooks.embedder(lambda xs: [[len(x), 1.0] for x in xs], 2, batch=1)(F.col("text")))
    assert [r.v for r in out.orderBy("id").collect()] == [[2.0, 1.0], None, [1.0, 1.0]]
    assert hooks.checked_vectors(out, "v", 2).count() == 3
    with pytest.raises(Exception, match="dimensions"):
        hooks.checked_vectors(out, "v", 3).collect()
    steps = spark.createDataFrame([("r", "search_memory")] * 6 + [("q", None), ("q", "add_note")], "request_id string, tool string")
    assert rows(hooks.over_budget(steps), "request_id", "calls") == [("r", 6)]
    assert retrieval.search_mode("1") == "manual" and retrieval.search_mode(None) == "fused"


def test_stamp_and_lists(spark):
    u = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "utterance_id long, cluster_id string, person_id long")
    d = spark.createDataFrame([("a", 9), ("b", None)], "cluster_id string, person_id long")
    assert rows(identity.stamp(u, d), "utterance_id", "person_id") == [(1, 9), (2, 5)]
    allowed = spark.range(1).select(identity.wake_allowed(F.lit("go"), F.lit(0), F.lit(0), F.lit(0.6)), identity.wake_allowed(F.lit("go"), F.lit(0), F.lit(0), F.lit(None).cast("double")))
    assert allowed.first()[:] == (True, False)
    drafts = spark.createDataFrame([(1, "x@y", None, DAY(1)), (2, "x@y", DAY(2), DAY(2)), (3, " ", None, DAY(3))], "draft_id long, `to` string, sent_at timestamp, created_at timestamp")
    assert [(r.draft_id, r.sendable) for r in sinks.drafts_to_send(drafts).collect()] == [(3, False), (2, False), (1, True)]
    by = views.keyed(u, "cluster_id", "utterance_id").where("cluster_id = 'b'").first().by_id
    assert by[2].person_id == 5 and views.public_row(spark.createDataFrame([(1, [1.0])], "i long, embedding array<double>")).columns == ["i"]


def test_ensure_tables(spark, tmp_path):
    made = sinks.ensure_tables(spark, f"{tmp_path}/store")
    assert sorted(made) == sorted(TABLES) and sinks.ensure_tables(spark, f"{tmp_path}/store") == []
    assert read_table(spark, f"{tmp_path}/store", "facts").count() == 0


def test_attribution_that_mints(spark):
    rng = np.random.default_rng(4)
    voices = rng.standard_normal((6, 8))
    said = [voices[i] + 0.2 * rng.standard_normal(8) for i in (3, 0, 4, 3, 5, 4, 1, 3)]
    prints = [(i, voices[i].tolist()) for i in range(3)]
    c = spark.createDataFrame([(1, n, f"q{n}", v.tolist(), 5000) for n, v in enumerate(said)] + [(2, 0, "r0", said[0].tolist(), 5000), (2, 1, "r1", said[0].tolist(), 2000)], "s long, seq long, query_id string, query array<double>, speech_ms long")
    vp = spark.createDataFrame([(i, i, v) for i, v in prints], "voiceprint_id long, person_id long, embedding array<double>")
    people = spark.createDataFrame([(i,) for i in range(3)], "person_id long")
    got = {r.query_id: (r.kind, r.person_id) for r in identity.attribute_minting(c, vp, people, "s").collect()}
    want = {q: (k, str(p)) for q, k, p in identity.attribute_in_order([(f"q{n}", v) for n, v in enumerate(said)], prints)}
    assert {q: x for q, x in got.items() if q[0] == "q"} == want and {k for k, _ in want.values()} == {"new", "match"}
    assert got["r0"] == ("new", "person-r0") and got["r1"] == ("pending", None)  # another session has minted this voice, which isn't known here


def test_enroll(spark):
    kind = "voiceprint_id string, person_id string, embedding array<double>"
    vp, people = spark.createDataFrame([("v0", "p0", [1.0, 0.0])], kind), spark.createDataFrame([("p0", "Ann", 5)], "person_id string, name string, created_ms long")
    ask = lambda *r: spark.createDataFrame(list(r), kind + ", name string")
    v, p = identity.enroll(vp, people, ask(("v1", "p0", [0.0, 1.0], None), ("v2", None, [1.0, 1.0], "Bo"), ("v3", None, [1.0, 1.0], None)), 2)
    assert rows(v, "voiceprint_id", "person_id") == [("v0", "p0"), ("v1", "p0"), ("v2", "v2"), ("v3", "v3")]
    assert rows(p, "person_id", "name") == [("p0", "Ann"), ("v2", "Bo"), ("v3", "Unknown")]
    for bad in (("v4", "p0", [1.0], None), ("v4", "p0", None, None), ("v4", "p9", [1.0, 1.0], None)):
        with pytest.raises(Exception, match="voiceprints must have|unknown person"):
            identity.enroll(vp, people, ask(bad), 2)[0].collect()


def test_search_falls_back(spark):
    f = spark.createDataFrame([(i, None if i % 2 else 99) for i in range(1, 9)], "fact_id long, superseded_by long")
    sem = spark.createDataFrame([(i, float(10 - i)) for i in range(1, 9)], "fact_id long, score double")
    lex = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "fact_id long, score double")

    def broken():
        raise OSError("no index")

    ids = lambda df: [r.fact_id for r in df.collect()]
    assert ids(retrieval.search_or_fall_back(f, sem, broken, None, 4)) == ids(retrieval.search_facts(f, sem, None, "manual", 4)) == [1, 3]
    assert ids(retrieval.search_or_fall_back(f, sem, lambda: lex, None, 4)) == ids(retrieval.search_facts(f, sem, lex, "fused", 4))
    assert ids(retrieval.search_or_fall_back(f, sem, lambda: lex, "1", 4)) == ids(retrieval.search_facts(f, sem, lex, "manual", 4))


def test_answers_cite_by_kind_and_id(spark):
    results = spark.createDataFrame([(1, "fact", 7, 1), (1, "promise", 7, 2), (1, "utterance", 8, 3)], "query_id long, kind string, id long, place int")
    wording = spark.createDataFrame([(1, "said", ["fact:7", "utterance:8", "fact:9"])], "query_id long, text string, used array<string>")
    got = {r.query_id: (r.text, r.citations) for r in retrieval.answers(spark.range(1, 3).toDF("query_id"), results, wording).collect()}
    assert got == {1: ("said", ["fact:7", "utterance:8"]), 2: (retrieval.NO_EVIDENCE, [])}


def test_loops_are_numbered_by_many_tasks(spark):
    rows = [(i, i % 3, ("open", "done")[i % 4 == 0], None if i % 5 == 0 else i * 7 % 11) for i in range(300)]
    df = views.loops(spark.createDataFrame(rows, "promise_id long, person_id long, status string, due_at int").repartition(7))
    assert "row_number" not in df._jdf.queryExecution().optimizedPlan().toString()
    kind = lambda r: "closed" if r[2] != "open" else "owing" if r[1] == 0 else "owed"
    want = {}
    for name in ("closed", "owing", "owed"):
        mine = sorted((r for r in rows if kind(r) == name), key=lambda r: (r[3] is None, r[3] or 0, r[0]))
        want |= {r[0]: (name, i + 1) for i, r in enumerate(mine)}
    assert {r.promise_id: (r.list, r.place) for r in df.collect()} == want


def test_a_deleted_conversation_goes_to_the_tables(spark):
    u = spark.createDataFrame([(1, 7), (2, 8)], "utterance_id long, conversation_id long").repartition(3)
    t = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id long, source_utterance_id long").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keep, counts = sinks.cascade_delete(F.lit(7), u, t, t)
        assert counts.first()[:] == (1, 2, 2) and "SortMergeJoin" not in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_normalized_blocks_in_parts_of_a_product(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, i % 4, rng.normal(size=5).tolist()) for i in range(60)], "voiceprint_id long, person_id long, embedding array<double>")
    got = lambda: sorted((r.test_id, r.enrolled_id, round(r.normalized, 9)) for r in scoring.normalized_in_blocks(p.where("voiceprint_id % 3 = 0"), p, top=4).collect())
    whole = got()
    monkeypatch.setattr(scoring, "CELLS", 180)  # three rows of a product at a time
    want = scoring.normalized_trials(scoring.trial_pairs(p.where("voiceprint_id % 3 = 0"), p), 4).collect()
    assert got() == whole == sorted((r.test_id, r.enrolled_id, round(r.normalized, 9)) for r in want) and len(whole) == 20 * 59


def test_normalized_blocks_are_never_broadcast(spark, monkeypatch):
    plans, settle = [], scoring.settle

    def seen(df):
        out = settle(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran, with what was decided on the way
        return out

    monkeypatch.setattr(scoring, "settle", seen)
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, i % 4, rng.normal(size=5).tolist()) for i in range(60)], "voiceprint_id long, person_id long, embedding array<double>")
    trials = scoring.normalized_in_blocks(p.where("voiceprint_id % 3 = 0"), p, top=4, block=16)
    assert trials.count() == 20 * 59
    plans.append(trials._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join [block" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
