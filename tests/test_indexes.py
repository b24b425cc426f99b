"""Persisted indexes of vectors and words, and the keyed log table, against brute force."""

import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxlens.operators import vector_index
from ctxlens.operators.retrieval import bm25
from ctxlens.operators.text_index import TextIndex
from ctxlens.operators.vector_index import Shape, VectorIndex
from ctxlens.sources.log_table import LogTable, MissingBatch


def vectors(kind, n=900, d=12):
    rng = np.random.default_rng(4)
    if kind == "isotropic":
        return rng.standard_normal((n, d))
    x = rng.standard_normal((20, d))[rng.integers(0, 20, n)] * 3 + rng.standard_normal((n, d)) * 0.1
    x[3] = 0
    x[700:800] = x[700]  # copies
    return x


def cosines(x):
    n = np.sqrt((x * x).sum(1))
    mag = np.outer(n, n)
    return np.divide(x @ x.T, mag, out=np.zeros_like(mag), where=mag > 0).round(12)


@pytest.fixture(scope="module", params=["isotropic", "clustered"])
def built(request, spark, tmp_path_factory):
    x = vectors(request.param)
    df = spark.createDataFrame([(i, i % 30, v.tolist()) for i, v in enumerate(x)], "voiceprint_id long, person_id long, embedding array<double>")
    odd = spark.createDataFrame([(9000, 1, None), (9001, 1, []), (9002, 1, [float("nan")] * 12), (9003, 1, [1.0]), (9004, None, [None] * 12)], df.schema)
    index = VectorIndex.build(df.where("voiceprint_id < 600").unionByName(odd), str(tmp_path_factory.mktemp("index")), "voiceprint_id", tag="person_id", shape=Shape(block=32, group=16))
    index.add(df.where("voiceprint_id >= 600"), "voiceprint_id", tag="person_id")
    return request.param, index, df, cosines(x)


def neighbours(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(int(r.query_id), {})[r["rank"]] = (int(r.id), r.cosine)
    return {q: [h[i] for i in sorted(h)] for q, h in out.items()}


def test_index_search_is_exact(built):
    _, index, df, cos = built
    asked = df.where("voiceprint_id % 20 = 0 OR voiceprint_id = 3").selectExpr("voiceprint_id AS query_id", "embedding AS query")
    got = neighbours(index.search(asked, 4).collect())
    for q, hits in got.items():
        assert hits == [(i, cos[q, i]) for i in sorted(range(len(cos)), key=lambda i: (-cos[q, i], i))[:4]]
    assert len(got) == 46


def test_index_filters_by_person_before_ranking(built):
    _, index, df, cos = built
    asked = df.where("voiceprint_id % 20 = 0").selectExpr("voiceprint_id AS query_id", "embedding AS query", "CASE WHEN voiceprint_id % 40 = 0 THEN person_id END AS only")
    for q, hits in neighbours(index.search(asked, 4, tag="only").collect()).items():
        mine = [i for i in range(len(cos)) if q % 40 or i % 30 == q % 30]
        assert [i for i, _ in hits] == sorted(mine, key=lambda i: (-cos[q, i], i))[:4]


def test_index_above_a_floor(built):
    _, index, df, cos = built
    asked = df.where("voiceprint_id % 50 = 0").selectExpr("voiceprint_id AS query_id", "embedding AS query")
    got = {(int(r.query_id), int(r.id)) for r in index.above(asked, 0.6).collect()}
    assert got == {(q, i) for q in range(0, len(cos), 50) for i in range(len(cos)) if cos[q, i] >= 0.6}


def test_index_above_keeps_the_nearest_and_is_never_broadcast(built):
    _, index, df, cos = built
    asked = df.where("voiceprint_id % 10 = 0").selectExpr("voiceprint_id AS query_id", "embedding AS query")
    hits = index.above(asked, 0.6, 2)
    got = {(int(r.query_id), int(r.id)) for r in hits.collect()}
    fits = {q: [i for i in range(len(cos)) if cos[q, i] >= 0.6] for q in range(0, len(cos), 10)}
    assert got <= {(q, i) for q, near in fits.items() for i in near}
    assert got >= {(q, i) for q, near in fits.items() for i in sorted(near, key=lambda i: (-cos[q, i], i))[:2]}
    joins = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [list" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


def test_queries_of_a_task_meet_a_list_together(built, monkeypatch):
    _, index, df, cos = built
    asked = df.where("voiceprint_id % 10 = 0").selectExpr("voiceprint_id AS query_id", "embedding AS query").coalesce(1)
    packed = []
    monkeypatch.setattr(VectorIndex, "_met", lambda self, asks, *a, **k: packed.extend(asks.collect()) or asks)
    index.above(asked, -1.0)
    n, lists = len(range(0, len(cos), 10)), index._parts()[index.sizes > 0].sum()
    assert len(packed) == lists * -(-n // index.shape.group) and sum(len(r.query_ids) for r in packed) == lists * n


def test_bounds_leave_out_lists_of_clustered_prints(built):
    kind, index, df, cos = built
    x = vectors(kind)
    bound = index.bounds(x[:50])
    assert kind != "clustered" or (bound < 0.6).mean() > 0.3
    asked = df.where("voiceprint_id % 20 = 0").selectExpr("voiceprint_id AS query_id", "embedding AS query")
    few = neighbours(index.search(asked, 4, probe=0.5).collect())
    found = sum(len({c for _, c in few[q]} & {cos[q, i] for i in np.argsort(-cos[q], kind="stable")[:4]}) for q in few)
    assert found / sum(len({cos[q, i] for i in np.argsort(-cos[q], kind="stable")[:4]}) for q in few) >= (0.9 if kind == "clustered" else 0.6)


def test_index_of_nothing_and_repeated_adds(spark, tmp_path):
    empty = spark.createDataFrame([], "voiceprint_id long, person_id long, embedding array<double>")
    index = VectorIndex.build(empty, f"{tmp_path}/a", "voiceprint_id")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>"), 3).count() == 0
    rows = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(10)], empty.schema)
    index = VectorIndex.build(rows, f"{tmp_path}/b", "voiceprint_id")
    more = spark.createDataFrame([(i, 1, [float(i), -1.0]) for i in range(10, 14)], empty.schema)
    for _ in range(2):  # the same version again
        index.add(more, "voiceprint_id", version=2)
    assert index.sizes.sum() == 14
    hits = index.search(more.selectExpr("voiceprint_id AS query_id", "embedding AS query"), 14)
    assert hits.groupBy("query_id").count().where("count = 14").count() == 4
    assert vector_index._bounds(index.centroids, index.widths, np.zeros((1, 2))).min() == 1.0  # a zero vector may match anywhere


TEXTS = ["The move is in September", "the the dinner", None, "", "move move MOVE!", "dinner, then a move", "ümlaut Größe", "nothing here", "42 is the answer"]


def test_text_index_equals_the_scan(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    index = TextIndex(spark, str(tmp_path), buckets=16)
    index.add(df.where("id < 5"), "id", F.col("text"), 0)
    for _ in range(2):
        index.add(df.where("id >= 5"), "id", F.col("text"), 1)
    asked = spark.createDataFrame([(1, "The move"), (2, "größe ümlaut"), (3, "absent words"), (4, None), (5, "the the THE")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in index.search(asked).collect()}
    for q, terms in ((1, ["the", "move"]), (2, ["größe", "ümlaut"]), (5, ["the"])):
        want = {(q, r.id): r.score for r in bm25(df, terms, "id", F.coalesce("text", F.lit(""))).collect()}
        assert {k: v for k, v in got.items() if k[0] == q} == pytest.approx(want)
    assert {k[0] for k in got} == {1, 2, 5}
    best = {(r.query_id, r["rank"]): r.doc_id for r in index.search(asked, limit=2).collect()}
    for q in (1, 2, 5):
        mine = sorted((-round(s, 12), d) for (k, d), s in got.items() if k == q)[:2]
        assert [best[q, i + 1] for i in range(len(mine))] == [d for _, d in mine]


def test_text_index_splits_a_text_once(spark, tmp_path):
    df, seen = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    TextIndex(spark, str(tmp_path), buckets=4).add(df, "id", F.udf(same).asNondeterministic()("text"))
    assert seen.value == len(TEXTS)
    total = spark.read.parquet(f"{tmp_path}/totals").first()
    assert (total.docs, total.length) == (len(TEXTS), sum(len(re.findall(r"\w+", t or "")) for t in TEXTS))


def test_text_index_reads_only_wanted_buckets(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(200)], "id long, text string")
    index = TextIndex(spark, str(tmp_path), buckets=64)
    index.add(df, "id", F.col("text"))
    plan = index.search(spark.createDataFrame([(1, "w7 w9")], "query_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    wanted = re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|=)[^\]]*\]", plan)
    assert len(wanted) >= 2
    n, df7 = 200, sum("w7" in r.text.split() for r in df.collect())
    r = index.search(spark.createDataFrame([(1, "w7")], "query_id int, text string")).first()
    tf = df.where(f"id = {r.doc_id}").first().text.split().count("w7")
    assert r.score == pytest.approx(math.log1p((n - df7 + 0.5) / (df7 + 0.5)) * tf * 2.2 / (tf + 1.2))  # all texts have 30 words


SCHEMA = "id long, text string, seq long, created long"


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def log(spark, folder):
    return LogTable(spark, str(folder), rows(spark).schema, ["id"], "seq", "created", buckets=4)


def state(t):
    return {r.id: (r.text, r.created) for r in t.read().collect()}


def test_log_table_folds_batches(spark, tmp_path):
    t = log(spark, tmp_path)
    assert state(t) == {} and t.last() == -1
    assert t.append(rows(spark, (1, "a", 1, 1), (1, "b", 2, 2), (2, "x", 1, 1)), 0)
    assert t.append(rows(spark, (1, "c", 1, 9), (3, "n", 5, 5), (None, "null key", 1, 1)), 1)
    want = {1: ("c", 1), 2: ("x", 1), 3: ("n", 5), None: ("null key", 1)}
    assert state(t) == want
    assert not t.append(rows(spark, (1, "again", 9, 9)), 1) and state(t) == want  # a replay
    assert t.compact() == 1 and state(t) == want and t.compact() == 1
    assert not t.append(rows(spark, (1, "again", 9, 9)), 0) and t.append(rows(spark, (2, "y", 1, 7)), 2)
    assert state(t) == want | {2: ("y", 1)}


def test_log_table_survives_a_killed_batch(spark, tmp_path, monkeypatch):
    t = log(spark, tmp_path)
    t.append(rows(spark, (1, "a", 1, 1)), 0)

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(LogTable, "_commit", die)
    with pytest.raises(RuntimeError):
        t.append(rows(spark, (1, "half", 2, 2), (2, "half", 2, 2)), 1)
    with pytest.raises(RuntimeError):
        t.compact()
    monkeypatch.undo()
    assert state(t) == {1: ("a", 1)}  # what isn't committed isn't there
    assert t.append(rows(spark, (1, "whole", 2, 2)), 1) and state(t) == {1: ("whole", 1)}


def test_log_table_notices_a_missing_batch(spark, tmp_path):
    t = log(spark, tmp_path)
    with pytest.raises(MissingBatch):
        t.append(rows(spark, (1, "a", 1, 1)), 3)
    for i in range(3):
        t.append(rows(spark, (i, "a", 1, 1)), i)
    import shutil

    shutil.move(f"{tmp_path}/commits/batch=1", f"{tmp_path}/gone-{uuid.uuid4().hex}")
    with pytest.raises(MissingBatch):
        t.read()


def test_log_table_writes_follow_the_batch(spark, tmp_path):
    import os

    t = log(spark, tmp_path)
    t.append(spark.range(20_000).selectExpr("id", "uuid() AS text", "1L AS seq", "1L AS created"), 0)
    t.append(rows(spark, (5, "new", 2, 2)), 1)
    size = lambda b: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{tmp_path}/log/batch={b}") for f in fs)
    assert size(1) * 50 < size(0) and t.read().count() == 20_000


def test_catalog_keeps_a_store_to_its_declaration(spark, tmp_path):
    from ctxlens.schemas import TABLES
    from ctxlens.sources import catalog

    base, built = f"{tmp_path}/store", []
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")

    def words(spark, folder):
        built.append(folder)
        TextIndex(spark, folder, buckets=4).add(docs, "id", F.col("text"))

    one, two, three = (catalog.SearchIndex("facts", n, words) for n in ("claims", "values", "notes"))
    first = catalog.apply(spark, base, [one, two], allowance=2)
    assert len(first) == len(TABLES) + 2 and first[-2:] == ["created search index facts.claims", "created search index facts.values"]
    assert catalog.apply(spark, base, [one, two], allowance=2) == [] and len(built) == 2
    with pytest.raises(catalog.OverAllowance):
        catalog.apply(spark, base, [one, three], allowance=2)  # the undeclared one takes up a place
    assert [r.name for r in catalog.survey(spark, base).collect()] == ["claims", "values"] and len(built) == 2
    assert catalog.apply(spark, base, [one, three], allowance=2, prune=True) == ["dropped search index facts.values", "created search index facts.notes"]
    held = {r.name: r.folder for r in catalog.survey(spark, base).collect()}
    assert set(held) == {"claims", "notes"}
    assert TextIndex(spark, held["notes"], buckets=4).search(spark.createDataFrame([(1, "move")], "query_id int, text string")).count() == 3
