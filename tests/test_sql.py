"""Questions in SQL alone."""

import os

import pytest

from ctxlens.engine import Memory
from ctxlens.operators import retrieval
from ctxlens.plans.sql import register
from ctxlens.sources.tables import Bench

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_views_and_functions(spark):
    b = Bench(spark, SF)
    m = Memory(b.people(), b.facts(), b.promises(), b.utterances())
    names = register(spark, m)
    assert {"current_facts", "context_changes", "fact_history"} <= set(names)
    busy = spark.sql("SELECT person_id, slot, count(*) AS n FROM facts GROUP BY ALL ORDER BY n DESC, person_id, slot LIMIT 1").first()
    history = spark.sql(f"SELECT fact_id FROM fact_history({busy.person_id}, '{busy.slot}')").collect()
    assert len(history) == busy.n and [r.fact_id for r in history] == [r.fact_id for r in m.resolve_fact_state(busy.person_id, busy.slot)[1].collect()]
    now = spark.sql(f"SELECT fact_id FROM fact_now({busy.person_id}, '{busy.slot}')").collect()
    assert [r.fact_id for r in now] == [history[-1].fact_id]
    both = spark.sql("SELECT p.name, c.claim FROM current_facts c JOIN people p USING (person_id) WHERE c.superseded_by IS NULL").count()
    assert both == m.facts.where("superseded_by IS NULL").join(m.people, "person_id").count() > 0
    talk = b.utterances().first().conversation_id
    assert spark.sql(f"SELECT utterance_id FROM said_in({talk})").collect() == m.list_utterances(talk).select("utterance_id").collect()
    assert spark.sql("SELECT change_id FROM context_changes").count() == m.context_changes(25).count() or spark.sql("SELECT change_id FROM context_changes").count() > 25
    word = b.utterances().where("length(text) > 20").first().text.split()[1]
    assert spark.sql(f"SELECT count(*) AS n FROM texts_with('{word.upper()}') WHERE kind = 'utterance'").first().n >= 1


def test_the_fused_search_falls_back_while_running(spark):
    f = spark.createDataFrame([(1, None), (2, "9"), (3, None)], "fact_id long, superseded_by string")
    semantic = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "fact_id long, score double")
    late = spark.range(3).selectExpr("id AS fact_id", "CAST(raise_error('index is gone') AS DOUBLE) AS score")  # plans, and fails when it runs
    got = [r.fact_id for r in retrieval.search_or_fall_back(f, semantic, lambda: late, None, 4).collect()]
    assert got == [r.fact_id for r in retrieval.search_facts(f, semantic, None, "manual", 4).collect()] == [1, 3]
