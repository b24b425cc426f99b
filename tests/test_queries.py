"""Every registered query over a small folder, against its SQL twin where there is one."""

import datetime as dt
import os

import duckdb
import pytest

from ctxlens.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert df.columns and (got or name == "session_decisions")
        return
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(str([plain(r[cols.index(c)]) for c in order]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in got) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_voice_is_decided_on(spark, con):
    asked = {r.query_id for r in QUERIES["decide_speaker"](spark, SF).collect()}
    assert asked == {i for (i,) in con.execute("SELECT vec_id FROM embeddings").fetchall()}


@pytest.mark.parametrize("name", ["enroll_voices"])
def test_query_with_large_ids(spark, con, tmp_path, name):
    """Ids beyond a hundred thousand, as a gigabyte has them."""
    for f in os.listdir(SF):
        con.execute(f"copy (select *{' replace (vec_id + 99960 as vec_id)' if f == 'embeddings.parquet' else ''} from '{SF}/{f}') to '{tmp_path}/{f}'")
    own = duckdb.connect()
    for f in os.listdir(SF):
        own.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tmp_path}/{f}'")
    df = QUERIES[name](spark, str(tmp_path))
    cur = own.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str(list(r)) for r in cur.fetchall())
