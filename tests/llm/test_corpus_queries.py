"""The registered queries over a whole small folder: against SQL where there is some, else against brute force."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from ctxlens.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()], strict=True)), dict(zip(t["doc_id"].to_pylist(), t["source"].to_pylist(), strict=True))


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = sorted(str(tuple(r[cols.index(c)] for c in sorted(cols))) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r[c] for c in sorted(cols))) for r in df.collect()) == want


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, got = 0, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op1_token_records")}
    for d in sorted(docs[0]):
        ids = tok.encode(docs[0][d], add_special_tokens=False).ids + [0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs[0])


def test_op2_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), "f8")
    got: dict = {}
    for r in rows(spark, "op2_vector_search"):
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(best.tolist()) & set(got[ids[i]]))
        assert len(got[ids[i]]) == 20 and all(abs(v - s[np.flatnonzero(ids == k)[0]]) < 1e-12 for k, v in got[ids[i]].items())
    assert hit / (20 * len(got)) >= 0.9


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op3_token_counts")}
    for d, t in docs[0].items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[d] == (len(t.encode()), n, n > 1024)


def test_op4(spark, docs):
    got = rows(spark, "op4_source_mix")
    size = {d: len(WORDS.findall(t)) for d, t in docs[0].items()}
    names = sorted(set(docs[1].values()))
    total = {s: sum(size[d] for d in size if docs[1][d] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, list(names)
    while True:  # the excess is shared anew until none is above
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free = [s for s in free if s not in over]
    target |= share
    assert len(got) == len(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[docs[1][r.doc_id]]) and r.target == pytest.approx(target[docs[1][r.doc_id]]) and 0 <= r.taken <= 2 * r.size
    for s in names:
        assert abs(sum(r.taken for r in got if docs[1][r.doc_id] == s) - target[s]) <= 1


def test_op5(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in rows(spark, "op5_secret_scan"):
        t = docs[0][r.doc_id]
        found = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[0] == k for f in found) for k in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_op10(spark, docs):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, "op10_bpe_codec"):
        ids = np.array(enc.encode_ordinary(docs[0][r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[0][r.doc_id].encode()).hexdigest())
