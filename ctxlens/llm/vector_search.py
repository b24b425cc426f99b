"""Approximate nearest neighbours by adaptive dimension scan (operator 2).

Vectors are rotated at random, put into inverted lists by their nearest centroid, and stored per
list in column blocks of the rotated dimensions. A query scans the lists that its inner product
with the centroids ranks first, as many as a sample says hold enough of the true neighbours. Within a list the blocks are read one after the other; a candidate
is abandoned as soon as its partial squared distance, scaled to all dimensions, exceeds by a
hypothesis test what the query's current k-th neighbour allows. Survivors are scored exactly, in
double precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


@dataclass(frozen=True)
class Params:
    """sample: vectors that rotation, centroids and the share of lists to scan are fitted on (the bound; every vector is indexed).

    target: share of the true neighbours whose lists a query has to scan; how many lists that takes is measured on ``tries``
    vectors of the sample by brute force, unless ``probe`` gives the share of the lists. rounds: shares of lists after
    which the k-th score is renewed. eps: width of the test; a true neighbour is lost with a probability that falls
    with exp(-eps**2). sparse: share of candidates left at which a block goes on pair by pair.
    """

    sample: int = 16_384
    max_lists: int = 4096
    target: float = 0.96
    tries: int = 256
    probe: float | None = None
    rounds: tuple[float, ...] = (1 / 64, 1 / 8)
    eps: float = 2.1
    columns: int = 8
    sparse: float = 0.25
    block: int = 1024
    group: int = 512
    seed: int = 7


@dataclass(frozen=True)
class Codebook:
    """probe: share of the lists to scan."""

    rotation: np.ndarray
    centroids: np.ndarray
    probe: float


def usable(vec: Column) -> Column:
    """Not null, not zero, every component finite."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def fit(vectors: DataFrame, n: int, dims: int, p: Params, k: int) -> Codebook:
    """Rotation, centroids and the share of lists from at most 2 * p.sample vectors, the least by a hash of id and vector."""
    step = max(1, n // p.sample)
    key = F.xxhash64("vec_id", "vec")
    rows = vectors.where(F.pmod(key, F.lit(step)) == 0).select(key.alias("key"), "vec_id", "vec").orderBy("key", "vec_id").limit(2 * p.sample).collect()
    x = np.array([r.vec for r in rows], "f8").reshape(-1, dims)
    rng = np.random.default_rng(p.seed)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    lists = int(min(p.max_lists, max(1, len(x) // 4), 4 << max(0, round(np.log2(max(1, n) ** 0.5)))))
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)] if len(x) else np.zeros((1, dims))
    for _ in range(8):
        near = assign(x, c)
        n_of = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n_of[:, None] > 0, total / np.maximum(n_of, 1)[:, None], c)
    return Codebook(rotation, c, share_to_scan(x, c, p, k) if p.probe is None else p.probe)


def share_to_scan(x: np.ndarray, c: np.ndarray, p: Params, k: int) -> float:
    """The share of lists, in a query's order, that holds ``target`` of the k nearest within the sample.

    In a sample neighbours are farther than in the whole, so it is rather too large.
    """
    if len(x) < 2:
        return 1.0
    q = x[: p.tries]  # in the order of a hash
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    ranks = rank[np.arange(len(q))[:, None], assign(x, c)[best]]
    return float(np.quantile(ranks + 1, p.target, method="higher")) / len(c)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1) if len(x) else np.zeros(0, int)


def scan_block(ids, q, cand_ids, cols, x, tau, rotation, p: Params, k: int, repeated: bool = False):
    """(query row, candidate row, score) of a block's candidates that can be among a query's k nearest.

    q, x: original vectors; cols: the candidates' rotated dimensions in column blocks; tau: current
    k-th score of each query. After each column block the candidates whose partial distance fails the test are
    abandoned. Per query at most k survive, ties to the smaller id. ``repeated``: ids aren't unique, and a row is left out as
    the query's own if its vector is the query's, too.
    """
    dims = q.shape[1]
    rq = q @ rotation
    scale = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    allowed = scale - 2 * tau[:, None]  # squared distance of a candidate that just ties with tau
    slack = 1e-9 * scale
    d, qi, ci, part = 0, None, None, np.zeros((len(q), len(x)))
    for col in cols:
        rb = rq[:, d : d + col.shape[1]]
        d += col.shape[1]
        widen = (1 + p.eps / np.sqrt(d)) ** 2 if d < dims else 1.0
        if qi is None:
            part += (rb * rb).sum(1)[:, None] + (col * col).sum(1)[None, :] - 2 * rb @ col.T
            on = part * (dims / d) <= allowed * widen + slack * (dims / d)
            if d < dims and on.mean() > p.sparse:
                continue
            if d == dims and len(x) > k:  # nothing beyond the k-th of this block can matter
                far = part - scale  # minus twice the score
                on &= far <= np.partition(far, k, axis=1)[:, k, None] + slack
            qi, ci = np.nonzero(on)
            part = part[qi, ci]
        else:
            diff = rb[qi] - col[ci]
            part = part + (diff * diff).sum(1)
            on = part * (dims / d) <= allowed[qi, ci] * widen + slack[qi, ci] * (dims / d)
            qi, ci, part = qi[on], ci[on], part[on]
    own = ids[qi] == cand_ids[ci]
    if repeated:
        own[own] = (q[qi[own]] == x[ci[own]]).all(axis=1)
    qi, ci = qi[~own], ci[~own]
    score = np.concatenate([np.einsum("ij,ij->i", q[qi[a : a + 65536]], x[ci[a : a + 65536]]) for a in range(0, len(qi), 65536)] or [np.zeros(0)])
    on = score >= tau[qi]
    qi, ci, score = qi[on], ci[on], score[on]
    order = np.lexsort((cand_ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.searchsorted(qi, qi)
    on = np.arange(len(qi)) - first < k
    return qi[on], ci[on], score[on]


def build_index(vectors: DataFrame, book: Codebook, kind: str, p: Params) -> DataFrame:
    """(list, block, ids, columns, original): packed blocks of at most about p.block vectors.

    A list that holds many vectors (copies of one, say) is dealt over as many blocks, so no group grows.
    """
    import pyarrow as pa

    dims = len(book.rotation)

    def place(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), "f8").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(bytes, x.astype(kind))), pa.binary()), pa.array(assign(x, book.centroids), pa.int32())], ["vec_id", "raw", "list"])

    placed = vectors.select("vec_id", "vec").mapInArrow(place, "vec_id long, raw binary, list int")
    blocks = {r.list: -(-r.n // p.block) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    table = [blocks.get(i, 1) for i in range(len(book.centroids))]
    of_list = F.element_at(F.lit(table), F.col("list") + 1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), of_list).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = np.frombuffer(b"".join(t["raw"].to_pylist()), kind).reshape(-1, dims)
        r = x.astype("f8") @ book.rotation
        cols = [np.ascontiguousarray(r[:, a : a + p.columns]).tobytes() for a in range(0, dims, p.columns)]
        one = t.slice(0, 1)
        return pa.table({"list": one["list"], "block": one["block"], "ids": pa.array([t["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "cols": pa.array([cols], pa.list_(pa.binary())), "raw": pa.array([x.tobytes()], pa.binary())})

    return dealt.groupBy("list", "block").applyInArrow(pack, "list int, block int, ids binary, cols array<binary>, raw binary")


def search(rows: DataFrame, is_query: Column, k: int = 20, p: Params = Params(), vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows by inner product.

    Rows whose id or vector is null, whose vector is zero or not finite, or whose length is not the
    table's most frequent one, take no part. Of rows that share an id, equal ones count as one; another vector under the query's
    id is a candidate like any other; an id has one ranking, in which a candidate id has its best score. Equal scores go
    to the smaller id. Extra columns are ignored; an empty table gives no rows.

    A query that met fewer than k candidates in its share of the lists scans all others, so it returns k unless
    the table has fewer.

    Queries and candidate blocks meet by an equi-join on the list; both sides are packed rows of bounded
    size. After each round of lists the k-th score of a query is renewed, which bounds what the next
    round lets through to about k times the ratio of the rounds, whatever the table's size.
    """
    import pyarrow as pa

    kind = "<f4" if isinstance(rows.schema[vec].dataType.elementType, T.FloatType) else "<f8"
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    sizes = {r.d: r.n for r in src.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = "query_id long, vec_id long, score double"
    spark = rows.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = min(sizes, key=lambda d: (-sizes[d], d))
    n = sizes[dims]
    src = src.where(F.size("vec") == dims)
    book = fit(src, n, dims, p, k)
    lists = len(book.centroids)
    index = cut(build_index(src, book, kind, p))
    queries = src.where("is_query").select("vec_id", "vec")
    n_queries = queries.count()
    repeated = _repeated_ids(src)
    edges = [0, *(max(1, round(f * lists)) for f in p.rounds), max(1, round(book.probe * lists))]
    bounds = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]

    def probes(lo: int, hi: int):
        def f(batches):
            for b in batches:
                q = np.array(b.column(1).to_pylist(), "f8").reshape(-1, dims)
                order = np.argsort(-(q @ book.centroids.T), axis=1, kind="stable")[:, lo:hi]
                at = np.repeat(np.arange(len(q)), order.shape[1])
                raw = pa.array(list(map(bytes, q.astype(kind))), pa.binary())
                for a in range(0, len(at), 10_000):
                    i = pa.array(at[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(i), raw.take(i), b.column(2).take(i), pa.array(order.ravel()[a : a + 10_000], pa.int32())], ["query_id", "raw", "tau", "list"])

        return f

    def pack(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1)
        return pa.table({"list": one["list"], "q_ids": pa.array([t["query_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "q_raw": pa.array([b"".join(t["raw"].to_pylist())], pa.binary()), "q_tau": pa.array([t["tau"].to_numpy().astype("<f8").tobytes()], pa.binary())})

    def scan(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_raw, q_tau, ids, cols, raw = (b.column(j)[i].as_py() for j in range(6))
                cand = np.frombuffer(ids, "<i8")
                qid = np.frombuffer(q_ids, "<i8")
                qi, ci, score = scan_block(
                    qid, np.frombuffer(q_raw, kind).reshape(-1, dims).astype("f8"), cand, [np.frombuffer(c, "<f8").reshape(len(cand), -1) for c in cols],
                    np.frombuffer(raw, kind).reshape(-1, dims).astype("f8"), np.frombuffer(q_tau, "<f8"), book.rotation, p, k, repeated,
                )
                yield pa.RecordBatch.from_arrays([pa.array(qid[qi], pa.int64()), pa.array(cand[ci], pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def step(state: DataFrame | None, queries: DataFrame, n_queries: int, lo: int, hi: int) -> DataFrame:
        """The state after the lists from rank lo to hi of each query."""
        tau = F.lit(float("-inf")).alias("tau")
        if state is not None:
            kth = state.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            todo = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "vec", F.coalesce("kth", F.lit(float("-inf"))).alias("tau"))
        else:
            todo = queries.select("vec_id", "vec", tau)
        groups = max(1, -(-n_queries * (hi - lo) // (lists * p.group)))
        asked = todo.mapInArrow(probes(lo, hi), "query_id long, raw binary, tau double, list int")
        packed = asked.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("slot")).applyInArrow(pack, "list int, q_ids binary, q_raw binary, q_tau binary")
        met = packed.join(index, "list").select("q_ids", "q_raw", "q_tau", "ids", "cols", "raw")
        found = met.mapInArrow(scan, out)
        if state is not None:
            found = found.unionByName(state)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if repeated else found
        return cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    state = None
    for lo, hi in bounds:
        state = step(state, queries, n_queries, lo, hi)
    if edges[-1] < lists:  # queries that have met fewer than k candidates scan the rest, too
        full = state.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = cut(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti"))
        if n_short := short.count():
            state = step(state, short, n_short, edges[-1], lists)
    return state.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def _repeated_ids(src: DataFrame) -> bool:
    """Whether an id stands in several rows; then a neighbour could be found twice."""
    return src.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
