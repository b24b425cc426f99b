"""A persisted index of vectors: inverted lists with their widest angles, searched by cosine, exactly or in part, and added to.

Vectors lie in packed blocks of one list each, as Parquet under ``folder``; lists (at most ``max_lists``) have a centroid, the widest angle of a
member to it, and a number of members. A member of a list at angle t from a query with the widest angle w has a cosine of at most cos(t - w), so
lists whose bound is below the k-th cosine so far (or below a floor) can't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle


@dataclass(frozen=True)
class Shape:
    """sample: vectors that centroids are fitted on (the bound; all are indexed). rounds: shares of the lists after which k-th cosines are renewed.

    block, group: vectors of a block, and queries that meet it at once; parts: tasks that a long list is dealt to, at most.
    """

    sample: int = 16_384
    max_lists: int = 1024
    block: int = 2048
    group: int = 512
    parts: int = 64
    rounds: tuple[float, ...] = (1 / 16, 1 / 4)
    seed: int = 5


def usable(c: str):
    """A vector that isn't null or empty and holds finite numbers only."""
    x = F.col(c).cast("array<double>")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((x * x).sum(1))
    return np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0), n


def _rows(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)


def _bounds(centroids: np.ndarray, widths: np.ndarray, q: np.ndarray) -> np.ndarray:
    u, norms = _unit(q)
    t = np.arccos(np.clip(u @ centroids.T, -1, 1))
    return np.where((norms > 0)[:, None], np.cos(np.maximum(0, t - widths[None, :])) + 1e-9, 1.0)


class VectorIndex:
    """An index under a folder; ``build`` makes one, ``add`` puts more vectors into it, ``search`` and ``above`` ask it."""

    def __init__(self, spark: SparkSession, folder: str, shape: Shape = Shape()):
        self.spark, self.folder, self.shape = spark, folder.rstrip("/"), shape
        lists = spark.read.parquet(f"{self.folder}/lists").groupBy("list").agg(F.max("centroid").alias("centroid"), F.max("width").alias("width"), F.sum("n").alias("n")).orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in lists], "f8")
        self.widths, self.sizes = np.array([r.width for r in lists]), np.array([r.n for r in lists])

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def build(cls, rows: DataFrame, folder: str, row_id: str, vector: str = "embedding", tag: str | None = None, shape: Shape = Shape()) -> VectorIndex:
        """Indexes rows (id, vector, tag: what searches may filter by, a person, say). Vectors of another length than the most frequent aren't met."""
        spark = rows.sparkSession
        src = rows.where(usable(vector) & F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        sizes = {r.d: r.n for r in src.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        dims = min(sizes, key=lambda d: (-sizes[d], d)) if sizes else 1
        n = sizes.get(dims, 0)
        key = F.xxhash64("id", F.lit(shape.seed))
        picked = src.where((F.size("vec") == dims) & (F.pmod(key, F.lit(max(1, n // shape.sample))) == 0)).orderBy(key, "id").limit(2 * shape.sample).collect()
        u = np.unique(_unit(np.array([r.vec for r in picked], "f8").reshape(-1, dims))[0], axis=0)
        u = u[(u != 0).any(axis=1)]
        c = u[np.random.default_rng(shape.seed).choice(len(u), min(len(u), shape.max_lists, max(1, round(n**0.5 / 2))), replace=False)] if len(u) else np.eye(1, dims)
        for _ in range(6 if len(u) else 0):
            near = np.argmax(u @ c.T, axis=1)
            total = np.zeros_like(c)
            np.add.at(total, near, u)
            c = np.where((np.bincount(near, minlength=len(c)) > 0)[:, None], _unit(total)[0], c)
        made = [(i, x.tolist(), 0.0, 0) for i, x in enumerate(c)]
        spark.createDataFrame(made, "list int, centroid array<double>, width double, n long").coalesce(1).write.parquet(f"{folder}/lists/version=0")
        index = cls(spark, folder, shape)
        index.add(rows, row_id, vector, tag, version=1)
        return index

    def add(self, rows: DataFrame, row_id: str, vector: str = "embedding", tag: str | None = None, version: int | None = None) -> None:
        """Adds rows as one version; adding a version again replaces it, so a repeated call does no harm. Ids aren't checked for being new."""
        import pyarrow as pa

        if version is None:
            version = 1 + (self.spark.read.parquet(f"{self.folder}/lists").agg(F.max("version")).first()[0] or 0)
        centroids, dims, shape = self.centroids, self.dims, self.shape
        src = rows.where(usable(vector) & (F.size(vector) == dims) & F.col(row_id).isNotNull())
        src = src.select(F.col(row_id).cast("string").alias("id"), (F.lit(None) if tag is None else F.col(tag)).cast("string").alias("tag"), F.col(vector).cast("array<double>").alias("vec"))

        def place(batches):
            for b in batches:
                u, norms = _unit(_rows(b.column(2), dims))
                cos = u @ centroids.T
                near = np.argmax(cos, axis=1)
                angle = np.where(norms > 0, np.arccos(np.clip(cos[np.arange(len(u)), near], -1, 1)), np.pi)  # a zero vector may be at any angle
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype("i4")), pa.array(angle)], ["id", "tag", "vec", "list", "angle"])

        placed = settle(src.mapInArrow(place, "id string, tag string, vec array<double>, list int, angle double"))
        lists = placed.groupBy("list").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("n")).select("list", F.lit(None).cast("array<double>").alias("centroid"), (F.col("width") + 1e-7).alias("width"), "n")
        # wider angles without their vectors are harmless, so lists go first
        lists.write.mode("overwrite").parquet(f"{self.folder}/lists/version={version}")
        counts = {r.list: r.n for r in lists.collect()}  # at most max_lists
        blocks = F.element_at(F.lit([max(1, -(-counts.get(i, 0) // shape.block)) for i in range(len(centroids))]), F.col("list") + 1)

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            one = t.slice(0, 1)
            column = lambda n: pa.array([t[n].to_pylist()], pa.list_(pa.string()))
            return pa.table({"list": one["list"], "block": one["block"], "ids": column("id"), "tags": column("tag"), "vecs": pa.array([_rows(t["vec"].combine_chunks(), dims).tobytes()], pa.binary())})

        dealt = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(shape.seed)), blocks).cast("int"))
        packed = dealt.select("id", "tag", "vec", "list", "block").groupBy("list", "block").applyInArrow(pack, "list int, block int, ids array<string>, tags array<string>, vecs binary")
        packed.write.mode("overwrite").parquet(f"{self.folder}/blocks/version={version}")
        self.__init__(self.spark, self.folder, shape)

    def _parts(self) -> np.ndarray:
        return np.clip(self.sizes // (8 * self.shape.block), 1, self.shape.parts)

    def blocks(self) -> DataFrame:
        """(list, part, ids, tags, vecs): a long list is dealt over several parts."""
        parts = F.element_at(F.lit(self._parts().tolist()), F.col("list") + 1)
        stored = self.spark.read.parquet(f"{self.folder}/blocks")
        return stored.select("list", F.pmod(F.xxhash64("version", "block"), parts).cast("int").alias("part"), "ids", "tags", "vecs")

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest cosine that a member of each list can have with each query."""
        return _bounds(self.centroids, self.widths, q)

    def _asks(self, queries: DataFrame, lo: int, hi: int) -> DataFrame:
        """(list, part, query_id, tag, query, floor): the lists that a query has to see among its lo-th to hi-th by bound."""
        import pyarrow as pa

        centroids, widths, sizes, parts, dims = self.centroids, self.widths, self.sizes, self._parts(), self.dims

        def f(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    p = b.slice(at, 256)
                    bound = _bounds(centroids, widths, _rows(p.column(2), dims))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
                    floor = p.column(3).to_numpy(zero_copy_only=False)
                    need = (np.take_along_axis(bound, order, 1) >= floor[:, None]) & (sizes[order] > 0)
                    i, j = np.nonzero(need)
                    to = order[i, j]
                    times = parts[to]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    i, to = np.repeat(i, times), np.repeat(to, times)
                    for a in range(0, len(i), 4096):
                        rows = pa.array(i[a : a + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 4096].astype("i4")), pa.array(part[a : a + 4096].astype("i4")), *(c.take(rows) for c in p.columns)], ["list", "part", "query_id", "tag", "query", "floor"])

        return queries.select("query_id", "tag", "query", "floor").mapInArrow(f, "list int, part int, query_id string, tag string, query array<double>, floor double")

    def _met(self, asked: DataFrame, k: int | None, so_far: bool = False) -> DataFrame:
        """(query_id, id, tag, cosine) of asks (packed by list) with the blocks of their lists: not below the floor, k for each block at most.

        ``so_far``: nor below a query's k-th best of all the blocks that its task has met.
        """
        import pyarrow as pa

        dims = self.dims

        def scan(batches):
            tops: dict = {}  # a query's k best so far
            for b in batches:
                for r in range(b.num_rows):
                    q_ids, q_tags, floors, q, ids, tags, vecs = (b.column(c)[r].values if c in (0, 1, 2, 4, 5) else b.column(c)[r].as_py() for c in range(7))
                    q, x = np.frombuffer(q, "f8").reshape(-1, dims), np.frombuffer(vecs, "f8").reshape(-1, dims)
                    mag = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
                    cos = np.round(np.divide(q @ x.T, mag, out=np.zeros_like(mag), where=mag > 0), 12)
                    on = cos >= floors.to_numpy(zero_copy_only=False)[:, None]
                    if q_tags.null_count < len(q_tags):
                        mine, theirs = np.array(q_tags.to_pylist(), object), np.array(tags.to_pylist(), object)
                        on &= np.equal(mine, None)[:, None] | (mine[:, None] == theirs[None, :])
                    if k is not None and so_far:
                        names, none = q_ids.to_pylist(), np.full(k, -2.0)
                        far = np.hstack([np.array([tops.get(n, none) for n in names]), np.where(on, cos, -2.0)])
                        best = np.partition(far, far.shape[1] - k, axis=1)[:, -k:]
                        on &= cos >= best.min(axis=1)[:, None]
                        if len(tops) > 1 << 16:  # only lets more through
                            tops.clear()
                        tops.update(zip(names, best, strict=True))
                    elif k is not None and cos.shape[1] > k:
                        far = np.where(on, cos, -2.0)
                        on &= cos >= np.partition(far, cos.shape[1] - k, axis=1)[:, -k, None]
                    i, j = np.nonzero(on)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(pa.array(j)), tags.take(pa.array(j)), pa.array(cos[i, j])], ["query_id", "id", "tag", "cosine"])

        # by merge: packed vectors look like small values, and would go through the driver as a broadcast
        met = asked.join(self.blocks().withColumnRenamed("tags", "of_row").hint("merge"), ["list", "part"]).select("query_ids", "tags", "floors", "queries", "ids", "of_row", "vecs")
        return met.mapInArrow(scan, "query_id string, id string, tag string, cosine double")

    def tags(self) -> DataFrame:
        """The distinct tags (tag) of the vectors."""
        return self.spark.read.parquet(f"{self.folder}/blocks").select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").distinct()

    def above(self, queries: DataFrame, floor: float, k: int | None = None) -> DataFrame:
        """(query_id, id, tag, cosine) of all vectors whose cosine is at least ``floor``; with ``k``, at least of those that can be among a query's k nearest.

        Works on streams: the queries of a task go to each list that can hold such a vector as one matrix, without a shuffle before.
        """
        import pyarrow as pa

        q = queries.where(usable("query") & (F.size("query") == self.dims)).select(F.col("query_id").cast("string").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
        centroids, widths, sizes, parts, dims, group = self.centroids, self.widths, self.sizes, self._parts(), self.dims, self.shape.group

        def asks(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    p = b.slice(lo, 2048)
                    raw = _rows(p.column(1), dims)
                    need = (_bounds(centroids, widths, raw) >= floor) & (sizes > 0)
                    for to in np.flatnonzero(need.any(axis=0)).tolist():
                        at = np.flatnonzero(need[:, to])
                        for a in range(0, len(at), group):
                            some = at[a : a + group]
                            listed = [pa.array([v], pa.list_(t)) for v, t in ((p.column(0).take(pa.array(some)).to_pylist(), pa.string()), ([None] * len(some), pa.string()), ([floor] * len(some), pa.float64()))]
                            for part in range(parts[to]):
                                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([part], pa.int32()), *listed, pa.array([raw[some].tobytes()], pa.binary())], ["list", "part", "query_ids", "tags", "floors", "queries"])

        asked = q.mapInArrow(asks, "list int, part int, query_ids array<string>, tags array<string>, floors array<double>, queries binary")
        return self._met(asked, k, so_far=True)

    def search(self, queries: DataFrame, k: int, probe: float | None = None, tag: str | None = None) -> DataFrame:
        """query_id, id (as strings), tag, cosine (to twelve digits), rank of each query's k nearest, ties to the shorter, then smaller id (whole
        numbers in their order).

        ``probe``: the share of the lists that is seen, by bound; None: as many as it takes for exact results. ``tag``: column of the
        queries; a query that has one meets only rows with that tag. Unusable queries have no rows.
        """
        import pyarrow as pa

        q = queries.where(usable("query") & (F.size("query") == self.dims)).select(F.col("query_id").cast("string").alias("query_id"), (F.lit(None) if tag is None else F.col(tag)).cast("string").alias("tag"), F.col("query").cast("array<double>").alias("query"))
        q = settle(q)
        n_lists, n_queries = len(self.centroids), q.count()
        edges = [0, *(max(1, round(f * n_lists)) for f in self.shape.rounds), n_lists] if probe is None else [0, max(1, round(probe * n_lists))]
        best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.length("id"), "id")
        groups = max(1, -(-n_queries // self.shape.group))

        def pack(t: pa.Table) -> pa.Table:
            one = t.slice(0, 1)
            column = lambda n, kind: pa.array([t[n].to_pylist()], pa.list_(kind))
            raw = np.array(t["query"].to_pylist(), "f8").tobytes()
            return pa.table({"list": one["list"], "part": one["part"], "query_ids": column("query_id", pa.string()), "tags": column("tag", pa.string()), "floors": column("floor", pa.float64()), "queries": pa.array([raw], pa.binary())})

        found: DataFrame | None = None
        for lo, hi in zip(edges, edges[1:]):
            if lo >= hi:
                continue
            if found is None:
                todo = q.withColumn("floor", F.lit(-2.0))
            else:
                kth = found.groupBy("query_id").agg(F.min("cosine").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "floor")
                todo = q.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
            asked = self._asks(todo, lo, hi).groupBy("list", "part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("slot")).applyInArrow(pack, "list int, part int, query_ids array<string>, tags array<string>, floors array<double>, queries binary")
            new = self._met(asked, k)
            new = new if found is None else new.unionByName(found.drop("rank"))
            found = settle(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        return found
