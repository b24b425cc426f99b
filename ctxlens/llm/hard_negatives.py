"""Hard negatives for contrastive training, by k-means inverted lists with radii (operator 11).

A vector x of a list with centroid c and radius r has a score with an anchor a within a.c - |a| r and a.c + |a| r (Cauchy-Schwarz). An anchor
visits lists in the order of their upper bounds; a list whose bounds lie outside the window of wanted scores is skipped, and the visit
stops where the upper bound falls strictly below the k-th score found. As a Spark job does many anchors at once, the visit goes in rounds of growing
shares of the lists, and the k-th scores are renewed between rounds. Results are exact: bounds only skip what can't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Entries of the matrix of distances to centroids that are held at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Params:
    """positives, negatives: wanted per anchor, and per anchor and positive. low, high: percent of the positive's score that a negative's may have.

    scale: components become floor(scale * x). sample: rows that the centroids are fitted on (the bound; all rows are indexed with true radii).
    rounds: shares of the lists, in a round's order, after which k-th scores are renewed. block, group: rows of an index block, anchors met with it at once.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample: int = 16_384
    max_lists: int = 4096
    rounds: tuple[float, ...] = (1 / 32, 1 / 4)
    block: int = 2048
    group: int = 512
    seed: int = 11


@dataclass(frozen=True)
class Lists:
    """Centroids, the largest distance of a member to its centroid (stored with a slack for rounding), and the number of members."""

    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the scores of each anchor with each list's members."""
        a = anchors.astype("f8")
        middle, reach = a @ self.centroids.T, np.sqrt((a * a).sum(1))[:, None] * self.radii[None, :]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long; null where the vector is null or empty, a component null or not finite, or a product leaves the longs."""
    x = vec.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < 2.0**62))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def dots(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers; raises if one doesn't fit a long."""
    if not len(a) or not len(x):
        return np.zeros((len(a), len(x)), "i8")
    most = int(np.abs(a).max()) * int(np.abs(x).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype("f8") @ x.astype("f8").T).astype("i8")
    if most > _LONG_MAX:
        s = a.astype(object) @ x.astype(object).T
        if not all(_LONG_MIN <= v <= _LONG_MAX for v in s.ravel()):
            raise OverflowError("a score doesn't fit a long")
        return s.astype("i8")
    return a @ x.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid; CELLS distances are held at a time, so that neither driver nor task holds a matrix of all."""
    half, step = 0.5 * (c * c).sum(1), max(1, CELLS // len(c))
    return np.concatenate([np.zeros(0, int), *(np.argmax(x[at : at + step] @ c.T - half, axis=1) for at in range(0, len(x), step))])


def k_means(rows: DataFrame, n: int, dims: int, p: Params) -> np.ndarray:
    """Centroids from at most 2 * p.sample rows, the least by a hash of id and vector."""
    key = F.xxhash64("id", "vec", F.lit(p.seed))
    picked = rows.where(F.pmod(key, F.lit(max(1, n // p.sample))) == 0).select(key.alias("key"), "id", "vec").orderBy("key", "id").limit(2 * p.sample).toArrow()
    x = picked.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)
    distinct = np.unique(x, axis=0)
    lists = int(min(p.max_lists, len(distinct), max(1, round(n**0.5))))
    if not lists:
        return np.zeros((1, dims))
    c = distinct[np.random.default_rng(p.seed).choice(len(distinct), lists, replace=False)]
    for _ in range(8):
        near = nearest(x, c)
        total, count = np.zeros_like(c), np.bincount(near, minlength=lists)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def build_index(rows: DataFrame, centroids: np.ndarray, p: Params) -> tuple[DataFrame, Lists]:
    """(list, block, ids, labels, vecs): packed blocks of about p.block rows; and the lists with their radii, at most p.max_lists rows."""
    import pyarrow as pa

    dims = centroids.shape[1]

    def place(batches):
        for b in batches:
            x = np.array(b.column(2).to_pylist(), "i8").reshape(-1, dims)
            f = x.astype("f8")
            near = nearest(f, centroids)
            far = np.sqrt(((f - centroids[near]) ** 2).sum(1))
            raw = pa.array(list(map(thin, x)), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, pa.array(near.astype("i4")), pa.array(far)], ["id", "label", "raw", "list", "far"])

    placed = cut(rows.select("id", "label", "vec").mapInArrow(place, "id long, label long, raw binary, list int, far double"))
    stats = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), "i8")
    for r in stats:
        radii[r.list], sizes[r.list] = r.radius * (1 + 1e-9), r.n
    blocks = F.element_at(F.lit(np.maximum(1, -(-sizes // p.block)).tolist()), F.col("list") + 1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(p.seed)), blocks).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = unpack(t["raw"].to_pylist(), dims)
        one = t.slice(0, 1)
        made = [t["id"].to_numpy().astype("<i8").tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), thin(x)]
        return pa.table({"list": one["list"], "block": one["block"], **{n: pa.array([v], pa.binary()) for n, v in zip(("ids", "labels", "vecs"), made, strict=True)}})

    index = dealt.groupBy("list", "block").applyInArrow(pack, "list int, block int, ids binary, labels binary, vecs binary")
    return cut(index), Lists(centroids, radii, sizes)


def thin(x: np.ndarray) -> bytes:
    return x.astype("<i4" if not x.size or np.abs(x).max() < 1 << 31 else "<i8").tobytes()


def unpack(raw: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(v, "<i4" if len(v) == 4 * dims else "<i8") for v in raw], "i8").reshape(-1, dims)


def unthin(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * dims * n else "<i8").reshape(n, dims).astype("i8")


def first_of(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k first by score descending, ties to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


#: Arrays with one element per slot of an anchor: the window, and the k-th score found so far with its id.
SLOTS = ("los", "his", "floors", "floor_ids")


def visit(wants: DataFrame, index: DataFrame, lists: Lists, k: int, same: bool, p: Params) -> DataFrame:
    """(anchor_id, slot, id, score): of each want the k first rows with the anchor's label (``same``) or another, scores within lo and hi.

    wants: (anchor_id, label, raw, los, his), one row per anchor, materialised; los and his hold the windows of its slots. An anchor
    itself is never found.
    """
    import pyarrow as pa

    dims, n_lists = lists.centroids.shape[1], len(lists.centroids)
    blocks = np.maximum(1, -(-lists.sizes // p.block))
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    edges = [0, *(max(1, round(f * n_lists)) for f in p.rounds), n_lists]
    parts = max(1, -(-wants.count() // p.group))
    asked_names = ["list", "block", "anchor_id", "label", "raw", *SLOTS]

    def asks(lo_rank: int, hi_rank: int):
        """A row for each anchor and block that it has to visit in this round."""

        def f(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    low, high = lists.bounds(unpack(part.column(2).to_pylist(), dims))
                    order = np.argsort(-high, axis=1, kind="stable")[:, lo_rank:hi_rank]
                    for i, (los, his, floors) in enumerate(zip(*(part.column(j).to_pylist() for j in (3, 4, 5)), strict=True)):
                        to = order[i]
                        need = np.zeros(len(to), bool)
                        for lo, hi, floor in zip(los, his, floors, strict=True):
                            need |= (lo <= hi) & (high[i, to] >= max(lo, floor)) & (low[i, to] <= hi)
                        to = to[need & (lists.sizes[to] > 0)]
                        times = blocks[to]
                        block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        to = np.repeat(to, times)
                        for a in range(0, len(to), 10_000):
                            n = min(10_000, len(to) - a)
                            same_row = pa.array(np.full(n, i))
                            yield pa.RecordBatch.from_arrays([pa.array(to[a : a + n].astype("i4")), pa.array(block[a : a + n].astype("i4")), *(part.column(j).take(same_row) for j in range(7))], asked_names)

        return f

    ask_schema = "list int, block int, anchor_id long, label long, raw binary, " + ", ".join(f"{n} array<long>" for n in SLOTS)
    pack_schema = "list int, block int, anchor_id binary, label binary, raw binary, " + ", ".join(f"{n} binary" for n in SLOTS)

    def pack(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1)
        made = {n: np.array(t[n].to_pylist(), "<i8").tobytes() for n in ("anchor_id", "label", *SLOTS)} | {"raw": thin(unpack(t["raw"].to_pylist(), dims))}
        return pa.table({n: one[n] if n in ("list", "block") else pa.array([made[n]], pa.binary()) for n in asked_names})

    def scan(batches):
        for b in batches:
            for row in range(b.num_rows):
                a_ids, a_labels, raw, los, his, floors, floor_ids, ids, labels, vecs = (b.column(j)[row].as_py() for j in range(10))
                a_ids, a_labels, ids, labels = (np.frombuffer(v, "<i8") for v in (a_ids, a_labels, ids, labels))
                los, his, floors, floor_ids = (np.frombuffer(v, "<i8").reshape(len(a_ids), -1) for v in (los, his, floors, floor_ids))
                score = dots(unthin(raw, len(a_ids), dims), unthin(vecs, len(ids), dims))
                fits = ((labels[None, :] == a_labels[:, None]) == same) & (ids[None, :] != a_ids[:, None])
                for slot in range(los.shape[1]):
                    low = np.maximum(los[:, slot], floors[:, slot])
                    r, c = np.nonzero(fits & (score >= low[:, None]) & (score <= his[:, slot, None]))
                    on = (score[r, c] > floors[r, slot]) | (ids[c] <= floor_ids[r, slot])  # beyond the k-th found so far
                    r, c = r[on], c[on]
                    at = first_of(r, score[r, c], ids[c], k)
                    r, c = r[at], c[at]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(a_ids[r]), pa.array(np.full(len(r), slot, "i4")), pa.array(ids[c]), pa.array(score[r, c])], ["anchor_id", "slot", "id", "score"])

    found: DataFrame | None = None
    for lo_rank, hi_rank in zip(edges, edges[1:]):
        if lo_rank >= hi_rank:
            continue
        if found is None:
            todo = wants.select("*", F.transform("los", lambda _: F.lit(_LONG_MIN)).alias("floors"), F.transform("los", lambda _: F.lit(_LONG_MAX)).alias("floor_ids"))
        else:
            last = found.groupBy("anchor_id", "slot").agg(F.min(F.struct("score", (-F.col("id")).alias("back"))).alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            last = last.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))  # as many as an anchor has slots
            kth = lambda field, other: F.transform("los", lambda _, i: F.coalesce(F.try_element_at("kths", i)[field], F.lit(other)))
            todo = wants.join(last, "anchor_id", "left").select(*wants.columns, kth("score", _LONG_MIN).alias("floors"), F.transform(kth("back", _LONG_MIN + 1), lambda v: -v).alias("floor_ids"))
        asked = todo.mapInArrow(asks(lo_rank, hi_rank), ask_schema)
        packed = asked.groupBy("list", "block", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part")).applyInArrow(pack, pack_schema)
        # by merge: Spark takes a packed vector for a small value, and would send the index or the asks through the driver as a broadcast
        met = packed.join(index.hint("merge"), ["list", "block"]).select("anchor_id", "label", "raw", *SLOTS, "ids", "labels", "vecs")
        new = met.mapInArrow(scan, "anchor_id long, slot int, id long, score long")
        new = new if found is None else new.unionByName(found)
        found = cut(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    return found


def mine(rows: DataFrame, is_anchor: Column, p: Params = Params(), vec_id: str = "vec_id", vec: str = "embedding", label: Column | str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row takes no part if its id, label, vector or a component is null or not finite, or if its vector's length isn't the table's most frequent.
    Positives are an anchor's first p.positives other rows of its label, by score, ties to the smaller id; a positive's negatives the first
    p.negatives rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. An id that stands in
    several rows is one row, that with the least (label, vector). Extra columns are ignored; an empty table gives no rows. Scores are exact integers.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    src = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), whole_numbers(F.col(vec), p.scale).alias("vec"), is_anchor.alias("anchor")).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = {r.d: r.n for r in src.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return empty
    dims = min(sizes, key=lambda d: (-sizes[d], d))
    src = src.where(F.size("vec") == dims)
    if src.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        src = src.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("r")).select("id", "r.*")
    index, lists = build_index(src, k_means(src, sizes[dims], dims, p), p)

    def anchors(batches):
        import pyarrow as pa

        for b in batches:
            raw = [thin(np.array(v, "i8")) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["anchor_id", "label", "raw"])

    asked = cut(src.where("anchor").select("id", "label", "vec").mapInArrow(anchors, "anchor_id long, label long, raw binary"))
    everything = [F.array(F.lit(v)).alias(n) for n, v in (("los", _LONG_MIN), ("his", _LONG_MAX))]
    positives = visit(asked.select("*", *everything), index, lists, p.positives, True, p)
    ranked = positives.select("anchor_id", "id", "score", (F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")) - 1).alias("slot"))
    low, high = (F.expr(f"CAST({way}(CAST(score AS DECIMAL(20, 0)) * CAST({percent} AS DECIMAL(3, 0)) / CAST(100 AS DECIMAL(3, 0))) AS BIGINT)") for way, percent in (("ceil", p.low), ("floor", p.high)))
    ranked = cut(ranked.select("*", low.alias("lo"), high.alias("hi")))
    windows = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))  # at most p.positives
    wants = cut(asked.join(windows, "anchor_id").select("anchor_id", "label", "raw", F.col("w.lo").alias("los"), F.col("w.hi").alias("his")))
    # pad to the same number of slots; an empty window (lo > hi) finds nothing
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(p.positives) - F.size(c)))
    wants = wants.select("anchor_id", "label", "raw", pad("los", 1).alias("los"), pad("his", 0).alias("his"))
    negatives = visit(wants, index, lists, p.negatives, False, p)
    out = negatives.select("anchor_id", "slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(ranked.select("anchor_id", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "slot"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id"))
    return out.select("anchor_id", "positive_id", rank.alias("rank"), "negative_id", "positive_score", "negative_score")
