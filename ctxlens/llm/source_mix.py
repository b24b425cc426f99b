"""Mixing sources to target weights along a curriculum (operator 4).

Each source has a weight schedule over training time t in [0, 1], linear between knots. Its integral,
scaled to the source's target, is the source's cumulative demand D(t) in words. A source's documents
stand in a fixed random order and fill its demand one after the other (and again, in a second pass);
inverting D at a document's first word gives the time, and the demand of all sources at that time
is its training position. In a second pass that word stands one source size later in the demand.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, small, split_join, word_count

#: Weights by rank of the source, repeating (fixed values of the query).
WEIGHTS = (3, 1, 2)
#: Schedules by rank, repeating: knots (time, relative weight).
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (0.25, 0.5), (0.75, 1.5), (1.0, 1.0)),
)


def demand_knots(target: float, schedule) -> tuple[tuple[float, float, float], ...]:
    """(time, demand so far, demand rate) at each knot of a schedule."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for i, (t, w) in enumerate(schedule):
        if i:
            t0, w0 = schedule[i - 1]
            done += (t - t0) * (w0 + w) / 2
        out.append((t, target * done / area, target * w / area))
    return tuple(out)


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def water_fill(sources: DataFrame, weights, share: Fraction, most: int) -> DataFrame:
    """Adds rank and target to sources (source, source_size): in proportion to the weights (by rank, repeating), summing to
    share * all sizes, none above most * size.

    What a full source can't take goes to the others by weight, until none is above. Sources fill up in the order of
    (most * size / weight): with the sums of those before, the level that the rest would share is known at each, and a source is
    full if its own size is below it. Three running windows over one row for each source, which hold no rows.
    """
    whole = "decimal(38,0)"
    order = F.col("source").asc_nulls_last()  # UTF-8 orders as code points do
    df = sources.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    df = df.withColumns({"w": w, "cap": (F.col("source_size") * most).cast("decimal(20,0)")})
    df = df.withColumn("fills", F.col("cap") * (F.lit(lcm(*weights)) / F.col("w")).cast("int"))
    by = Window.orderBy("fills", "rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.col("fills").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(whole), "weight": F.sum("w").over(after)})
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("decimal(20,0)").alias("total"))
    df = df.join(F.broadcast(total))  # one row
    left = F.col("total") * share.numerator - F.col("filled") * share.denominator  # times the denominator
    df = df.withColumns({"left": left.cast(whole)})
    full = F.col("cap").cast("double") * F.col("weight") * share.denominator <= F.col("left").cast("double") * F.col("w")
    df = df.withColumns({"full": full, "level": F.col("left").cast("double") / (F.col("weight") * share.denominator)})
    level = df.where("NOT full").agg(F.min_by("level", F.struct("fills", "rank")).alias("shared"))
    df = df.join(F.broadcast(level))  # one row
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("w"))
    return df.select(*sources.columns, "rank", target.alias("target"))


def plan_sources(sized: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=Fraction(3, 2), most: int = 2) -> DataFrame:
    """One row per source, by code point, null last: key, source, rows, source_size, rank, target, shape (of its schedule)."""
    totals = cut(sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")))
    return water_fill(totals, weights, share, most).withColumns({"key": _key(F.col("source")), "shape": (F.col("rank") % len(schedules)).cast("int")})


def knots_of(shape: Column, target: Column, schedules) -> Column:
    """A source's demand curve: its schedule's, for a target of 1, times its target."""
    unit = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(w).alias("w")) for t, d, w in demand_knots(1.0, s)]) for s in schedules]
    return F.transform(F.element_at(F.array(*unit), shape + 1), lambda k: F.struct(k["t"].alias("t"), (k["d"] * target).alias("d"), (k["w"] * target).alias("w")))


def _segments(knots: Column) -> Column:
    return F.zip_with(knots, F.slice(knots, F.lit(2), F.size(knots) - 1), lambda a, b: F.when(b.isNotNull(), F.struct(a["t"].alias("t0"), b["t"].alias("t1"), a["d"].alias("d0"), b["d"].alias("d1"), a["w"].alias("w0"), b["w"].alias("w1"))))


def _time_at(knots: Column, x: Column) -> Column:
    """Inverse of the demand: the time at which the demand reaches x (quadratic within a segment)."""
    seg = F.element_at(F.filter(_segments(knots), lambda s: s.isNotNull() & (s["d1"] >= x)), 1)
    slope = (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
    y = x - seg["d0"]
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * slope * y, F.lit(0.0)))
    return F.coalesce(F.when(y <= 0, seg["t0"]).otherwise(F.least(seg["t1"], seg["t0"] + 2 * y / (seg["w0"] + root))), F.lit(1.0))


def _demand_at(knots: list[tuple[float, float, float]], t: Column) -> Column:
    """Demand of a fixed curve at time t."""
    out = F.lit(knots[-1][1])
    for (t0, d0, w0), (t1, _, w1) in reversed(list(zip(knots, knots[1:]))):
        dt = t - F.lit(t0)
        out = F.when(t < t1, F.lit(d0) + w0 * dt + F.lit((w1 - w0) / (t1 - t0) / 2) * dt * dt).otherwise(out)
    return out


def total_curve(by_shape: dict[int, float], schedules) -> list[tuple[float, float, float]]:
    """Demand of all sources together, at the union of their knots: the schedules' curves times the sums of their targets."""
    curves = [demand_knots(by_shape.get(i, 0.0), s) for i, s in enumerate(schedules)]

    def at(knots, t: float) -> tuple[float, float]:
        for (t0, d0, w0), (t1, _, w1) in zip(knots, knots[1:]):
            if t <= t1:
                k = (w1 - w0) / (t1 - t0)
                return d0 + w0 * (t - t0) + k * (t - t0) ** 2 / 2, w0 + k * (t - t0)
        return knots[-1][1:]

    times = sorted({k[0] for c in curves for k in c})
    return [(t, sum(at(c, t)[0] for c in curves), sum(at(c, t)[1] for c in curves)) for t in times]


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=Fraction(3, 2), most: int = 2, seed: int = 17, bucket_rows: int = 2000, text: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document, by position: doc_id, source, size, source_size, target, taken, first_taken, position, again_position.

    taken: words that the mix takes of the document, over both passes (the document at the end of a
    source's demand is taken in part); first_taken: in the first pass; position: of its first word in
    training, null if nothing is taken; again_position: likewise in the second pass. Every source's taken words are its
    target, rounded down.

    Scale: the running sums per source are two-level. A document's place in its source is a hash;
    the top of the hash is a bucket of about ``bucket_rows`` documents, sums of (source, bucket) are summed
    along each source, and windows run inside (source, bucket) only, so a source with a third of all
    rows is spread over as many tasks; the join to its plan is split likewise. Sources stay a table; one sum for each schedule
    comes to the driver. Null text: size 0; null source: the last source; rows with the same doc_id and text are
    interchangeable; texts of any length count whole; extra columns are ignored. The output is range-partitioned and sorted by
    position; ``with_key`` adds ``h``, the hash of (doc_id, text) that orders a source, and ``row``, a hash of all columns.
    """
    doc = F.col("doc_id").cast("long")
    sized = docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), doc, F.col(text)).alias("h"), *[row_hash(docs).alias("row")] * with_key)
    sized = cut(sized)
    sources = cut(plan_sources(sized, weights, schedules, share, most))
    by_shape = {r["shape"]: r["n"] for r in sources.groupBy("shape").agg(F.sum("target").alias("n")).collect()}  # a row for each schedule
    n_rows = sized.count()
    buckets = 1 << max(6, min(30, (n_rows // bucket_rows).bit_length()))
    bucket = F.shiftrightunsigned("h", 64 - (buckets.bit_length() - 1)).cast("int")
    sized = sized.withColumn("bucket", bucket)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *["row"] * with_key).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["s"]) & (placed["bucket"] == sums["b"])).withColumn("start", F.col("start") + F.col("before"))

    df = split_join(placed.select(_key(F.col("source")).alias("key"), "doc_id", "source", "size", "h", *["row"] * with_key, "start"), sources.select("key", "rows", "source_size", "target", "shape"), ["key"], "rows", n_rows, ["h"])
    df = df.withColumn("knots", knots_of(F.col("shape"), F.col("target"), schedules))
    whole = F.floor("target")
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), whole - start)).cast("long")
    first, again = part(F.col("start")), part(F.col("start") + F.col("source_size"))
    df = df.select(*["h", "row"] * with_key, "doc_id", "source", "size", "source_size", "target", (first + again).alias("taken"), first.alias("first_taken"), *[F.when(n > 0, _time_at(F.col("knots"), at.cast("double"))).alias(t) for t, n, at in (("t", first, F.col("start")), ("u", again, F.col("start") + F.col("source_size")))])
    curve = total_curve(by_shape, schedules)
    place = lambda t: F.when(F.col(t).isNotNull(), F.floor(_demand_at(curve, F.col(t))))
    df = df.withColumns({"position": place("t"), "again_position": place("u")})
    return df.drop("t", "u").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns of a row, nulls by their place; maps count as their sorted entries."""
    plain = [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in rows.schema]
    return F.xxhash64(F.lit(29), *[x for c in plain for x in (c.isNull(), c)])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``; a document taken twice comes twice,
    each time where its source's schedule puts it.

    A document at the end of its source's demand, of which only a part would be taken, comes whole if
    that part is at least half of it. Rows meet their places by hashes of their id, text and all columns, which moves each text once, and the
    sort moves it into training order; of rows that are equal in every column, one stands for all. Null texts have no words and don't come.
    """
    text = options.get("text", "text")
    seed = options.get("seed", 17)
    keys = ["__h", "__row"]
    places = mix(docs, **options, with_key=True).where(F.col("taken") > 0)
    half = F.col("size") / 2
    at = F.array_compact(F.array(F.when(F.col("first_taken") >= half, F.col("position")), F.when(F.col("taken") - F.col("first_taken") >= half, F.col("again_position"))))
    places = places.select(F.col("h").alias("__h"), F.col("row").alias("__row"), F.explode(at).alias("__position"))
    doc = F.col("doc_id").cast("long")
    rows = docs.withColumns({"__h": F.xxhash64(F.lit(seed), doc, F.col(text)), "__row": row_hash(docs)})
    equal = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))
    if not small(equal, 0):
        equal = broadcast_if_small(equal)
        rows = rows.join(equal, keys, "left_anti").unionByName(rows.join(equal, keys, "left_semi").dropDuplicates(keys))
    return rows.join(places, keys).orderBy("__position", doc, "__row").select(*docs.columns)
