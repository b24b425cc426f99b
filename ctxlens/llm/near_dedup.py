"""MinHash near-dedup with odd sketches (operator 8).

1. A document's set is its distinct 5-word shingles. Documents with the same set form a class, which one
   row stands for from here on (hot groups of copies end in a partial aggregation).
2. Each class has MinHash samples; bands of them give buckets, and all samples are folded into an odd sketch,
   a bitmap of parities. The population count of the XOR of two sketches estimates how many
   samples differ, precisely where similarity is high.
3. Buckets of the same members count once. Members of a bucket, with their sets, are packed into blocks of bounded number and
   size. A task takes a block: pairs that its own links don't connect yet, that meet in no earlier band, and whose sketches
   promise enough similarity are confirmed on the full sets. It returns a spanning forest of its links, never all pairs.
4. Buckets of more than one block: after connecting what is known, blocks hold members of one component where
   they can; pairs of blocks that are wholly of one component are left out, the others are compared likewise,
   each pair of blocks under a key of its own.
5. Components of the links by alternating stars; the smallest doc_id is the component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, broadcast_if_small, cut, small, split_join
from .hashing import Batch, hash_windows, mix


@dataclass(frozen=True)
class Params:
    """Pairs at 85 % miss all of 24 bands of 5 samples with a probability of 8e-7.

    promise: pairs whose sketches estimate less similarity than this are not compared. At 85 % the sketches differ in 33 of
    256 bits, with a deviation of 7; 0.48 stands for 80 bits. block, block_bytes: members of a block, and
    the bytes of their sets (a single set may be larger).
    """

    width: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    bits: int = 256
    promise: float = 0.476
    block: int = 512
    block_bytes: int = 8 << 20
    seed: int = 5


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words has its whole sequence as one shingle."""
    batch = Batch([t.encode().lower() for t in texts])  # bytes.lower() maps A-Z only
    words = batch.words()
    h = hash_windows(words, width)
    out = []
    for a, b in zip(batch.first[:-1].tolist(), batch.first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif n:
            out.append(mix(hash_windows(words[a:b], n) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return mix(s).sum(dtype="u8").tobytes() + mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype="u8").tobytes()


class Signer:
    """MinHash samples, band keys and odd sketches."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(p.seed)
        k = p.bands * p.rows
        self.p = p
        self.flip = rng.integers(0, 1 << 32, k, dtype="u4")
        self.factor = rng.integers(0, 1 << 31, k, dtype="u4") * np.uint32(2) + np.uint32(1)
        self.place = rng.integers(0, 1 << 63, k, dtype="u8")
        self.band = rng.integers(0, 1 << 63, p.bands, dtype="u8")

    def samples(self, s: np.ndarray) -> np.ndarray:
        low = (s >> np.uint64(32)).astype("u4")
        out = np.full(len(self.flip), 0xFFFFFFFF, "u4")
        for at in range(0, len(low), 256):
            x = (low[at : at + 256, None] ^ self.flip) * self.factor
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """One key for each band."""
        key = self.band.copy()
        for col in samples.reshape(self.p.bands, self.p.rows).T:
            key = mix(key ^ col.astype("u8"))
        return key

    def sketch(self, samples: np.ndarray) -> bytes:
        """Parity of the number of samples that fall on each bit."""
        at = mix(samples.astype("u8") ^ self.place) % np.uint64(self.p.bits)
        odd = np.bincount(at.astype("i8"), minlength=self.p.bits) & 1
        return np.packbits(odd.astype("u1")).tobytes()


def similarity(differing: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """Estimates of the Jaccard similarity from the numbers of bits in which two odd sketches differ."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(differing) / bits))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def compare(rows: list[dict], other: list[dict] | None, band: int, p: Params) -> list[tuple[bytes, bytes]]:
    """Links between members of a bucket (of one block, or of two): a spanning forest over their components.

    A pair is confirmed only if it isn't connected yet and meets in no band before this one (there it is
    compared too). Members that have a component (``comp``) start connected.
    """
    both = rows + (other or [])
    forest, seen = Forest(len(both)), {}
    for i, r in enumerate(both):
        c = r.get("comp") or r["node"]
        if c in seen:
            forest.join(i, seen[c])
        seen.setdefault(c, i)
    sketch = np.array([np.frombuffer(r["sketch"], "<u8") for r in both])
    bands = np.array([np.frombuffer(r["bands"], "<u8") for r in both])
    sets: dict[int, np.ndarray] = {}
    get = lambda i: sets.setdefault(i, np.frombuffer(both[i]["shingles"], "<u8"))
    size = np.array([len(r["shingles"]) // 8 for r in both], "i8")
    links = []
    lo = len(rows) if other is not None else 0
    for i in range(len(rows)):
        rest = np.arange(max(lo, i + 1), len(both))
        if not len(rest):
            break
        near = similarity(np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1), p.bits, p.bands * p.rows) >= p.promise
        near &= 100 * np.minimum(size[rest], size[i]) >= p.percent * np.maximum(size[rest], size[i])
        rest = rest[near]
        if band and len(rest):
            rest = rest[~(bands[rest, :band] == bands[i, :band]).any(axis=1)]
        for j in rest.tolist():
            if forest.top(i) != forest.top(j) and linked(get(i), get(j), p.percent):
                forest.join(i, j)
                links.append((both[i]["node"], both[j]["node"]))
    return links


_MEMBER = "node binary, bands binary, sketch binary, shingles binary"
_LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


_KEY = ["__k0", "__k1"]


def _keyed(doc_id: str, text: str) -> list[Column]:
    """__doc, the row key (128 bits of doc_id and text, so rows with one key are copies) and __text."""
    doc, t = F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [doc.alias("__doc"), *[F.xxhash64(F.lit(i), doc, t).alias(k) for i, k in enumerate(_KEY)], t.alias("__text")]


def signatures(docs: DataFrame, p: Params, doc_id: str, text: str) -> DataFrame:
    """__doc, row key, n_shingles, node (digest of the set), bands, sketch of every document."""

    def run(batches):
        import pyarrow as pa

        signer = Signer(p)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = shingle_sets(part.column(3).to_pylist(), p.width)
                samples = [signer.samples(s) if len(s) else None for s in sets]
                cols = [[len(s) for s in sets], [digest(s) for s in sets], [None if x is None else signer.bands(x).astype("<u8").tobytes() for x in samples], [None if x is None else signer.sketch(x) for x in samples]]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(3)] + [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["__doc", *_KEY, "n_shingles", "node", "bands", "sketch"])

    src = docs.select(*_keyed(doc_id, text))
    return src.mapInArrow(run, "__doc long, __k0 long, __k1 long, n_shingles long, node binary, bands binary, sketch binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, p: Params, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, each from the row that ``wanted`` (node, row key) names."""
    ids = wanted.select(*_KEY, F.col("node").alias("__node"))
    met = docs.select(*_keyed(doc_id, text)).join(broadcast_if_small(ids), _KEY).select("__node", "__text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                nodes = part.column(0).to_pylist()
                sets = shingle_sets(part.column(1).to_pylist(), p.width)
                rows = [(n, s.astype("<u8").tobytes()) for n, s in zip(nodes, sets, strict=True) if digest(s) == n]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])

    return met.mapInArrow(run, "node binary, shingles binary")


def _key_bands(df: DataFrame, p: Params, *more: str) -> DataFrame:
    """One row for each band of a node: (key, band, node, ...). Band keys are the eight-byte pieces of ``bands``."""
    piece = lambda i: F.substring("bands", 8 * i + 1, 8)
    items = F.array(*[F.struct(F.lit(i).alias("band"), piece(i).alias("key")) for i in range(p.bands)])
    return df.select("node", *more, F.explode(items).alias("x")).select("node", *more, "x.band", "x.key")


def _within(blocks: DataFrame, p: Params) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                links = compare(b.column(1)[i].as_py(), None, b.column(0)[i].as_py(), p)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.binary()) for j in (0, 1)], ["a", "b"])

    return blocks.select("band", "members").mapInArrow(run, _LINKS)


def _between(pairs: DataFrame, p: Params) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                left = b.column(1)[i].as_py()
                links = compare(left, b.column(2)[i].as_py(), b.column(0)[i].as_py(), p)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.binary()) for j in (0, 1)], ["a", "b"])

    return pairs.select("band", "left", "right").mapInArrow(run, _LINKS)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links reach, by alternating large and small stars until nothing changes.

    Each round is aggregations and joins on nodes, written to the shared folder; hubs are split. The number of rounds
    grows with the logarithm of the longest path. Nodes without links don't appear.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = cut(edges)
    size, last = edges.count(), None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = split_join(both.where("v > u"), least, ["u"], "c", 2 * size, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        size, last = now[0], now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def _slots(n: Column, size: Column, p: Params) -> Column:
    """Blocks for so many members with sets of so many bytes."""
    return F.ceil(F.greatest(n / p.block, size / p.block_bytes)).cast("int")


def _linked(docs: DataFrame, p: Params, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (node, comp) of the nodes that are linked."""
    sigs = cut(signatures(docs, p, doc_id, text))
    some = sigs.where("n_shingles > 0")
    nodes = some.groupBy("node").agg(F.min(F.struct(F.coalesce("__doc", F.lit(-1)).alias("d"), *_KEY, (8 * F.col("n_shingles")).alias("bytes"), "bands", "sketch")).alias("r"))
    nodes = nodes.select("node", *[F.col(f"r.{k}").alias(k) for k in (*_KEY, "bytes", "bands", "sketch")])
    keyed = _key_bands(nodes, p, "bytes")
    # buckets with the same members (by a 128-bit digest of the set) hold the same pairs: the first band's stands for all
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in (0, 1)]
    crowds = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"), *same).where("n > 1")
    crowds = cut(crowds.groupBy("n", "size", "s0", "s1").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n", "size"))
    bound = crowds.select("band", "key", "n", _slots(F.col("n"), F.col("size"), p).alias("slots"))
    places = split_join(keyed, bound, ["band", "key"], "n", max(1, p.bands * (some.count())), ["node"]).where("slots IS NOT NULL")
    places = cut(places.select("band", "key", "slots", "node", "bytes"))
    wanted = cut(nodes.join(places.select("node").distinct(), "node"))
    sets = _sets_of(docs, wanted, p, doc_id, text).groupBy("node").agg(F.first("shingles").alias("shingles"))
    members = wanted.select("node", "bands", "sketch").join(sets, "node")

    dealt = places.withColumn("slot", F.pmod(F.xxhash64("node", "key"), F.col("slots")).cast("int")).join(members, "node")
    one = F.struct("node", "bands", "sketch", "shingles")
    blocks = dealt.groupBy("band", "key", "slot").agg(F.collect_list(one).alias("members")).where(F.size("members") > 1)
    links = cut(_within(blocks, p))

    if places.where("slots > 1").limit(1).count():
        comps = components(links)
        large = places.where("slots > 1").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = large.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band", "key")
        large = cut(large.join(mixed, ["band", "key"]))
        # components of half a block and more fill blocks of their own; the others are dealt together
        weight = large.groupBy("band", "key", "comp").agg(_slots(2 * F.count(F.lit(1)), 2 * F.sum("bytes"), p).alias("halves")).where("halves > 1")
        dealt = large.join(weight, ["band", "key", "comp"], "left").withColumn("own", F.when(F.col("halves").isNotNull(), F.col("comp")))
        spread = F.coalesce(F.ceil(F.col("halves") / 2), F.col("slots")).cast("int")
        dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("node", "key"), spread).cast("int")).join(members, "node")
        one = F.struct("node", "comp", "bands", "sketch", "shingles")
        at = F.concat(F.coalesce("own", F.lit(b"")), F.encode(F.lpad(F.col("slot").cast("string"), 10, "0"), "utf-8")).alias("at")
        packed = cut(dealt.groupBy("band", "key", "own", "slot").agg(F.collect_list(one).alias("members")).select("band", "key", "own", at, "members"))
        # a pair of blocks is a row without members; those come by the block, which is as good a key as there are blocks
        side = lambda s: packed.select("band", "key", F.col("own").alias(f"own_{s}"), F.col("at").alias(f"at_{s}"))
        pairs = side("a").join(side("b"), ["band", "key"]).where((F.col("at_a") < F.col("at_b")) & ~F.coalesce(F.col("own_a") == F.col("own_b"), F.lit(False)))
        block = lambda s, name: packed.select("band", "key", F.col("at").alias(f"at_{s}"), F.col("members").alias(name))
        met = pairs.drop("own_a", "own_b").join(block("a", "left"), ["band", "key", "at_a"]).join(block("b", "right"), ["band", "key", "at_b"])
        links = cut(_between(met, p).unionByName(links))

    return sigs, components(links)


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and wordless texts have no shingles and are linked with nothing. Rows with one doc_id stay apart unless
    their texts are linked; component_id is the least doc_id in the component (null only if all are), and
    kept is doc_id = component_id. Extra columns are ignored.

    Recall of the bands and of the sketch filter is stated at Params; no bucket, block or candidate list is
    capped.
    """
    sigs, comps = _linked(docs, p, doc_id, text)
    some = sigs.where("n_shingles > 0").select("__doc", *_KEY, "n_shingles", "node")
    nodes = some.groupBy("node").agg(F.min("__doc").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    names = nodes.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    total = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.sum("copies").alias("rows")).first()
    named = cut(split_join(nodes, names, ["comp"], "size", total["nodes"], ["node"]).select("node", "component_id", "copies"))
    linked_rows = split_join(some, named, ["node"], "copies", total["rows"] or 0, _KEY)
    alone = sigs.where("n_shingles = 0").select("__doc", "n_shingles", F.col("__doc").alias("component_id"))
    out = linked_rows.select("__doc", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("__doc").alias(doc_id), "n_shingles", "component_id", F.col("__doc").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of near-duplicates, whatever the doc_ids are.

    The row with the least doc_id (null last) stays; among several, the one with the least row key. Of
    copies (same doc_id and text) any one. Rows without words are linked with nothing and all stay.
    """
    sigs, comps = _linked(docs, p, doc_id, text)
    some = sigs.where("n_shingles > 0").select("__doc", *_KEY, "node")
    first = some.groupBy("node").agg(F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", *_KEY)).alias("r"))
    known = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = known.groupBy("comp").agg(F.min("r").alias("r"))
    stay = cut(best.select(*[F.col(f"r.{k}").alias(k) for k in _KEY]))
    copied = cut(some.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY).join(stay, _KEY))
    keyed = docs.withColumns({c: v for c, v in zip(["__doc", *_KEY, "__text"], _keyed(doc_id, text), strict=True)})
    worded = keyed.where(F.col("__text").rlike(WORD))
    if not small(copied, 0):
        once = worded.join(stay.join(copied, _KEY, "left_anti"), _KEY, "left_semi")
        worded = once.unionByName(worded.join(copied, _KEY, "left_semi").dropDuplicates(_KEY))
    else:
        worded = worded.join(stay, _KEY, "left_semi")
    return worded.unionByName(keyed.where(~F.col("__text").rlike(WORD))).select(*docs.columns)
