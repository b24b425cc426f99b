"""Substring dedup by fixed-block anchors (operator 6).

Every document is cut into non-overlapping reference blocks of BLOCK words, counted from its start, which
are indexed by hash. Every rolling window of BLOCK words probes the index. A hit is then extended: the
WINDOW-word windows around it are compared as 128-bit hashes, and the union of the repeated ones is the maximal exact
repeats.

Which probes travel: of each run of GROUP consecutive blocks of one phase (any place may start one), both sides keep the
block with the least hash. None is lost: WINDOW = (GROUP + 1) * BLOCK words at p that stand at q, too, hold, wherever q's reference
blocks fall, GROUP whole ones of them in a row. Their words are the same at p, where they are GROUP consecutive windows of one phase; so
both places keep the one with the least hash, which is a reference block at q: p's window has a hit. The same holds
the other way round. GROUP = 1 keeps every block and every window; tests compare the two.

Documents are dealt to groups. A group sends each distinct hash once, with what is needed to count it, and gets those back that
are repeated; where they stand it finds in its own texts. So a block that stands everywhere is one entry of each group. The texts are
shuffled once, by group, and that shuffle is read again by the later steps.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Batch, hash_windows

WINDOW = 35
BLOCK = 7
GROUP = 4
#: Flags of an entry: it has a reference block; it stands for two places or more.
IS_BLOCK, MANY = 1, 2


def _batch(t) -> Batch:
    return Batch([x.encode() for x in t["__text"].to_pylist()])


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct keys in order, order of the rows, first row of each key in that order); a key has one column or more."""
    order = np.lexsort(keys[::-1])
    rows = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in rows], axis=0)
    first = np.flatnonzero(new)
    return [k[first] for k in rows], order, first


def entries(keys: list[np.ndarray], block: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys of a group and their flags."""
    some, order, first = distinct(keys)
    if not len(first):
        return some, np.zeros(0, "u1")
    many = np.diff(np.append(first, len(order))) > 1
    return some, (np.maximum.reduceat(block[order], first) * IS_BLOCK + many * MANY).astype("u1")


def repeated(keys: list[np.ndarray], flags: np.ndarray) -> np.ndarray:
    """Whether each entry's key has two places or more, one of them a reference block."""
    some, order, first = distinct(keys)
    if not len(first):
        return np.zeros(0, bool)
    places = np.add.reduceat((1 + (flags & MANY > 0))[order], first)
    good = (places > 1) & (np.bitwise_or.reduceat(flags[order], first) & IS_BLOCK > 0)
    out = np.empty(len(order), bool)
    out[order] = np.repeat(good, np.diff(np.append(first, len(order))))
    return out


def _rows(bucket: np.ndarray, group: int, columns: list[np.ndarray], flags: np.ndarray):
    """One packed row for each bucket: columns of hashes, then flags. Keys are in order, and so are their buckets."""
    import pyarrow as pa

    ids, at = np.unique(bucket, return_index=True)
    ends = np.append(at[1:], len(bucket)).tolist()[: len(at)]
    packed = [b"".join([c[a:z].tobytes() for c in (*columns, flags)]) for a, z in zip(at.tolist(), ends, strict=True)]
    return pa.table({"bucket": pa.array(ids, pa.int32()), "grp": pa.array(np.full(len(ids), group), pa.int32()), "n": pa.array(np.array(ends, "i8") - at, pa.int32()), "data": pa.array(packed, pa.binary())})


_PACKED = "bucket int, grp int, n int, data binary"
_HITS = "grp int, bucket int, data binary"


def anchors(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, hash, is a reference block) of the kept blocks of a batch."""
    h = hash_windows(batch.words(), BLOCK)
    n = len(batch.starts)
    keep = np.zeros(n, bool)
    if len(h):
        start = np.flatnonzero(batch.inside(BLOCK * GROUP))  # first blocks of whole groups
        least = h[start].copy()
        for k in range(1, GROUP):
            np.minimum(least, h[start + k * BLOCK], out=least)
        for k in range(GROUP):
            at = start + k * BLOCK
            keep[at[h[at] == least]] = True
    at = np.flatnonzero(keep)
    first = np.repeat(batch.first[:-1], np.diff(batch.first))
    return at, h[at], (at - first[at]) % BLOCK == 0


def extended(batch: Batch, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, two hashes) of the whole windows that hold a hit block."""
    n = len(batch.starts)
    edge = np.zeros(n + 1, "i8")
    first = np.repeat(batch.first[:-1], np.diff(batch.first))
    np.add.at(edge, np.maximum(hits + BLOCK - WINDOW, first[hits]), 1)
    np.add.at(edge, hits + 1, -1)
    at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & batch.inside(WINDOW))
    if not len(at):
        return at, np.zeros(0, "u8"), np.zeros(0, "u8")
    return at, hash_windows(batch.words(0), WINDOW, 0)[at], hash_windows(batch.words(1), WINDOW, 1)[at]


def covered(batch: Batch, starts: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window that starts at one of ``starts``."""
    edge = np.zeros(len(batch.starts) + 1, "i8")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _of_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i4")


def _resolve(packed: DataFrame, kinds: list[str]) -> DataFrame:
    """(grp, bucket, keys) of the entries that are repeated; one bucket after the other is in a task's memory."""
    width = sum(np.dtype(k).itemsize for k in kinds)

    def settle(rows: list[tuple[int, int, int, bytes]]):
        import pyarrow as pa

        cols, ends = [], np.cumsum([r[2] for r in rows])
        at = 0
        for k in kinds:
            size = np.dtype(k).itemsize
            cols.append(np.concatenate([np.frombuffer(r[3], k, r[2], at * r[2]) for r in rows]))
            at += size
        flags = np.concatenate([np.frombuffer(r[3], "u1", r[2], width * r[2]) for r in rows])
        good = repeated(cols, flags)
        found = []
        for (bucket, grp, n, _), z in zip(rows, ends.tolist(), strict=True):
            mine = good[z - n : z]
            if mine.any():
                found.append((grp, bucket, b"".join([c[z - n : z][mine].tobytes() for c in cols])))
        for i in range(0, len(found), 1024):
            part = list(zip(*found[i : i + 1024], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary())], ["grp", "bucket", "data"])

    def run(batches):
        rows: list[tuple[int, int, int, bytes]] = []
        for b in batches:
            for i in range(b.num_rows):
                row = tuple(b.column(j)[i].as_py() for j in range(4))
                if rows and rows[0][0] != row[0]:
                    yield from settle(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from settle(rows)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _HITS)


def _known(hits, kinds: list[str]) -> list[np.ndarray]:
    """Columns of the keys that a group got back, and their buckets as the last one."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds] + [[np.zeros(0, "i8")]]
    for bucket, data in zip(hits["bucket"].to_pylist(), hits["data"].to_pylist(), strict=True):
        n, at = len(data) // width, 0
        for k, p in zip(kinds, parts, strict=False):
            p.append(np.frombuffer(data, k, n, at))
            at += n * np.dtype(k).itemsize
        parts[-1].append(np.full(n, bucket, "i8"))
    return [np.concatenate(p) for p in parts]


def _is_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def repeated_windows(batch: Batch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word numbers at which a window with one of the keys (a, b) starts."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(batch.inside(WINDOW))
    h = hash_windows(batch.words(0), WINDOW, 0)[at]
    on = _is_in(h, a)
    at, h = at[on], h[on]
    if not len(at):
        return at
    second = hash_windows(batch.words(1), WINDOW, 1)[at]
    place, found = np.searchsorted(a, h), np.zeros(len(at), bool)
    while (same := (place < len(a)) & (a[np.minimum(place, len(a) - 1)] == h)).any():  # more than once only for a collision in a
        found |= same & (b[np.minimum(place, len(a) - 1)] == second)
        place = place + 1
    return at[found]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", output: str = "text", group_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or kept_sha256, with output="digest") of every document.

    Removed is each word covered by a 35-word window whose word sequence starts anywhere else too, all
    judged on the input. Null texts have no words. Rows that repeat a document repeat its windows, so all of
    them lose their words; order and ties play no role. Extra columns are ignored.

    Scale: a group's text grows with the root of the whole (2 MB of 1 GB, 20 MB of 100 GB), within 256 KB and 128 MB, so
    that both the number of groups and their size stay fit for tasks; there is a bucket of hashes for each eight
    groups, at least 64. Nothing is collected; no pair of documents is formed. Rows with the same doc_id and text are in one group.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    size = src.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    group_bytes = group_bytes or min(128 << 20, max(256 << 10, 64 * math.isqrt(size)))
    groups = max(1, -(-size // group_bytes))
    buckets = max(64, groups // 8)
    src = src.withColumn("grp", F.pmod(F.xxhash64("__doc", "__text"), F.lit(groups)).cast("int"))

    def low(h: np.ndarray) -> np.ndarray:
        """A block's key: its bucket and the lower half of its hash."""
        return _of_bucket(h, buckets).astype("u8") << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    def probe(t):
        _, h, block = anchors(_batch(t))
        (key,), flags = entries([low(h)], block)
        return _rows((key >> np.uint64(32)).astype("i4"), t["grp"][0].as_py(), [key.astype("<u4")], flags)

    def extend(t, hits):
        if not t.num_rows or not hits.num_rows:
            return _rows(np.zeros(0, "i4"), 0, [np.zeros(0, "<u8")] * 2, np.zeros(0, "u1"))
        batch = _batch(t)
        at, h, _ = anchors(batch)
        part, bucket = _known(hits, ["<u4"])
        key = np.sort(bucket.astype("u8") << np.uint64(32) | part)
        _, a, b = extended(batch, at[_is_in(low(h), key)])
        (a, b), flags = entries([a, b], np.ones(len(a), "u1"))
        return _rows(_of_bucket(a, buckets), t["grp"][0].as_py(), [a.astype("<u8"), b.astype("<u8")], flags)

    last = T.StructField("kept_sha256" if output == "digest" else "kept_text", T.StringType())
    schema = T.StructType([T.StructField("__doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), last])

    def remove(t, hits):
        import pyarrow as pa

        batch = _batch(t)
        a, b, _ = _known(hits, ["<u8", "<u8"])
        gone = covered(batch, repeated_windows(batch, a, b) if len(a) else np.zeros(0, "i8"))
        n, lost, kept = [], [], []
        for i, raw in enumerate(batch.texts):
            mask = gone[batch.first[i] : batch.first[i + 1]]
            words = raw.split()
            n.append(len(words))
            lost.append(int(mask.sum()))
            rest = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if lost[-1] else words)
            kept.append(hashlib.sha256(rest).hexdigest() if output == "digest" else rest.decode())
        return pa.table({"__doc": t["__doc"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), last.name: pa.array(kept, pa.string())})

    by_group = src.groupBy("grp")
    found = _resolve(by_group.applyInArrow(probe, _PACKED), ["<u4"])
    windows = by_group.cogroup(found.groupBy("grp")).applyInArrow(extend, _PACKED)
    again = _resolve(windows, ["<u8", "<u8"])
    return by_group.cogroup(again.groupBy("grp")).applyInArrow(remove, schema).withColumnRenamed("__doc", doc_id)
