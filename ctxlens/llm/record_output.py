"""Token ids as length-delimited binary records with an offset index (operator 1).

Frame of a record (little-endian): uint64 length of the payload, uint32 masked CRC-32C of those
eight bytes, the payload, uint32 masked CRC-32C of the payload. Payload: int64 doc_id, uint8 flags
(1: doc_id is null), uint8 bytes per id (2 or 4), the ids. Each shard ``part-NNNNN.rec`` has an index
``part-NNNNN.idx`` of 32-byte entries: int64 doc_id, uint64 offset of the frame, uint64 ids, uint64
ids before it in the shard; with it, records can be read in any order.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import json_encoder, ranks_encoder
from .common import fresh_dir

POLY = 0x82F63B78  # CRC-32C, reflected (fixed value, as is the mask's constant)
MASK = 0xA282EAD8
BLOCK = 64
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8"), ("before", "<u8")])
HEAD = 10


def _matrix_tables(columns: np.ndarray) -> np.ndarray:
    """(4, 256) lookup of a linear map on 32 bits, from the images of the 32 unit vectors."""
    out = np.zeros((4, 256), "u4")
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], 0).astype("u4")
    return out


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16 & 255] ^ tables[3][v >> 24]


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Two bytes at once; and for each j the map that appends 2**j zero bytes."""
    one = np.arange(256, dtype="u4")
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ POLY, one >> 1).astype("u4")
    two = np.arange(65536, dtype="u4")
    for _ in range(2):
        two = one[two & 255] ^ two >> 8
    units = (np.uint32(1) << np.arange(32, dtype="u4")).astype("u4")
    power = [_matrix_tables(one[units & 255] ^ units >> 8)]
    for _ in range(40):
        power.append(_matrix_tables(_apply(power[-1], _apply(power[-1], units))))
    return two, power


def _append_zeros(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    _, power = _crc_tables()
    crc, n = crc.copy(), n_bytes.astype("u8")
    for j in range(int(n.max(initial=0)).bit_length()):
        on = (n >> np.uint64(j) & np.uint64(1)).astype(bool)
        crc[on] = _apply(power[j], crc[on])
    return crc


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string.

    The checksum is linear, so all strings are cut into blocks that end at their ends, the blocks
    are reduced side by side, and each block's remainder is moved by the bytes that follow it.
    """
    two, _ = _crc_tables()
    size = np.array([len(p) for p in parts], "i8")
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    flat = np.zeros(int(blocks.sum()) * BLOCK, "u1")
    for p, f, b in zip(parts, first.tolist(), blocks.tolist(), strict=True):
        if p:
            end = (f + b) * BLOCK
            flat[end - len(p) : end] = np.frombuffer(p, "u1")
    pairs = np.ascontiguousarray(flat.view("<u2").reshape(-1, BLOCK // 2).T)
    crc = np.zeros(pairs.shape[1], "u4")
    for row in pairs:
        crc = two[(crc ^ row) & 0xFFFF] ^ crc >> 16
    after = np.repeat(first + blocks, blocks) - np.arange(len(crc)) - 1
    crc = _append_zeros(crc, after * BLOCK)
    out = np.zeros(len(parts), "u4")
    some = blocks > 0
    if some.any():
        out[some] = np.bitwise_xor.reduceat(crc, first[some])
    return out ^ _append_zeros(np.full(len(parts), 0xFFFFFFFF, "u4"), size) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(MASK)).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    """Framed records."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    sums = masked(crc32c(heads + payloads))
    n = len(payloads)
    return [h + sums[i].tobytes() + p + sums[n + i].tobytes() for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframe(f, n: int) -> list[bytes]:
    """The next ``n`` payloads of an open file; raises ValueError on a wrong length or checksum."""
    heads, payloads, sums = [], [], []
    for _ in range(n):
        h = f.read(12)
        size = int.from_bytes(h[:8], "little")
        body = f.read(size + 4)
        if len(h) < 12 or len(body) < size + 4:
            raise ValueError("a record is cut short")
        heads.append(h[:8])
        payloads.append(body[:size])
        sums += [h[8:], body[size:]]
    want = masked(crc32c([x for pair in zip(heads, payloads, strict=True) for x in pair]))
    if want.tobytes() != b"".join(sums):
        raise ValueError("a record's checksum is wrong")
    return payloads


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian unsigned 32-bit integers) of a payload."""
    kind = "<u2" if payload[9] == 2 else "<u4"
    return None if payload[8] & 1 else int.from_bytes(payload[:8], "little", signed=True), np.frombuffer(payload, kind, offset=HEAD).astype("<u4")


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder: file, hdfs, s3 and the like."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Shard:
    path: str
    docs: int
    tokens: int


def encoder_of(path: str, pattern: str | None):
    """``pattern`` None: a tokenizers JSON file; otherwise a rank file."""
    return json_encoder(path) if pattern is None else ranks_encoder(path, pattern)


def write_records(docs: DataFrame, path: str, end_id: int | None = 0, out_dir: str | None = None, text: str = "text", pattern: str | None = None, order: list[str] | None = None, shard_bytes: int | None = None) -> list[Shard]:
    """Encodes whole texts and writes shards in ascending doc_id order (null first); returns the manifest, in order.

    One range shuffle by (doc_id, hash of the text) sorts across shards; rows with an equal doc_id are
    ordered by that hash, so reruns write the same bytes. ``order``: other columns to order by instead, before these. A task writes
    its shard under a name of its own attempt and then moves it into place, so lost or doubled attempts leave whole
    files. Null texts are empty; an empty table gives no shards; extra columns are ignored, whatever their names.

    Scale: a shard has about ``shard_bytes`` of text, by default a multiple of the root of the whole, from 8 MB to 512 MB. Rows that
    share a doc_id, or are equal, are split like any others. A task holds 256 records and as many index entries. The manifest
    has one entry per shard.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_dir(spark, "records")
    by = [F.col(c) for c in order or []]
    keyed = docs.select(*[c.alias(f"by{i}") for i, c in enumerate(by)], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bytes = shard_bytes or min(512 << 20, max(8 << 20, 64 * math.isqrt(size)))
    keys = [*[F.col(f"by{i}") for i in range(len(by))], F.col("doc_id").asc_nulls_first(), F.col("h")]
    keyed = keyed.withColumns({"h": F.xxhash64("text"), "equal": F.monotonically_increasing_id()})  # the last only deals equal rows to several shards
    ordered = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), *keys, "equal").sortWithinPartitions(*keys)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, fs_path = encoder_of(path, pattern), file_system(out_dir)
        fs, base = fs_path
        wide = enc.tok.get_vocab_size(with_added_tokens=True) > 1 << 16
        kind, width = ("<u4", 4) if wide else ("<u2", 2)
        tail = b"" if end_id is None else np.array([end_id], kind).tobytes()
        part = TaskContext.get().partitionId()
        own = f"{base}/.{uuid.uuid4().hex}"
        rec = idx = None
        at = before = n_docs = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                packed = [np.frombuffer(x, "<u4").astype(kind).tobytes() + tail for x in enc.encode(texts)]
                if rec is None:
                    fs.create_dir(base, recursive=True)
                    rec, idx = (fs.open_output_stream(f"{own}.{ext}") for ext in ("rec", "idx"))
                index = []
                for i, p, frame in zip(ids, packed, frames([(i or 0).to_bytes(8, "little", signed=True) + bytes([i is None, width]) + p for i, p in zip(ids, packed, strict=True)]), strict=True):
                    n = len(p) // width
                    index.append((i or 0, at, n, before))
                    rec.write(frame)
                    at += len(frame)
                    before += n
                idx.write(np.array(index, INDEX).tobytes())
                n_docs += len(index)
        if rec is None:
            return
        rec.close()
        idx.close()
        for ext in ("rec", "idx"):
            fs.move(f"{own}.{ext}", f"{base}/part-{part:05d}.{ext}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "tokens": [before]})

    done = ordered.select("doc_id", "text").mapInArrow(write, "part long, docs long, tokens long").collect()
    return [Shard(f"{out_dir}/part-{r.part:05d}", r.docs, r.tokens) for r in sorted(done, key=lambda r: r.part)]


def read_records(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard, offset of every record, checksums verified.

    One task reads a shard from end to end in bounded steps; the shard's index must agree with it.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long"
    rows, before = [], 0
    for i, s in enumerate(shards):
        rows.append((i, s.path, before))
        before += s.tokens

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for shard, path, base in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, p = file_system(path)
                with fs.open_input_stream(f"{p}.idx", buffer_size=1 << 16) as idx, fs.open_input_stream(f"{p}.rec", buffer_size=1 << 20) as f:
                    while entries := idx.read(256 * INDEX.itemsize):
                        part = np.frombuffer(entries, INDEX)
                        docs, counts, crcs = [], [], []
                        for payload in unframe(f, len(part)):
                            doc, ids = ids_of(payload)
                            docs.append(doc)
                            counts.append(len(ids))
                            crcs.append(zlib.crc32(ids.tobytes()))
                        if counts != part["n"].tolist() or [d or 0 for d in docs] != part["doc_id"].tolist():
                            raise ValueError(f"{path}: index and records differ")
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array(docs, pa.int64()), "start": (part["before"].astype("i8") + base), "n_tokens": counts, "ids_crc32": crcs, "shard": pa.array([shard] * len(part), pa.int32()), "offset": part["offset"].astype("i8")}
                        )

    todo = spark.createDataFrame(rows, "shard int, path string, base long")
    return todo.repartition(max(1, len(rows))).mapInArrow(read, schema)


def read_index(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """path, number, offset of every record, from the index files alone."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = file_system(path)
                with fs.open_input_stream(f"{p}.idx", buffer_size=1 << 20) as f:
                    at = 0
                    while entries := f.read(10_000 * INDEX.itemsize):
                        part = np.frombuffer(entries, INDEX)
                        yield pa.RecordBatch.from_pydict({"path": [path] * len(part), "number": np.arange(at, at + len(part)), "offset": part["offset"].astype("i8")})
                        at += len(part)

    todo = spark.createDataFrame([(s.path,) for s in shards], "path string")
    return todo.repartition(max(1, len(shards))).mapInArrow(read, "path string, number long, offset long")


def read_at(entries: DataFrame) -> DataFrame:
    """doc_id, ids of the records that ``entries`` (path, offset) name, in their order, checksums verified."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType(), False))])

    def read(batches):
        import pyarrow as pa

        files: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for path, offset in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if path not in files:
                        if len(files) >= 64:  # open files of a task
                            files.pop(next(iter(files))).close()
                        fs, p = file_system(path)
                        files[path] = fs.open_input_file(f"{p}.rec")
                    files[path].seek(offset)
                    rows.append(ids_of(unframe(files[path], 1)[0]))
                kind = pa.list_(pa.field("element", pa.int64(), False))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype("i8") for r in rows], kind)], ["doc_id", "ids"])

    return entries.select("path", "offset").mapInArrow(read, schema)


def read_shuffled(spark: SparkSession, shards: list[Shard], seed: int) -> DataFrame:
    """doc_id, ids of all records in an order of their own for each seed (an epoch): only the index is sorted, records are read where they lie."""
    key = F.xxhash64(F.lit(seed), F.regexp_extract("path", "[^/]+$", 0), "number")
    return read_at(read_index(spark, shards).withColumn("key", key).repartitionByRange("key", "number").sortWithinPartitions("key", "number"))


def read_one(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """Record ``number`` of a shard through its index, without reading the others."""
    fs, p = file_system(path)
    with fs.open_input_file(f"{p}.idx") as f:
        f.seek(number * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with fs.open_input_file(f"{p}.rec") as f:
        f.seek(int(entry["offset"]))
        return ids_of(unframe(f, 1)[0])
