"""WARC archives with segmented records (operator 7).

Writer: one record per page, gzip member by gzip member. The HTTP block of a response carries the
payload in chunked transfer framing; a block longer than the segment size is split into a first
record and continuation records. Repeated payloads are revisit records. Reader: continuation records
are grouped by their origin's record id, ordered by segment number, checked against the total length,
joined, and the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import broadcast_if_small, cut, fresh_dir
from .record_output import file_system

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped; raises ValueError on broken framing."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, sep, body = block.partition(CRLF + CRLF)
    if not sep:
        raise ValueError("an HTTP block has no end of headers")
    coded = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(CRLF))
    return dechunk(body) if coded else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers if v is not None] + [b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(CRLF.join([*lines, b"", block, b"", b""])) + z.flush()


def records_of(f) -> "iter":
    """(headers, block) of each record of an open, decompressed archive."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't start with a WARC version")
        headers, last = {}, ""
        while (line := f.readline()) not in (CRLF, b"\n", b""):
            try:
                text = line.decode()
            except UnicodeDecodeError:
                text = line.decode("latin-1")
            if text[0] in " \t":  # a folded line goes on with the one before
                headers[last] = f"{headers.get(last, '')} {text.strip()}".strip()
                continue
            k, _, v = text.partition(":")
            last = k.strip().lower()
            headers[last] = v.strip()
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield headers, block


def write_archives(pages: DataFrame, out_dir: str | None = None, segment_bytes: int = 1 << 14, least: int = 1000, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> list[tuple[str, int]]:
    """Writes ``pages`` (page_id, url, html) and returns (path, records) of each archive.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response (all of them, where rows repeat it), the others revisit it. Null html is an empty payload;
    a page with a null id revisits like a smaller one; a null url is left out. Payloads are compared
    by SHA-256: only digests are shuffled, and pages are written where they are read unless the table of
    repeated payloads is too large to broadcast. A task writes under names of its own attempt and moves
    whole files into place.
    """
    spark = pages.sparkSession
    out_dir = out_dir or fresh_dir(spark, "warc")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.unhex(F.sha2("html", 256))
    repeated = src.where(F.octet_length("html") >= least).select("page_id", "url", key.alias("k")).groupBy("k").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = cut(repeated.where((F.col("n") > 1) & F.col("first.page_id").isNotNull()).select("k", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    todo = src.withColumn("k", key).join(broadcast_if_small(repeated), "k", "left").select("page_id", "url", "html", "first_id", "first_url")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = file_system(out_dir)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        f, files, n, at = None, [], 0, 0
        addr = lambda u: None if u is None else quote(u, safe="/:?#[]@!$&'()*+,;=%-._~")
        for b in batches:
            for i, (page, url, html, first, first_url) in enumerate(zip(*(b.column(j).to_pylist() for j in range(5)), strict=True)):
                if f is None or at >= file_bytes:
                    if f is not None:
                        f.close()
                        files[-1][1] = n
                    fs.create_dir(base, recursive=True)
                    files.append([f"part-{part:05d}-{len(files):03d}.warc.gz", 0])
                    f, n, at = fs.open_output_stream(f"{base}/.{own}-{files[-1][0]}", compression=None), 0, 0
                payload = html.encode("utf-8")
                digest = hashlib.sha1(payload).hexdigest()
                rid = lambda x: f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{part}/{len(files)}/{n}/{x}/{digest}'.encode()).digest())}>"  # noqa: E731,B023
                origin = rid(page)
                head = [("WARC-Record-ID", origin), ("WARC-Date", date), ("WARC-Target-URI", addr(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page)]
                if first is not None and (page is None or page < first):
                    out = [record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", addr(first_url)), ("Refers-To-Page-ID", first), ("Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")], HTTP)]
                else:
                    block = HTTP + chunked(payload)
                    cuts = [block[j : j + segment_bytes] for j in range(0, len(block), segment_bytes)]
                    more = [("WARC-Segment-Number", 1)] if len(cuts) > 1 else []
                    out = [record([("WARC-Type", "response"), *head, *more, ("Content-Type", "application/http; msgtype=response")], cuts[0])]
                    for j, c in enumerate(cuts[1:], 2):
                        total = [("WARC-Segment-Total-Length", len(block))] if j == len(cuts) else []
                        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", rid(f"{page}/{j}")), ("WARC-Date", date), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", j), *total], c))
                for x in out:
                    f.write(x)
                    at += len(x)
                    n += 1
        if f is None:
            return
        f.close()
        files[-1][1] = n
        for name, _ in files:
            fs.move(f"{base}/.{own}-{name}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [x[0] for x in files], "records": [x[1] for x in files]})

    done = todo.mapInArrow(write, "name string, records long").collect()
    return sorted((f"{out_dir}/{r.name}", r.records) for r in done)


_RESULT = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]
    + [T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("segments", T.IntegerType())]
)
#: What a scan of an archive gives: a result under a key of its own, or a segment (with a number) under its origin.
_PART = T.StructType(
    [T.StructField("origin", T.StringType()), *_RESULT.fields, T.StructField("digest", T.StringType()), T.StructField("http", T.BooleanType())]
    + [T.StructField("total", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("block", T.BinaryType())]
)


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def digest_of(field: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest field, whose value may be hex or base32; None for none or an unknown algorithm."""
    name, _, value = (field or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    size = hashlib.new(name, usedforsecurity=False).digest_size
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def _decoded(page, digest, http: bool, block: bytes, segments: int) -> dict:
    payload = http_payload(block) if http else block
    want = digest_of(digest)
    if want and hashlib.new(want[0], payload, usedforsecurity=False).digest() != want[1]:
        raise ValueError(f"page {page}: the payload's digest is wrong")
    return {"page_id": page, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "record_type": "response", "refers_to": None, "segments": segments}


def _row(h: dict, block: bytes, key: str) -> dict | None:
    """What a record gives: a result, a segment, or nothing (kinds that hold no payload)."""
    page, kind = _number(h.get("page-id")), h.get("warc-type")
    http = h.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    if "warc-segment-number" in h:
        own = {"page_id": page, "digest": h.get("warc-payload-digest"), "http": http} if kind != "continuation" else {}
        return {"origin": h.get("warc-segment-origin-id") or h["warc-record-id"], **own, "total": _number(h.get("warc-segment-total-length")), "no": int(h["warc-segment-number"]), "block": block}
    if kind == "revisit":
        digest = digest_of(h.get("warc-payload-digest"))
        sha = digest[1].hex() if digest and digest[0] == "sha1" else None
        return {"origin": key, "page_id": page, "payload_bytes": _number(h.get("payload-length")), "payload_digest": sha, "record_type": "revisit", "refers_to": _number(h.get("refers-to-page-id")), "segments": 1}
    if kind not in ("response", "resource"):
        return None
    return {"origin": key, **_decoded(page, h.get("warc-payload-digest"), http, block, 1)}


def _scan(archives: DataFrame) -> DataFrame:
    """Results and segments of the records of archives, read once."""
    kind = to_arrow_schema(_PART)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = file_system(path)
                out, size = [], 0
                with fs.open_input_stream(p, buffer_size=1 << 20, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as f:
                    for i, (headers, block) in enumerate(records_of(f)):
                        if (r := _row(headers, block, f"{path}#{i}")) is None:
                            continue
                        out.append(r)
                        size += len(r.get("block") or b"") + 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    return archives.mapInArrow(read, _PART)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, segments of every record that holds or names a payload.

    Archives are read once. Whole records are decoded where they are read; segments are shuffled by origin, and a group is one
    record, so it is as large as one payload. Missing or doubled segments, a wrong total length, broken framing, a wrong
    digest, or a revisit whose length or digest isn't that of the page it refers to raise ValueError by the time this returns.
    Archives of other writers may lack the page's id, the length of a revisit and its page (null then), give digests in hex or
    base32 or none, fold headers, and hold records of other kinds, which are passed over. No archives give no rows.
    """
    archives = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    given = [F.max(f.name).alias(f.name) for f in _PART.fields if f.name not in ("origin", "no", "block")]
    parts = F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "block")))).alias("parts")
    joined = _scan(archives).groupBy("origin").agg(*given, parts)
    kind = to_arrow_schema(_RESULT)

    def assemble(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(at, 64).to_pylist():
                    if not r["parts"]:
                        out.append({f.name: r[f.name] for f in _RESULT.fields})
                        continue
                    block = b"".join(x["block"] for x in r["parts"])
                    if [x["no"] for x in r["parts"]] != list(range(1, len(r["parts"]) + 1)) or r["total"] != len(block):
                        raise ValueError(f"record {r['origin']}: segments are missing, doubled or of a wrong total length")
                    out.append(_decoded(r["page_id"], r["digest"], r["http"], block, len(r["parts"])))
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    out = cut(joined.mapInArrow(assemble, _RESULT))
    extent = lambda c: [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    asked = out.where("record_type = 'revisit' AND refers_to IS NOT NULL").groupBy("refers_to").agg(*extent("payload_bytes"), *extent("payload_digest"))
    there = out.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("n"), F.max("payload_digest").alias("d"))
    wrong = asked.join(there, "refers_to").where("lo_payload_bytes != n OR hi_payload_bytes != n OR lo_payload_digest != d OR hi_payload_digest != d").limit(1).collect()
    if wrong:
        raise ValueError(f"a revisit of page {wrong[0]['refers_to']} differs from it")
    return out
