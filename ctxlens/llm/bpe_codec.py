"""Byte-level BPE encoding and decoding of documents (operator 10)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import json_decoder, json_encoder, ranks_decoder, ranks_encoder
from .common import map_text


def _encoder(path: str, pattern: str | None):
    return json_encoder(path) if pattern is None else ranks_encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens``; null and empty texts give no ids.

    ``pattern`` None: ``path`` is a tokenizers JSON file; otherwise a rank file split by ``pattern``.
    No shuffle; rows are independent, so repeated rows and ties need no rule.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]

    def make():
        import numpy as np
        import pyarrow as pa

        enc = _encoder(path, pattern)

        def f(texts):
            ids = [np.frombuffer(b, "<u4") for b in enc.encode(texts)]
            ends = np.cumsum([0] + [len(x) for x in ids])
            flat = np.concatenate(ids).astype("i4") if ids else np.zeros(0, "i4")
            item = pa.field("element", pa.int32(), False)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), type=pa.list_(item)), np.diff(ends).tolist()]

        return f

    return map_text(docs, make, fields, keep or docs.columns, text)


def token_offsets(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``tokens``: array of (id, start, end) in code points; parts of a split character share its span.

    For byte-level vocabularies that encode a text without loss. Null and empty texts have none.
    """
    import numpy as np

    item = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("id", "start", "end")])
    fields = [T.StructField("tokens", T.ArrayType(item, False))]

    def make():
        enc, dec = _encoder(path, pattern), json_decoder(path) if pattern is None else ranks_decoder(path, pattern)

        def one(t, ids):
            start, end, _ = dec.offsets(ids, t.encode())
            return [{"id": i, "start": a, "end": b} for i, a, b in zip(np.frombuffer(ids, "<u4").tolist(), start.tolist(), end.tolist(), strict=True)]

        return lambda texts: [[one(t, ids) for t, ids in zip(texts, enc.encode(texts), strict=True)]]

    return map_text(docs, make, fields, keep or docs.columns, text)


def codec_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids again, maps tokens to characters, and gives digests with ``round_trip``.

    ids_sha256 covers the ids as little-endian unsigned 32-bit integers; decoded_sha256 the decoded
    bytes; offsets_sha256 the starts, then the ends, of the tokens in code points, likewise as 32-bit integers (null if the
    pattern leaves out a part of the text); n_split counts tokens that hold part of a character. Null texts count as
    empty; ``keep`` columns that have a computed name are replaced; rows are independent, so repeats and ties need no rule.
    ``ids``: also the ids themselves.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
        T.StructField("n_split", T.LongType()),
        T.StructField("offsets_sha256", T.StringType()),
    ]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def make():
        import numpy as np

        enc, dec = ranks_encoder(path, pattern), ranks_decoder(path, pattern)

        def f(texts):
            rows = []
            for t, packed in zip(texts, enc.encode(texts), strict=True):
                raw, back = t.encode(), dec.decode(packed)
                split, spans = None, None
                if back == raw:
                    start, end, split = dec.offsets(packed, raw)
                    spans = hashlib.sha256(start.astype("<u4").tobytes() + end.astype("<u4").tobytes()).hexdigest()
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw, split, spans)
                rows.append((*row, np.frombuffer(packed, "<i4")) if ids else row)
            return [list(c) for c in zip(*rows, strict=True)]

        return f

    return map_text(docs, make, fields, keep or docs.columns, text)
