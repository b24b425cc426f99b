"""Alignment of the tokens that two tokenizers make of the same texts (operator 12), with relations.

A byte-level BPE (A) and a SentencePiece model (B) encode each text in Arrow batches. The tokens' ends are running sums of their bytes; the tokens
of both are exploded with their places and ends, and an equi-join on document and end finds where both end. The running count of these cuts before a
token numbers its group (in Arrow batches). A link's weight is how often its pair of ids is linked in the whole corpus.

Everything between the exchange by document and a document's row keeps that partitioning, so tokens are shuffled once, as arrays of their ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _LETTER, _NUMBER, _SPLIT, Memo, byte_chars, json_encoder
from .common import fresh_dir, small, split_join

#: Texts are cut where a space follows something else than white space: neither tokenizer joins what stands on both sides.
PIECE = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?:\s+\Z)?")
_OTHER = f"[^ \\t\\n{_LETTER}{_NUMBER}]+(?:(?<=')[{_LETTER}]+)?"
_WORD = f"[{_LETTER}]+|[{_NUMBER}]+|{_OTHER}"
#: Smaller pieces, for texts of FINE code points: runs of letters, digits or other signs with a space before, and white space as A splits it.
#: An apostrophe stays with the letters after it, and two and more spaces with the word after them.
UNIT = re.compile(f" ?(?:{_WORD})|[ \\t\\n]+(?=[\\t\\n][^ \\t\\n])|[\\t\\n](?=[^ \\t\\n])|[ \\t\\n]*[\\t\\n](?= [^ \\t\\n])|[ \\t\\n]+\\Z|[ \\t\\n]+(?:{_WORD})")
FINE = re.compile("[\\t\\n -~¡-ɏ]*")
#: Places inside a piece of B's vocabulary where UNIT may split, and how many such pieces are looked for in each text.
CROSSING, CROSSINGS = re.compile(f"[\\t\\n]|[{_LETTER}][^ {_LETTER}]|[{_NUMBER}][^ {_NUMBER}]|[^ {_LETTER}{_NUMBER}][{_LETTER}{_NUMBER}]"), 8
#: Pieces that a worker remembers, and their characters in all; reaching either forgets them.
MEMO, MEMO_CHARS = 300_000, 5_000_000
#: Bytes of text for each partition of tokens: some 1.5 million tokens of both kinds.
PARTITION_BYTES = 2 << 20
#: Up to so many linked pairs of ids are broadcast with their counts.
PAIRS = 500_000
#: Tokens that are laid out at once in Arrow batches after the exchange, more only if one document has them.
CHUNK = 1 << 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def a_table(tok) -> list[bytes]:
    """Bytes of each id of a byte-level BPE."""
    back = {c: b for b, c in enumerate(byte_chars())}
    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
    return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


def b_table(sp) -> list[bytes]:
    """Bytes of each id of a SentencePiece model: U+2581 is a space, <0xHH> the byte HH."""
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]


class Numbers(dict):
    """Piece -> its number, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Pair:
    """Both tokenizers over whole texts, by pieces; each distinct piece is encoded once while it is remembered.

    Whether pieces may stand for texts is seen from the models: A splits by the byte-level pattern, and no piece of B's vocabulary has
    a space after something else than white space. Otherwise texts are encoded whole. Units (smaller pieces) may stand for a text if no piece
    of B's vocabulary that holds a place between units is in it.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        enc = json_encoder(a_path)
        self.a, self.sp = type(enc.tok).from_str(enc.tok.to_str()), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.bytes_a, self.bytes_b = a_table(self.a), b_table(self.sp)
        self.size_a, self.size_b = (np.array([len(t) for t in table], "i8") for table in (self.bytes_a, self.bytes_b))
        self.by_piece = enc.memo_ok and not any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in self.bytes_b)
        shown = [t.decode("utf-8", "replace") for i, t in enumerate(self.bytes_b) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.crossing = [t for t in shown if CROSSING.search(t) and FINE.fullmatch(t)]
        self.crossing += [t.content for t in self.a.get_added_tokens_decoder().values() if not t.special]
        self.line = self.sp.encode("\n")
        kept = all(b"".join(map(self.bytes_b.__getitem__, self.sp.encode(x))) == b" " + x.encode() for x in ("\n", "\t"))
        self.by_unit = self.by_piece and kept and len(self.crossing) <= CROSSINGS and not any(x in t for t in self.crossing for x in "\t\n")
        self.words = Memo(self.a) if self.by_unit else None
        self.forget()

    def forget(self) -> None:
        """ids holds those of all pieces; of A and of B, begins and counts say where a piece's are; differ, which pieces' bytes differ."""
        self.memo, self.chars, self.ids, self.differ = Numbers(), 0, array("I"), bytearray()
        self.begins, self.counts = (array("q"), array("q")), (array("q"), array("q"))

    def _encode(self, pieces: list[str]) -> None:
        """Adds pieces' ids by both. Pieces that don't begin with the space that B adds, to more than nothing, are encoded after a line feed."""
        added = [p[0] == " " and len(p) > 1 for p in pieces]
        if self.by_unit and FINE.fullmatch("".join(pieces)):
            ours = [array("I", b"".join(map(self.words.__getitem__, _SPLIT.findall(p)))) for p in pieces]
            self.words.clear()
        else:
            ours = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        theirs, line = self.sp.encode([p[1:] if x else f"\n{p}" for p, x in zip(pieces, added, strict=True)], num_threads=1), len(self.line)
        for i in [i for i, x in enumerate(added) if not x]:
            if theirs[i][:line] != self.line:
                raise ValueError("a line feed is joined with what follows")
            theirs[i] = theirs[i][line:]
        raw, differ = [p.encode() for p in pieces], np.zeros(len(pieces), bool)
        n_bytes = np.fromiter(map(len, raw), "i8")
        for side, (of, table, size) in enumerate(((ours, self.bytes_a, self.size_a), (theirs, self.bytes_b, self.size_b))):
            counts, flat = np.fromiter(map(len, of), "i8"), np.fromiter(chain.from_iterable(of), "u4")
            ends = np.cumsum(counts)
            sizes = np.diff(np.append(0, np.cumsum(size[flat]))[np.append(0, ends)])
            if (sizes != n_bytes).any() or b"".join(map(table.__getitem__, flat.tolist())) != b"".join(raw):
                differ |= [b"".join(map(table.__getitem__, ids)) != r for ids, r in zip(of, raw, strict=True)]
            self.begins[side].frombytes((ends - counts + len(self.ids)).tobytes())
            self.counts[side].frombytes(counts.tobytes())
            self.ids.frombytes(flat.tobytes())
        self.differ += differ.tobytes()
        self.chars += sum(map(len, pieces))

    def split(self, text: str) -> list[str]:
        text = f" {text}"
        if self.by_unit and FINE.fullmatch(text) and not any(x in text for x in self.crossing):
            return UNIT.findall(text)
        return PIECE.findall(text) if self.by_piece else [text]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids of A and of B; none for empty texts and those whose bytes differ."""
        parts, known = [self.split(t) if t else [] for t in texts], len(self.memo)
        numbers = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), "i8")
        if not len(numbers):
            return [(np.array([], "u4"),) * 2] * len(texts)
        if len(self.memo) > known:
            self._encode(list(islice(self.memo, known, None)))
        at = np.cumsum([0] + [len(ps) for ps in parts])
        wrong = np.append(0, np.cumsum(np.frombuffer(self.differ, bool)[numbers]))[at]  # the arrays can't grow while views of them are kept
        sides = []
        for begins, counts in zip(self.begins, self.counts, strict=True):
            n = np.frombuffer(counts, "i8")[numbers]
            to = np.cumsum(n)
            mine = np.frombuffer(self.ids, "u4")[np.repeat(np.frombuffer(begins, "i8")[numbers] - to + n, n) + np.arange(to[-1])]
            cut = np.append(0, to)[at]
            sides.append([mine[x:y] if same else mine[:0] for x, y, same in zip(cut, cut[1:], wrong[1:] == wrong[:-1], strict=False)])
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        return list(zip(*sides, strict=True))


@lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def encode_both(docs: DataFrame, a_path: str, b_path: str, wide: bool, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, keep, n_a, tokens, low_a, high_a, low_b, high_b): A's ids and then B's, 32768 less if they fit two bytes (not ``wide``); ``key`` is one of the row's own.

    Ends of tokens are running sums of their bytes. The last eight bits (low, signed) are apart from those above (high), which hardly change and so take little room in an exchange.
    """
    keep = docs.columns if keep is None else keep
    src = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(c) for c in keep]).alias("keep"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind, least = (T.IntegerType(), 0) if wide else (T.ShortType(), 32768)
    kinds = [("tokens", kind), ("low_a", T.ByteType()), ("high_a", T.IntegerType()), ("low_b", T.ByteType()), ("high_b", T.IntegerType())]
    schema = T.StructType([src.schema["key"], src.schema["keep"], T.StructField("n_a", T.IntegerType()), *[T.StructField(c, T.ArrayType(of)) for c, of in kinds]])

    def lists(parts: list[np.ndarray], values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32()), pa.array(values))

    def run(batches):
        both = pair(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = both.encode(part.column(2).to_pylist())
                flat = [np.concatenate(x) for x in ids]
                columns = [lists(flat, (np.concatenate(flat).astype("i8") - least).astype("i4" if wide else "i2"))]
                for size, own in zip((both.size_a, both.size_b), zip(*ids, strict=True), strict=True):
                    ends = np.concatenate([np.cumsum(size[x]) for x in own])
                    columns += [lists(own, ends.astype("i1")), lists(own, (ends >> 8).astype("i4"))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(a) for a, _ in ids], pa.int32()), *columns], schema.names)

    return src.mapInArrow(run, schema)


@contextmanager
def co_partitioned(spark: SparkSession):
    """While it holds, a join whose sides are partitioned by some of its keys isn't shuffled again by all of them, and sorted rows are aggregated in their order."""
    names = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chunks(n_a: pa.Array, tokens: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in chunks of some CHUNK tokens: first, end, the numbers of tokens of A and of B in turn, where each document's tokens begin and end, ids."""
    at, n_a = np.cumsum([0, *tokens.value_lengths().to_pylist()]), n_a.to_numpy().astype("i8")
    flat, first = tokens.flatten(), 0
    while first < len(n_a):
        end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        ids = flat[at[first] : at[end]].to_numpy().astype("i4") + least
        mine = n_a[first:end]
        yield first, end, np.stack([mine, np.diff(at[first : end + 1]) - mine], 1).ravel(), at[first : end + 1] - at[first], ids
        first = end


def is_side(counts: np.ndarray, side: int) -> np.ndarray:
    """Which tokens are of a side, from the numbers of tokens of A and of B in turn."""
    return np.repeat(np.arange(len(counts)) % 2 == side, counts)


def tokens_of(encoded: DataFrame, side: str) -> DataFrame:
    """(key, place, end) of every token of side a or b: its place among its document's, under the side's name, and its end in bytes.

    Documents without tokens have a row of nulls, since the filter that Spark derives from posexplode() would part the exchanges.
    """
    end = F.shiftleft(F.col("high"), 8).bitwiseOR(F.col("low").cast("int").bitwiseAND(F.lit(255)))
    tokens = encoded.select("key", F.col(f"high_{side}").alias("highs"), F.posexplode_outer(whole(f"low_{side}")).alias(side, "low"))
    return tokens.select("key", side, F.col("highs")[F.col(side)].alias("high"), "low").select("key", side, end.alias("end"))


def whole(column: str) -> Column:
    """A column of encode_both()'s, with all others named without any effect: those who read its exchange need the same columns, and so share it."""
    named = F.xxhash64("key", "keep", "n_a", *[F.size(c) for c in ("tokens", "low_a", "high_a", "low_b", "high_b")])
    return F.when(named.bitwiseAND(F.lit(0)) == 0, F.col(column))


def linked(encoded: DataFrame) -> DataFrame:
    """(key, end, a, b): the places of a token of A and one of B of the same document that end at the same byte."""
    return tokens_of(encoded, "a").join(tokens_of(encoded, "b"), ["key", "end"])


@lru_cache(maxsize=1)
def signed(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below n before each sign (within a side of a group, between its sides, between groups) as eight bytes, and their lengths without the zeros behind."""
    if n > 10_000_000:
        raise ValueError("ids of more than seven digits")
    names = np.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(n)], "S8")
    return names.view("u8"), np.char.str_len(names)


def grouped(n_ids: tuple[int, int], least: int):
    """UDF: from a document's n_a, tokens and links to n_groups, groups_sha256 and the distinct pairs with their times.

    A link is the places of its two tokens in one number. Tokens have a byte at least, so each end is a side's only one, and each link a cut.
    """
    n = max(n_ids)

    @F.arrow_udf("n_groups long, groups_sha256 string, pairs array<struct<pair: long, times: long>>")
    def f(n_a: pa.Array, tokens: pa.Array, links: pa.Array) -> pa.Array:
        names, widths = signed(n)
        lengths, flat, begun = np.array(links.value_lengths().fill_null(0).to_pylist(), "i8"), links.flatten(), 0
        digests, pairs, times, distinct = [], [np.array([], "i8")], [np.array([], "i8")], [np.array([0])]
        for first, end, counts, at, ids in chunks(n_a, tokens, least):
            document = np.repeat(np.arange(end - first), lengths[first:end])
            link = flat[begun : begun + len(document)].to_numpy()
            begun += len(document)
            a = at[document] + (link >> 32)
            b = at[document] + counts[::2][document] + (link & 0xFFFFFFFF)
            # a token's group is the running count of its side's cuts before it; within a group A's tokens come first
            place = np.empty(len(ids), "i8")
            for side, last in enumerate((a, b)):
                cut, mine = np.zeros(len(ids), "i8"), is_side(counts, side)
                cut[last] = 1
                cut = cut[mine]
                place[mine] = 2 * (np.cumsum(cut) - cut) + side
            order = np.argsort(place, kind="stable")
            place = place[order]
            sign = np.where(np.diff(place, append=-1) == 0, 0, 1 + place % 2)
            code = ids[order] + n * sign
            text = names[code].view("u1")
            text = text[text != 0]
            ends = np.append(0, np.cumsum(widths[code]))[at].tolist()
            digests += [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]
            whole, number = np.unique((document * n_ids[0] + ids[a]) * n_ids[1] + ids[b], return_counts=True)
            whole, mine_b = np.divmod(whole, n_ids[1])
            of, mine_a = np.divmod(whole, n_ids[0])
            pairs.append(mine_a << 32 | mine_b)
            times.append(number)
            distinct.append(np.bincount(of, minlength=end - first))
        at = pa.array(np.cumsum(np.concatenate(distinct)), pa.int32())
        inner = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], ["pair", "times"])
        return pa.StructArray.from_arrays([pa.array(lengths), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, inner)], ["n_groups", "groups_sha256", "pairs"])

    return f


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, beside the ``keep`` columns (default doc_id).

    Links are pairs of a token of A and one of B that end at the same byte. A link's count is how many links of the corpus have its ids;
    n_best counts the links whose count is the highest of their B id, ties included. Null and empty texts, and those whose tokens don't
    give back space + text, have no tokens: zeros and ''. Repeated rows count as often as they stand there; an empty table gives no rows;
    ``keep`` columns that have a computed name are replaced.
    """
    spark = docs.sparkSession
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    keep = [c for c in (keep or ["doc_id"]) if c not in out]
    both = Pair(a_path, b_path)
    wide = max(len(both.bytes_a), len(both.bytes_b)) > 65_536
    least = 0 if wide else 32768
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION_BYTES))
    # sorted as documents, tokens are in order already when they are sorted for the join
    encoded = encode_both(docs, a_path, b_path, wide, text, keep).repartition(parts, "key").sortWithinPartitions("key")
    links = linked(encoded).groupBy("key").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("links"))
    met = encoded.join(links, "key", "left").select("key", "keep", "n_a", F.size("tokens").alias("n"), grouped((len(both.bytes_a), len(both.bytes_b)), least)(whole("n_a"), "tokens", "links").alias("made"))
    folder = fresh_dir(spark, "aligned")
    with co_partitioned(spark):
        met.select("key", "keep", F.col("n_a").cast("long").alias("n_a"), (F.col("n") - F.col("n_a")).cast("long").alias("n_b"), "made.*").write.option("compression", "zstd").parquet(folder)
    done = spark.read.parquet(folder)
    per_pair = done.select("key", F.inline("pairs"))
    counts = per_pair.groupBy("pair").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("documents"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    folder = fresh_dir(spark, "aligned-pairs")
    counts.select("pair", "n", "documents", b_id.alias("b")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "documents")
    if small(counts, PAIRS):
        weighed = per_pair.join(F.broadcast(counts), "pair")
    else:
        weighed = split_join(per_pair, counts, ["pair"], "documents", counts.agg(F.sum("documents")).first()[0] or 0, ["key"])
    sums = weighed.groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = done.select("key", "keep", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "key", "left")
    return joined.select(*[F.col("keep")[c].alias(c) for c in keep], "n_a", "n_b", "n_groups", *map(zero, ("n_links", "n_best", "count_sum")), "groups_sha256")
