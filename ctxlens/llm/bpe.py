"""Byte-level BPE over Arrow batches.

Ids come from the ``tokenizers`` library. Byte-level BPE treats every pre-token by itself, so a
worker asks the library once for each distinct pre-token and keeps the answer in a memo that is bounded in
entries and bytes; a text is then a join of memo entries. Only the byte-level pattern is spelled out below; texts under any
other pattern, outside the code points that it covers, or with special strings go to the library whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Code points up to U+024F by class, as the splitting pattern sees them (fixed values).
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
#: Runs of letters come first, being the most frequent; nothing else can match where they do.
_SPLIT = re.compile(
    f" ?[{_LETTER}]+| ?[{_NUMBER}]+"
    "|'s|'t|'re|'ve|'m|'ll|'d"
    f"| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_PLAIN = re.compile("[\0-ɏ]*")
assert array("I").itemsize == 4 and sys.byteorder == "little"  # of what array() packs
#: Distinct pre-tokens that a worker remembers; reaching it empties the memo. Longer ones than MEMO_CHARS are asked for each time.
MEMO, MEMO_CHARS = 200_000, 64
#: The pattern that _SPLIT spells out (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others get code points from 256 up, in byte order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


def _left_first(splits: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Order the splits of one token so that of two overlapping occurrences the left one merges first.

    Splits (x, m) and (m, y) of the same token can meet in a text as x|m|y. A rank merge takes
    the left pair, so (x, m) has to come before (m, y); the order is otherwise free.
    """
    left = {a: (a, b) for a, b in splits}
    done: dict[tuple[bytes, bytes], None] = {}

    def visit(pair: tuple[bytes, bytes], path: frozenset) -> None:
        if pair in done or pair in path:
            return
        for other in splits:  # those that must come before
            if other[1] == pair[0] and left.get(pair[0]) == pair and other != pair:
                visit(other, path | {pair})
        done[pair] = None

    for pair in sorted(splits, key=lambda p: -len(p[0])):
        visit(pair, frozenset())
    return list(done)


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` BPE that gives the ids of a rank file: id = rank, merges in rank order; text outside all matches has none."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    name = lambda b: "".join(chars[x] for x in b)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda kv: kv[1]):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name(a), name(b)) for a, b in _left_first(splits)]
    tok = Tokenizer(models.BPE(vocab={name(b): r for b, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tok.decoder = decoders.ByteLevel()
    return tok


class Memo(dict):
    """Pre-token -> its ids as bytes; a missing one is asked of the library's BPE model."""

    def __init__(self, tok):
        super().__init__()
        self.bpe, self.chars = tok.model.tokenize, dict(enumerate(byte_chars()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        long = len(word) > MEMO_CHARS
        if word.isascii() and word.isprintable():
            name = word.replace(" ", self.chars[32])
        else:
            name = word.encode().decode("latin-1").translate(self.chars)
        ids = array("I", [t.id for t in self.bpe(name)]).tobytes()
        if not long:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts with one tokenizer.

    ``memo_ok`` says that the tokenizer splits by the byte-level pattern and neither normalises
    nor post-processes, so that pre-tokens may be remembered; otherwise every text goes to the
    library whole.
    """

    def __init__(self, tok, memo_ok: bool, special: Iterable[str] = ()):
        self.tok, self.memo_ok, self.special = tok, memo_ok, [s for s in special if s]
        self.memo = Memo(tok) if memo_ok else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for t in texts:
            if self.memo_ok and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                yield b"".join(map(self.memo.__getitem__, _SPLIT.findall(t)))
            else:
                yield self._whole(t)


class Decoder:
    """Ids back to bytes by the reversed byte table; a character split over tokens comes out whole."""

    def __init__(self, tok):
        back = {c: b for b, c in enumerate(byte_chars())}
        size = tok.get_vocab_size(with_added_tokens=True)
        self.table: list[bytes] = []
        for i in range(size):
            piece = tok.id_to_token(i)
            try:
                self.table.append(bytes(back[c] for c in piece or ""))
            except KeyError:  # an added token, whose text is not byte-mapped
                self.table.append(piece.encode())

        self.sizes = np.array([len(t) for t in self.table], "i8")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(start, end) of each token in code points of the text, whose bytes are ``raw``, and how many tokens hold part of a character.

        Byte places are running sums of the tokens' sizes; the byte-to-character map counts the bytes that begin a
        character. Tokens that share a character have its span.
        """
        end = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        if len(end) and end[-1] != len(raw):
            raise ValueError("ids and text differ")
        start = end - self.sizes[np.frombuffer(ids, "<u4")]
        begins = (np.frombuffer(raw, "u1") & 0xC0) != 0x80
        char = np.cumsum(begins) - 1
        edge = np.append(begins, True)
        return char[start], char[end - 1] + 1, int((~edge[start] | ~edge[end]).sum())


def _settle() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task


@lru_cache(maxsize=4)
def json_encoder(path: str) -> Encoder:
    """Encoder of a tokenizers JSON file, once per Python worker."""
    _settle()
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    memo_ok = (
        not spec.get("normalizer")
        and spec.get("post_processor") in (None, {})
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not model.get("dropout")
    )
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return Encoder(tok, memo_ok, [t["content"] for t in spec.get("added_tokens", [])])


@lru_cache(maxsize=4)
def ranks_encoder(path: str, pattern: str) -> Encoder:
    """Encoder of a rank file, once per Python worker. Only under the pattern that is spelled out here are pre-tokens remembered."""
    _settle()
    return Encoder(tokenizer_of_ranks(read_ranks(path), pattern), pattern == BYTE_LEVEL)


@lru_cache(maxsize=4)
def json_decoder(path: str) -> Decoder:
    return Decoder(json_encoder(path).tok)


@lru_cache(maxsize=4)
def ranks_decoder(path: str, pattern: str) -> Decoder:
    return Decoder(ranks_encoder(path, pattern).tok)


def file_digest(path: str, *more: str) -> str:
    """Version of a tokenizer: digest of its file, its library's version and options."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    for m in more:
        h.update(b"\0" + m.encode())
    return h.hexdigest()
