"""Secret scans with a recursive decoding worklist (operator 5).

A document's text is the first layer. Each layer is scanned; URL escapes, Unicode escapes, base64
runs (broken into lines or not, whatever stands before them) and compressed payloads in it give further layers, until none is
new (a layer already seen for the same place is a cycle and is left). A finding in a layer is mapped to the code points
of the document that it came from. Unpacked payloads are read block by block, so that no size is too large.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

#: Kinds in the order that breaks ties of equal starts (fixed values, as are the patterns).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: A first alternative stands for an escape of an escape sign, escaped again and again (CHAIN times or more): each layer halves it, as the
#: layers between differ in nothing else there.
CHAIN = 8
URL = re.compile(rf"%(?P<chain>(?:25){{{CHAIN},}})|(?:%[0-9A-Fa-f]{{2}})+")
URL_PLUS = re.compile(rf"%(?P<chain>(?:25){{{CHAIN},}})|(?:%[0-9A-Fa-f]{{2}})+|\+")
UNICODE = re.compile(rf"\\(?P<u>(?:u005[cC]){{{CHAIN},}})|\\(?P<x>(?:x5[cC]){{{CHAIN},}})|&(?P<d>(?:#38;){{{CHAIN},}})|&(?P<h>(?:#x26;){{{CHAIN},}})|" r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Two lines and more of base64 characters, and one line's; lines may be indented or quoted.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*\r?\n[ \t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Bytes of an unpacked payload that are looked at together, and how many of them the next block repeats: a finding or a payload inside
#: that is longer is looked at in parts.
BLOCK, OVERLAP = 64 << 20, 16 << 20


class Tried:
    """Payloads already unpacked, by place: layers hold copies of one another."""

    def __init__(self):
        self.keys = set()

    def new(self, raw: bytes, place: tuple[int, int]) -> bool:
        key = hashlib.sha256(raw).digest(), place
        met = key in self.keys
        self.keys.add(key)
        return not met


class Places:
    """Where the code points of a layer come from, as runs: point at[i] + k comes from the ``step[i]`` points from src[i] + k * step[i] on."""

    def __init__(self):
        self.at, self.src, self.step, self.size = array("q"), array("q"), array("q"), 0

    def add(self, n: int, src: int, step: int) -> None:
        if not self.at or self.step[-1] != step or self.src[-1] + (self.size - self.at[-1]) * step != src:
            self.at.append(self.size)
            self.src.append(src)
            self.step.append(step)
        self.size += n

    def place(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(self.at, a) - 1, bisect.bisect_right(self.at, b - 1) - 1
        return self.src[i] + (a - self.at[i]) * self.step[i], self.src[j] + (b - self.at[j]) * self.step[j]

    def follow(self, n: int, start: int, step: int, out: Places) -> None:
        """Adds to ``out`` n points that come from ``step`` points of this layer each, from ``start`` on."""
        while n > 0:
            i = bisect.bisect_right(self.at, start) - 1
            end = self.at[i + 1] if i + 1 < len(self.at) else self.size
            m = min(n, (end - start) // step)
            if m:
                out.add(m, self.src[i] + (start - self.at[i]) * self.step[i], self.step[i] * step)
            else:  # a point that comes from several runs
                m = 1
                s, e = self.place(start, start + step)
                out.add(1, s, e - s)
            n, start = n - m, start + m * step


@dataclass
class Layer:
    """text; spans None: the document itself; a pair: all of it came from one place; else the places of its code points."""

    text: str
    spans: tuple[int, int] | Places | None = None
    plain: bool = True

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.spans is None:
            return a, b
        return self.spans if isinstance(self.spans, tuple) else self.spans.place(a, b)

    def key(self) -> tuple:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), self.place(0, len(self.text))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in one layer. Runs of one class are maximal, so a minimal length can stand in the pattern."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if any(len(w) >= 24 for w in text.split()):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _unescape(layer: Layer, pattern: re.Pattern, chars) -> Layer | None:
    """The layer with every escape replaced; chars(match) gives (text, points before each) runs of even steps, or None."""
    out, at, changed = [], 0, False
    places = None if isinstance(layer.spans, tuple) else Places()

    def add(n: int, start: int, step: int) -> None:
        if places is not None and n:
            places.add(n, start, step) if layer.spans is None else layer.spans.follow(n, start, step, places)

    for m in pattern.finditer(layer.text):
        runs = chars(m)
        if runs is None:
            continue
        out.append(layer.text[at : m.start()])
        add(m.start() - at, at, 1)
        at, changed = m.start(), True
        for text, step in runs:
            out.append(text)
            add(len(text), at, step)
            at += len(text) * step
    if not changed:
        return None
    out.append(layer.text[at:])
    add(len(layer.text) - at, at, 1)
    text = "".join(out)
    return Layer(text, layer.spans if places is None else places) if text else None


def _halved(m: re.Match, chain: str, unit: int) -> list[tuple[str, int]]:
    """A chain of escaped escape signs at half its length: the sign stands for what has gone."""
    left = len(chain) // unit // 2 * unit
    return [(m[0][0], len(m[0]) - left), (chain[:left], 1)]


def _url(m: re.Match) -> list[tuple[str, int]]:
    """Escaped bytes as UTF-8, else as Latin-1; a plus sign is a blank."""
    if m["chain"]:
        return _halved(m, m["chain"], 2)
    if m[0] == "+":
        return [(" ", 1)]
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(text, 3)]
    return [(text, 3)] if len(text) == len(raw) else [(c, 3 * len(c.encode())) for c in text]


def _unicode(m: re.Match) -> list[tuple[str, int]] | None:
    for name, unit in (("u", 5), ("x", 3), ("d", 4), ("h", 5)):
        if m[name]:
            return _halved(m, m[name], unit)
    high, low, *codes, decimal = m.groups()[4:]
    if high:
        return [(chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00), len(m[0]))]
    n = int(decimal) if decimal else int(next(g for g in codes if g), 16)
    return [(chr(n), len(m[0]))] if n < 0x110000 and not 0xD800 <= n < 0xE000 else None


class _Inflate:
    """A zlib object with the interface of bz2's and lzma's decompressors."""

    def __init__(self, wbits: int):
        self.d, self.needs_input = zlib.decompressobj(wbits), True

    def decompress(self, raw: bytes, most: int) -> bytes:
        out = self.d.decompress(self.d.unconsumed_tail + raw, most)
        self.needs_input = not self.d.unconsumed_tail and len(out) < most
        return out

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)


class _Zstd:
    """Zstandard likewise, one frame; a piece's output isn't bounded by ``most`` but by the frame's blocks (128 KB)."""

    needs_input = True

    def __init__(self):
        self.d = zstandard.ZstdDecompressor().decompressobj()

    def decompress(self, raw: bytes, most: int) -> bytes:
        return self.d.decompress(raw) if raw else b""

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)


#: Magic bytes and decompressors of the packed layers, and the bytes fed at once.
PACKED = (
    (b"\x1f\x8b", lambda: _Inflate(31), 1 << 14),
    (b"\x78\x01", lambda: _Inflate(15), 1 << 14),
    (b"\x78\x5e", lambda: _Inflate(15), 1 << 14),
    (b"\x78\x9c", lambda: _Inflate(15), 1 << 14),
    (b"\x78\xda", lambda: _Inflate(15), 1 << 14),
    (b"BZh", bz2.BZ2Decompressor, 1 << 14),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor, 1 << 14),
    (b"\x28\xb5\x2f\xfd", _Zstd, 64),
)
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError)


#: Where a member may start inside other bytes.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")


class Members:
    """What the compressed members of one kind from a place on hold, piece by piece.

    end: where the whole members end. found: whether there is one. broken: whether another follows that breaks off; what comes
    before its fault has been given. ``more`` gives the bytes that come after ``raw``, where that is a block of something longer: a member
    that isn't over at the end of the block goes on there.
    """

    def __init__(self, raw: bytes, at: int = 0, more=None):
        self.raw, self.start, self.more, self.end, self.found, self.broken = raw, at, more, at, False, False

    def again(self) -> Members:
        return Members(self.raw, self.start, self.more)

    def __iter__(self):
        kind = next((k for k in PACKED if self.raw.startswith(k[0], self.end)), None)
        while kind and self.raw.startswith(kind[0], self.end):
            _, make, step = kind
            d, at, got, after = make(), self.end, False, None
            try:
                while not d.eof:
                    if not d.needs_input:
                        piece = b""
                    elif at < len(self.raw):
                        piece, at = self.raw[at : at + step], min(len(self.raw), at + step)
                    elif self.more is not None:
                        after = after or (x[i : i + step] for x in self.more() for i in range(0, len(x), step))
                        if (piece := next(after, None)) is None:
                            break
                    else:
                        break
                    if x := d.decompress(piece, 1 << 20):
                        got = self.found = True
                        yield x
            except _BROKEN:
                pass
            if not d.eof:
                self.broken = got
                return
            self.found = True
            if after is not None:  # it ended beyond this block; what follows it is for the next one
                self.end = len(self.raw)
                return
            self.end = at - len(d.unused_data)


def _blocks(members: Members):
    """(block, more) of what members hold: blocks of BLOCK bytes at most that overlap, and what gives the bytes after one, None after the last."""
    held, upto = bytearray(), 0

    def after(place: int):
        def more():
            at = 0
            for x in members.again():
                if at + len(x) > place:
                    yield x[max(0, place - at) :]
                at += len(x)

        return more

    for x in members:
        held += x
        upto += len(x)
        if len(held) >= BLOCK:
            yield bytes(held), after(upto)
            del held[: len(held) - OVERLAP]
    yield bytes(held), None


#: ASCII text in UTF-16, both byte orders, anywhere in a binary payload.
UTF16 = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){6,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){6,}"))


def _views(raw: bytes):
    """(text, plain) for each way to read bytes as text; plain: they are UTF-8 without control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    if text is not None and not any(c < " " and c not in "\t\n\r\x0b\x0c" for c in text):
        if text:
            yield text, True
        return
    yield raw.decode("latin-1") if text is None else text, False
    if b"\x00" in raw:
        for pattern in UTF16:
            for m in pattern.finditer(raw):
                yield m[0].replace(b"\x00", b"").decode("ascii"), False


def _unpack(raw: bytes, seen: set[bytes], more=None):
    """Views of a payload, through any compressed members in it, at any depth; ``seen``: digests, for payloads that unpack to themselves."""
    todo = [_inside(raw, seen, more)]
    while todo:
        if (x := next(todo[-1], None)) is None:
            todo.pop()
        elif isinstance(x[0], bytes):
            todo.append(_inside(x[0], seen, x[1]))
        else:
            yield x


def _inside(raw: bytes, seen: set[bytes], more=None):
    """Directly in a payload: its views (text, plain), and (bytes, more) for what its members hold."""
    digest = hashlib.sha256(raw).digest()
    if not raw or digest in seen:
        return
    seen.add(digest)
    at = 0
    if any(raw.startswith(k[0]) for k in PACKED):
        first = Members(raw, 0, more)
        yield from _blocks(first)
        at = first.end if first.found else 0
        if at == len(raw):
            return
    rest = raw[at:]
    if at and not first.broken:
        yield rest, more
        return
    yield from _views(rest)
    done = 0
    for m in MAGIC.finditer(rest):
        if m.start() >= max(1, done):
            inner = Members(rest, m.start(), more)
            yield from _blocks(inner)
            done = inner.end if inner.found else done


def _wrapped(text: str):
    """(payload, start, end, alignments) of base64 broken into lines: equal lines, the last may be shorter, the first is any.

    What stands next to the payload may look like a line of it, so the line before is tried with and without, as is the last.
    Only a first line that is longer than the others may have letters before the payload.
    """
    for m in LINES.finditer(text):
        runs = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
        width = [b - a for a, b in runs]
        i = 0
        while i < len(runs):
            j = i
            while j + 1 < len(runs) and width[j + 1] == width[i]:
                j += 1
            last = j + 1 if j + 1 < len(runs) and width[j + 1] < width[i] else j
            for a in {max(0, i - 1), i}:
                for b in {j, last}:
                    joined = "".join(text[x:y] for x, y in runs[a : b + 1])
                    if b > a and len(joined) >= 16:
                        yield joined, runs[a][0], runs[b][1], 4 if a < i and width[a] > width[i] else 1
            i = j + 1


def _base64(layer: Layer, tried: Tried):
    """Payloads of base64 runs. Letters that stand before one belong to the run, so each of the four alignments is decoded."""
    runs = ((m[0], *m.span(), 4) for m in BASE64.finditer(layer.text))
    for run, a, b, alignments in itertools.chain(runs, _wrapped(layer.text) if "\n" in layer.text else ()):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        whole = b - a == len(run) or layer.text[a + len(run) : b].strip("=") == ""
        for skip in range(alignments):
            part = run[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            place = layer.place(a + skip * whole, b)
            if tried.new(raw, place):
                for text, plain in _unpack(raw, set()):
                    yield Layer(text, place, plain)


def _escaped_magic(byte) -> re.Pattern:
    return re.compile("|".join("".join(byte(c) for c in magic) for magic, *_ in PACKED))


def _literal(c: int) -> str:
    return f"|{re.escape(chr(c))}" if 0x20 < c < 0x7F else ""


def _any_case(c: int) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in f"{c:02x}")


#: Escaped bytes: a magic in escaped form, and the tokens of a run (escapes, and the characters that stand for themselves).
BYTES_URL = (
    _escaped_magic(lambda c: f"(?:%{_any_case(c)}{_literal(c)})"),
    re.compile(r"%([0-9A-Fa-f]{2})|[!-$&-~]"),
)
BYTES_CODE = (
    _escaped_magic(lambda c: rf"(?:\\x{_any_case(c)}|\\u00{_any_case(c)}|\\U000000{_any_case(c)}|\\u\{{0{{0,4}}{_any_case(c)}\}}|\\{c:03o}|&\#x0{{0,4}}{_any_case(c)};|&\#0{{0,4}}{c};{_literal(c)})"),
    re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\U000000([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|&#x0{0,4}([0-9A-Fa-f]{1,2});|&#0{0,4}([0-9]{1,3});|\\([0-7]{1,3})|\\([abfnrtv\\'\"/])|[ -\[\]-~]"),
)
_C = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}


def _byte(m: re.Match) -> int:
    """The byte of a token; over 255 (no byte) never unpacks, so it only has to stay one."""
    if not m.lastindex:
        return ord(m[0])
    x = m[m.lastindex]
    if m.re is BYTES_URL[1] or m.lastindex <= 5:
        return int(x, 16)
    return (int(x) if m.lastindex == 6 else int(x, 8) if m.lastindex == 7 else _C.get(x) or ord(x)) & 255


def _bytes(layer: Layer, tried: Tried, magic: re.Pattern, token: re.Pattern):
    """Compressed bytes written as escapes, wherever a magic stands in them."""
    start = end = done = 0
    at, raw = [], b""
    for m in magic.finditer(layer.text):
        if m.start() < done:
            continue
        if m.start() >= end:  # a new run
            start = end = m.start()
            at, made = array("q"), bytearray()
            while t := token.match(layer.text, end):
                at.append(end)
                made.append(_byte(t))
                end = t.end()
            at.append(end)
            raw = bytes(made)
        if end - start == len(raw):  # nothing is escaped
            continue
        i = bisect.bisect_left(at, m.start())
        if i < len(raw) and at[i] == m.start() and tried.new(raw[i:], layer.place(m.start(), end)):
            blocks = _blocks(inner := Members(raw, i))
            first = next(blocks)
            several = any([True for _ in blocks])  # the place is known once all is read
            if not inner.found:
                continue
            to = len(raw) if inner.broken else inner.end
            done = at[to] if not inner.broken else done
            place = layer.place(m.start(), at[to])
            for block, more in itertools.chain([first], itertools.islice(_blocks(inner.again()), 1, None) if several else ()):
                for text, plain in _unpack(block, set(), more):
                    yield Layer(text, place, plain)


def unwrap(layer: Layer, tried: Tried):
    """Layers directly inside a layer."""
    t = layer.text
    if "%" in t:
        if x := _unescape(layer, URL, _url):
            yield x
        if "+" in t and (x := _unescape(layer, URL_PLUS, _url)):
            yield x
        yield from _bytes(layer, tried, *BYTES_URL)
    if "\\" in t or "&#" in t:
        if x := _unescape(layer, UNICODE, _unicode):
            yield x
        yield from _bytes(layer, tried, *BYTES_CODE)
    if any(len(w) >= 16 for w in t.split()) or "\n" in t:
        yield from _base64(layer, tried)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(base spans, spans that only decoded layers show, number of layers).

    A payload that isn't plain text counts as a layer only if it holds something. The worklist holds generators, so
    that of a payload of many blocks one is in memory.
    """
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(scan(text), key=order)
    tried, seen, have, more, layers = Tried(), set(), set(base), set(), 1
    todo = [unwrap(Layer(text), tried)]
    while todo:
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        found = scan(layer.text)
        for kind, a, z in found:
            more.add((kind, *layer.place(a, z)))
        layers += layer.plain or bool(found)
        todo.append(unwrap(layer, tried))
    return base, sorted(more - have, key=order), layers


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with counts of base kinds, base_sha256, spans and n_layers.

    Null and empty texts have no spans. Everything is unwrapped to the fixpoint, however large; a decompression bomb
    costs time, not memory. Rows are independent, so repeats and ties need no rule and an empty table gives no rows; ``keep`` columns
    that have a computed name are replaced. No shuffle.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType())]

    def make():
        def f(texts):
            rows = []
            for t in texts:
                base, more, layers = find(t)
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers))
            return [list(c) for c in zip(*rows, strict=True)]

        return f

    return map_text(docs, make, fields, keep or docs.columns, text)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found place, overlapping ones merged, replaced by ``mark``."""
    base, more, _ = find(text)
    out, at, end = [], 0, 0
    for a, b in sorted(s[1:] for s in base + more):
        if a < end:
            end = max(end, b)
            at = max(at, end)
            continue
        out += [text[at:a], mark]
        at = end = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in the text replaced; a null text becomes empty, other columns stay, repeated rows are treated alike."""
    fields = [T.StructField(text, T.StringType())]
    return map_text(docs, lambda: lambda texts: [[redact(t, mark) for t in texts]], fields, docs.columns, text).select(*docs.columns)
