"""Operator 4: secret scans with a recursive decoding worklist.

Each text starts a worklist.  A layer is scanned for secrets; then percent-escapes,
Unicode and HTML escapes, base64 (also wrapped over lines, and glued to other characters)
and compressed data in any of them are unwrapped into new layers, until nothing new
appears.  Every layer knows which characters of the text its own came from; found secrets
map back by that.  A layer of the same content from the same characters is not followed
again, so that decoding cycles end, while equal content from another place of the text is
a layer of its own.

Escapes of escapes (``%2525...``) could make as many layers as a text has characters.  A layer
differs from the one before only where escapes were unwrapped, so of each further layer only
those places are read, each as far as a secret or a token reaches around it; everything else
stood in an earlier layer as it is.  What follows an escape that is unwrapped once more in
the next layer, and has no new character in it, is the end of what was read before (a run of
base64 in all its phases) and is not read again before that.  This holds for any length and
depth, and the work grows with the escapes that are unwrapped.

Compressed data is read as a stream, whatever it inflates to, and is scanned in chunks; what
may go on in the next chunk (a token, lines of base64, a name and its value) is handed on to
it from its start, however long it is.  All content maps to the token it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import hashlib
import html
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.common import read_table

#: Kinds in the order in which they are listed: pattern, group whose length counts, least length (fixed values).
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: What must be in a text for a kind to match: cheap tests before the patterns.
_LONG_HEX = re.compile(r"[0-9a-f]{32}")
_WORDS = ("passw", "secret", "token", "api")

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot|apos);")
#: The longest escape but runs of percent-escapes, and what escapes begin with.
_LONGEST_ESCAPE, _BEGIN = 12, frozenset("%\\&")
#: The characters of secrets and tokens, and a run of them; no escape begins with one.
_PART = re.compile(r"""[A-Za-z0-9+/_.=\-"':\x20\t\r\n]*""")
_PARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"': \t\r\n")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}+\r?\n[\x20\t]*)+[A-Za-z0-9+/]+={0,2}")
_HEXRUN = re.compile(r"\A[0-9a-f]*\Z|\A[0-9A-F]*\Z")
#: How compressed data begins (gzip, zlib, bzip2, xz, zstandard), as characters below 256.
_MAGIC = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|[(]\xb5/\xfd")
_RAW_RUN = re.compile("[\x00-\xff]+")
#: Stretches of ASCII in UTF-16, of either kind.
_WIDE = re.compile(rb"(?:[\x09-\x7e]\x00){8,}[\x09-\x7e]?")
#: Characters whose escapes may be part of how compressed data begins.
_MARKS = frozenset("\x1f\x8b\x08\x01\x9c\xda\xfd\x00\xb5")
#: Escapes of bytes also as programs print them.
_RAW_ESCAPE = re.compile(_ESCAPE.pattern + r"|\\[nrt\\'\"]")
_PRINTED = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\\\": "\\", "\\'": "'", '\\"': '"'}

#: Without effect: layers are read alike whatever their length.  A test sets it to see that.
LAYERED = 0
#: Inflated data is read and scanned in chunks of this many bytes, more after a long open token; the last bytes are always seen twice.
CHUNK, OVERLAP = 1 << 20, 1 << 14
#: What is open at the end of a chunk, read backwards: a run of base64 or escapes, lines of base64 before it; a name with its value.
_OPEN = re.compile(rb"[A-Za-z0-9+/_=%\\{}&#;.-]*(?:[\x20\t]*\n\r?[A-Za-z0-9+/]{16,})*")
_OPEN_VALUE = re.compile(rb"""[A-Za-z0-9+/_.=-]*["']?\x20*(?:[:=]\x20*)?["']?(?:drowssap|dwssap|terces|nekot|yek_?ipa)""", re.I)

Span = tuple[int, int, str]


def scan(text: str) -> Iterator[Span]:
    """(start, end, kind) of every secret in ``text``, by kind."""
    lowered = None
    for kind, (pattern, group, least) in KINDS.items():
        if kind == "assign":
            lowered = text.lower()
            if not any(w in lowered for w in _WORDS):
                continue
        elif kind == "access" and "AKIA" not in text:
            continue
        elif kind == "hex" and not _LONG_HEX.search(text):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m.start(), m.end(), kind


class Layer:
    """A decoded text.  Its characters came from ``starts`` to ``ends`` of the root, one by
    one, or, if ``ends`` is None, all from the stretch ``starts``; if both are None it is the root."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def where(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the root behind the characters a to b - 1."""
        if self.starts is None:
            return a, b
        return self.starts if self.ends is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def key(self) -> bytes:
        of = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        of.update(repr(self.starts).encode() if self.ends is None else self.starts.tobytes() + self.ends.tobytes())
        return of.digest()


def _text_of(data: bytes) -> str:
    """UTF-8, UTF-16 where every other byte is zero, else one character for each byte."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    if len(data) >= 8 and b"\x00" in data:
        half, even, odd = len(data) // 2, data[::2].count(0), data[1::2].count(0)
        if odd > 0.8 * half and even < 0.2 * half:
            return data.decode("utf-16-le", "replace")
        if even > 0.8 * half and odd < 0.2 * half:
            return data.decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _unescape(token: str) -> str | None:
    """The characters of one escape, or of a run of percent-escapes."""
    if token[0] == "%":
        return _text_of(bytes.fromhex(token.replace("%", "")))
    if token[0] == "&":
        return html.unescape(token)
    if len(token) == 12:  # two halves of one character
        return (chr(int(token[2:6], 16)) + chr(int(token[8:], 16))).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    point = int(token[2:].strip("{}"), 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def _rewritten(layer: Layer, made: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """``layer`` with stretches replaced: (a, b, characters, the stretch behind each)."""
    parts, lows, highs, at = [], [], [], 0
    starts = np.arange(len(layer.text)) if layer.starts is None else layer.starts
    ends = np.arange(1, len(layer.text) + 1) if layer.starts is None else layer.ends
    flat = layer.starts is not None and layer.ends is None
    for a, b, plain, places in [*made, (len(layer.text), len(layer.text), "", [])]:
        parts += [layer.text[at:a], plain]
        if not flat:
            lows += [starts[at:a], np.array([starts[x] for x, _ in places], dtype=np.int64)]
            highs += [ends[at:a], np.array([ends[y - 1] for _, y in places], dtype=np.int64)]
        at = b
    if flat:
        return Layer("".join(parts), layer.starts, None)
    return Layer("".join(parts), np.concatenate(lows).astype(np.int64), np.concatenate(highs).astype(np.int64))


def _opened_escape(token: str) -> tuple[str, list[tuple[int, int]]] | None:
    """What an escape or a run of percent-escapes stands for, and of each of its characters
    the stretch of ``token`` behind it."""
    plain = _unescape(token)
    if plain is None:
        return None
    if token[0] == "%":
        n = len(token) // 3
        sizes = [1] * len(plain) if len(plain) == n else [len(c.encode("utf-8", "surrogatepass")) for c in plain]
        if sum(sizes) == n:
            cuts = [0, *(np.cumsum(sizes) * 3).tolist()]
            return plain, list(zip(cuts[:-1], cuts[1:], strict=True))
    return plain, [(0, len(token))] * len(plain)


class _Unwrapping:
    """The layers under the escapes of a layer, one after the other, in its own cells.

    A cell holds a character of ``text``; what an escape stands for takes its last cells,
    the others are dead.  Cells keep their order, a map leads over the dead ones.  The
    first cell that ever was part of an escape at some place holds what escapes begin with
    in ``text``, so runs of other characters in ``text`` end before it.
    """

    def __init__(self, layer: Layer):
        self.layer, self.text, self.flat = layer, layer.text, layer.starts is not None and layer.ends is None
        self.new: dict[int, str] = {}
        self.place: dict[int, tuple[int, int]] = {}
        self.next: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.touched = bytearray(len(self.text))
        self.back: str | None = None

    def char(self, i: int) -> str:
        return self.new[i] if self.touched[i] else self.text[i]

    def after(self, i: int) -> int:
        return self.next.get(i, i + 1)

    def before(self, i: int) -> int:
        return self.last.get(i, i - 1)

    def where(self, i: int) -> tuple[int, int]:
        return self.place[i] if self.touched[i] else self.layer.where(i, i + 1)

    def unwrap(self, cells, plain: str, places: list[tuple[int, int]]) -> tuple[int, int]:
        """The first and last cell of what takes the place of an escape; the cell before it
        (-1 at the start) twice, if that is nothing."""
        own = cells[len(cells) - len(plain) :]
        if not self.flat:
            spots = [(self.where(cells[x])[0], self.where(cells[y - 1])[1]) for x, y in places]
            self.place.update(zip(own, spots, strict=True))
        for i in cells:
            self.touched[i] = 1
        self.new.update(zip(own, plain, strict=True))
        before, after = self.before(cells[0]), self.after(cells[-1])
        first, last = (own[0], own[-1]) if plain else (after, before)
        self.next[before], self.last[first] = first, before
        self.next[last], self.last[after] = after, last
        return (first, last) if plain else (before, before)

    def escapes(self, changed: list[tuple[int, int]]) -> list[tuple]:
        """The escapes of the layer at hand: each has a place in it that was changed just now."""
        wide: list[list[int]] = []
        n = len(self.text)
        for low, high in changed:
            for _ in range(_LONGEST_ESCAPE):
                low = self.before(low) if low > 0 else low
                high = self.after(high) if high < n - 1 else high
            if wide and low <= wide[-1][1]:
                wide[-1][1] = max(high, wide[-1][1])
            else:
                wide.append([low, high])
        found = []
        for low, high in wide:
            cells, i = [], max(low, self.next.get(-1, 0))
            while i <= high and i < n:
                cells.append(i)
                i = self.after(i)
            text = "".join(map(self.char, cells))
            if not _BEGIN.isdisjoint(text):
                for m in _ESCAPE.finditer(text):
                    if (opened := _opened_escape(m.group())) is not None:
                        found.append((cells[m.start() : m.end()], m.group(), *opened))
        return found

    def around(self, i: int) -> tuple[Layer, int]:
        """The run of characters of secrets and tokens that holds cell ``i``, and its last cell."""
        n, left, right = len(self.text), [], []
        j = self.before(i)
        while j >= 0 and self.char(j) in _PARTS:
            low = j
            if not self.touched[j]:
                self.back = self.text[::-1] if self.back is None else self.back
                low = n - _PART.match(self.back, n - 1 - j).end()
                low = max(low, self.touched.rfind(1, low, j) + 1)
            left.append((low, j + 1))
            j = self.before(low)
        j = end = i
        while j < n and self.char(j) in _PARTS:
            end = j if self.touched[j] else _PART.match(self.text, j).end() - 1
            right.append((j, end + 1))
            j = self.after(end)
        return self.made(left[::-1] + right), end

    def whole(self) -> Layer:
        """The layer at hand."""
        parts, i, n = [], self.next.get(-1, 0), len(self.text)
        while i < n:
            to = i + 1
            if not self.touched[i]:
                to = self.touched.find(1, i)
                to = n if to < 0 else to
            parts.append((i, to))
            i = self.after(to - 1)
        return self.made(parts)

    def made(self, parts: list[tuple[int, int]]) -> Layer:
        """A layer of stretches of cells: one new one each, or others."""
        text = "".join(self.new[a] if self.touched[a] else self.text[a:b] for a, b in parts)
        if self.flat:
            return Layer(text, self.layer.starts)
        starts, ends, at = np.empty(len(text), dtype=np.int64), np.empty(len(text), dtype=np.int64), 0
        for a, b in parts:
            if self.touched[a]:
                starts[at], ends[at] = self.place[a]
            elif self.layer.starts is None:
                starts[at : at + b - a], ends[at : at + b - a] = np.arange(a, b), np.arange(a + 1, b + 1)
            else:
                starts[at : at + b - a], ends[at : at + b - a] = self.layer.starts[a:b], self.layer.ends[a:b]
            at += b - a
        return Layer(text, starts, ends)

    def layers(self) -> Iterator[Layer]:
        """Of all layers under the escapes, and those under these, what the one before has not."""
        n = len(self.text)
        escapes = [(range(*m.span()), m.group(), *opened) for m in _ESCAPE.finditer(self.text) if (opened := _opened_escape(m.group())) is not None]
        while escapes:
            changed = [self.unwrap(cells, plain, places) for cells, _, plain, places in escapes]
            escapes = self.escapes(changed)
            opens = {cells[0] for cells, *_ in escapes}
            done = -1
            for i, last in changed:
                while i <= last:
                    at = i if i >= 0 and self.char(i) in _PARTS else self.after(i)
                    # What follows the beginning of an escape stood there before.
                    if done < at < n and (at == i or i not in opens) and self.char(at) in _PARTS:
                        layer, done = self.around(at)
                        yield layer
                    i = self.after(i)
            if any(not _MARKS.isdisjoint(bytes.fromhex(t.replace("%", "")).decode("latin-1") if t[0] == "%" else plain) for _, t, plain, _ in escapes):
                yield from _raw_layers(self.whole())


class _Zlib(io.RawIOBase):
    """A zlib stream as a file."""

    def __init__(self, source):
        self.source, self.inner, self.left = source, zlib.decompressobj(15), b""

    def readable(self) -> bool:
        return True

    def read1(self, most: int) -> bytes:
        return self.read(most)

    def readinto(self, buffer) -> int:
        while not self.inner.eof:
            data = self.left or self.source.read(1 << 16)
            if not data:
                break
            got = self.inner.decompress(data, len(buffer))
            self.left = self.inner.unconsumed_tail
            if got:
                buffer[: len(got)] = got
                return len(got)
        return 0


def _reader(head: bytes, source):
    """A file of what ``source``, which begins with ``head``, holds compressed (all members
    of it, one after the other); None if it does not look compressed."""
    if head[:3] == b"\x1f\x8b\x08":
        return gzip.GzipFile(fileobj=source)
    if head[:1] == b"x" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return _Zlib(source)
    if head[:3] == b"BZh":
        return bz2.BZ2File(source)
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMAFile(source)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
    return None


def inflated(data: bytes, at: int = 0) -> Iterator[bytes]:
    """The content of the compressed data that begins at ``at``, in chunks; of compressed
    data in it also that, as far down as it goes.  What precedes an error counts; nothing
    if it is not compressed.

    Content of at most a chunk is taken whole, so that nesting needs no stack; content
    that is longer is read as a stream, and compressed data at its beginning as one more.
    """
    seen: set[bytes] = set()
    while True:
        stream = _opened(data, at)
        first = _read(stream, CHUNK) if stream else b""
        mark = hashlib.blake2b(first, digest_size=16).digest()
        if not first or mark in seen:
            return
        seen.add(mark)
        yield first
        if len(first) < CHUNK:
            data, at = first, 0
            continue
        yield from _more(stream, first)
        inner = _reader(first[:6], _opened(data, at))
        if inner is None:
            return
        # Compressed data beyond a chunk is read again, as a stream through both.
        data, at = _read(inner, CHUNK), 0
        if data:
            yield data
        yield from _more(inner, data)


def _opened(data: bytes, at: int):
    source = io.BytesIO(data)
    source.seek(at)
    return _reader(data[at : at + 6], source)


def _length(data: bytes, at: int) -> int:
    """The length of the compressed data at ``at``, all members; what is left where it is cut off."""
    begin = at
    while (made := _machine(data[at : at + 6])) is not None:
        fed = at
        try:
            while not made.eof and fed < len(data):
                made.decompress(data[fed : fed + 256])
                fed += 256
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return len(data) - begin
        if not made.eof:
            return len(data) - begin
        at = min(fed, len(data)) - len(made.unused_data)
    return at - begin


def _machine(head: bytes):
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"x" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _read(stream, most: int) -> bytes:
    parts, n = [], 0
    try:
        while n < most and (part := stream.read1(min(1 << 16, most - n))):
            parts.append(part)
            n += len(part)
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return b"".join(parts)


def _more(stream, before: bytes) -> Iterator[bytes]:
    """The chunks after the first one, each with what of the one before may go on in it.  As
    much is read as is handed on, so that a long token is not read again and again."""
    if len(before) < CHUNK:
        return
    wide = _utf16(before)
    while True:
        held = _narrow(before, wide)
        back = held[::-1]
        value = _OPEN_VALUE.match(back)
        keep = max(OVERLAP, _OPEN.match(back).end(), value.end() if value else 0)
        rest = before[max(0, len(before) - keep * (2 if wide else 1)) :]
        part = _read(stream, max(CHUNK, len(rest)))
        if not part:
            return
        before = rest + part
        yield before


def _utf16(data: bytes) -> str | None:
    """The kind of UTF-16 that ``data`` begins with, as ``_text_of`` tells it."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if data[:1] == b"\xff" else "utf-16-be"
    half, even, odd = len(data) // 2, data[::2].count(0), data[1::2].count(0)
    return "utf-16-le" if odd > 0.8 * half and even < 0.2 * half else "utf-16-be" if even > 0.8 * half and odd < 0.2 * half else None


def _narrow(data: bytes, wide: str | None) -> bytes:
    """``data`` with a byte for each of its ASCII characters, from the end on."""
    return data if not wide else data[len(data) % 2 :].decode(wide, "replace").encode("ascii", "replace")


def _compressed(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, chunk of content) of the compressed data in ``data``, wherever it begins."""
    done = 0
    for m in _MAGIC.finditer(data.decode("latin-1")):
        at = m.start()
        if at < done:
            continue
        for chunk in inflated(data, at):
            if done <= at:
                done = at + _length(data, at)
            yield at, done, chunk


def _decoded(body: str) -> bytes | None:
    """The bytes of base64 without padding; a last character that makes no byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """What runs of base64 stand for.  A run may be glued to what precedes it: it is read
    from each of its first four characters on, as all further beginnings go on as one of those."""
    for m in _BASE64.finditer(layer.text):
        body = m.group().rstrip("=").replace("-", "+").replace("_", "/")
        if _HEXRUN.match(body) or body.isalpha() and (body.islower() or body[1:].islower()):
            continue
        low, high = layer.where(*m.span())
        for phase in range(4):
            if (data := _decoded(body[phase:])) is None:
                continue
            flat = layer.starts is not None and layer.ends is None
            if phase == 0:
                yield Layer(_text_of(data), (low, high))
            elif not flat:
                # What is found from some byte on began with the characters of that byte.
                yield Layer(data.decode("latin-1"), *_quanta(layer, m.start() + phase, 0, len(data), high))
            else:
                yield Layer(data.decode("latin-1"), (low, high))
            for wide in _WIDE.finditer(data) if phase or not _utf16(data) else ():
                of = (low, high) if flat else (int(_quanta(layer, m.start() + phase, wide.start(), 1, high)[0][0]), high)
                yield Layer(wide.group()[::2].decode("latin-1"), of)
            for at, _, chunk in _compressed(data):
                begin = layer.where(m.start() + phase + 4 * (at // 3), m.end())[0] if at or phase else low
                yield Layer(_text_of(chunk), (begin, high))
    if "\n" in layer.text:
        for m in _WRAPPED.finditer(layer.text):
            body, span = re.sub(r"\s+", "", m.group()).rstrip("="), layer.where(*m.span())
            for phase in range(4):
                if (data := _decoded(body[phase:])) is None:
                    continue
                yield Layer(data.decode("latin-1") if phase else _text_of(data), span)
                for wide in _WIDE.finditer(data) if phase or not _utf16(data) else ():
                    yield Layer(wide.group()[::2].decode("latin-1"), span)
                for _, _, chunk in _compressed(data):
                    yield Layer(_text_of(chunk), span)


def _quanta(layer: Layer, at: int, first: int, n: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` decoded bytes from ``first`` on the start of its four characters, and
    the end of the run."""
    place = at + 4 * (np.arange(first, first + n) // 3)
    return (place if layer.starts is None else layer.starts[place]), np.full(n, high)


def _raw_layers(layer: Layer) -> Iterator[Layer]:
    """Compressed data whose bytes are written as escapes, or stand among them as they are."""
    made = []
    for m in _RAW_ESCAPE.finditer(layer.text):
        token = m.group()
        if token[0] == "%":
            made += [(a, a + 3, chr(int(layer.text[a + 1 : a + 3], 16)), [(a, a + 3)]) for a in range(m.start(), m.end(), 3)]
        elif (plain := _PRINTED.get(token) or _unescape(token)) is not None and len(plain) == 1:
            made.append((*m.span(), plain, [m.span()]))
    if not any(x[2] in _MARKS for x in made):
        return
    raw = _rewritten(layer, made)
    for run in _RAW_RUN.finditer(raw.text):
        for a, b, chunk in _compressed(run.group().encode("latin-1")):
            yield Layer(_text_of(chunk), raw.where(run.start() + a, run.start() + b))


def layers(layer: Layer) -> Iterator[Layer]:
    """The layers under one: what its tokens hold, and all that unwrapping its escapes makes."""
    yield from _base64_layers(layer)
    if any(c in layer.text for c in _BEGIN) and _ESCAPE.search(layer.text):
        yield from _raw_layers(layer)
        yield from _Unwrapping(layer).layers()


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans of ``text`` and all spans, either in order of start, kind, end."""
    order = list(KINDS)
    sort = lambda spans: sorted(spans, key=lambda s: (s[0], order.index(s[2]), s[1]))
    base = list(scan(text or ""))
    found, seen = set(base), set()
    work = [layers(Layer(text or ""))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if len(layer.text) < 8 or (key := layer.key()) in seen:
            continue
        seen.add(key)
        found.update((*layer.where(a, b), kind) for a, b, kind in scan(layer.text))
        work.append(layers(layer))
    return sort(base), sort(found)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, spans), one for each row of ``docs``; base and spans are arrays
    of (kind, start, end), in code points of the whole text.

    A null text counts as empty and has no spans; equal rows give equal rows; an empty table
    gives an empty one.  Texts are read whole, whatever their length.  Spans that begin at one
    place are listed by kind, then by end.  Memory per text is a few times its length, and of
    each compressed layer a chunk and what is open at its end.  Further columns are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            both = [find_secrets(t) for t in batch.column(1).to_pylist()]
            rows = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["doc_id", "base", "spans"])

    kind = dict(docs.dtypes)[id_col]
    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, base {item}, spans {item}")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that the contract names, from the spans that the operator returns."""
    from pyspark.sql import functions as F

    found = scan_documents(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_secrets what SQL can tell: the counts and the digest of the base spans."""
    return op4_secrets(spark, sf_dir).drop("spans")


def _base_sql() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    assign = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?"""
    kinds = {"assign": (assign + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{assign}', '')) >= 8"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"), "hex": ("[0-9a-f]+", "length(m) >= 32")}
    kinds = {k: (p.replace("'", "''"), t.replace("\"']?", "\"'']?")) for k, (p, t) in kinds.items()}
    # The text between matches and the matches take turns, so running lengths give the places.
    part = """SELECT doc_id, {n} AS kind_no, '{kind}' AS kind, m, least, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS gap,
        unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i, 0 AS least FROM documents WHERE text IS NOT NULL)"""
    parts = [f"SELECT doc_id, kind_no, kind, (stop - length(m))::bigint AS start, stop::bigint AS stop FROM ({part.format(n=n, kind=kind, pattern=pattern)}) WHERE {test}" for n, (kind, (pattern, test)) in enumerate(kinds.items())]
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS said FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::bigint AS n_assign, coalesce(c, 0)::bigint AS n_access, coalesce(h, 0)::bigint AS n_hex, sha256(coalesce(said, '')) AS base_sha256
FROM documents LEFT JOIN g USING (doc_id)"""


BASE_SQL = _base_sql()
