"""Secrets in texts and in what is encoded inside them.

Each text starts a worklist. A layer is scanned, then everything in it that can
be unwrapped (percent escapes, Unicode escapes, base64, compressed data inside
base64) makes a new layer, until nothing new appears. Every layer knows, for each of its
characters, which characters of the original text it came from, so a secret
found five layers deep still has a span in the text. A layer already seen for
the same part of the text is not unwrapped again, which ends cycles.

Base64 may touch other text of its alphabet, so a run is decoded at each of its four
alignments, and what surrounds a secret need not be text. Bytes are read as Latin-1:
all patterns are ASCII, so none is lost or spans a byte that is no text. Characters of
two or four bytes (UTF-16, UTF-32) are known by the zeros between them. Bytes written as
percent or backslash escapes are opened in the same way.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Kinds in their order, with the pattern of each.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
# Fixed values end.

#: Largest layer that compressed data may unfold to; beyond it the packed data itself is reported.
LAYER_BYTES = 16 << 20
OVERSIZE = "oversize"

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+"
)
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}")
#: The shortest secret has 14 characters, in any encoding.
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{14}")
_MAGIC = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_PACKED = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){13,}[\t\n\r\x20-\x7e]|(?:[\t\n\r\x20-\x7e]\x00{3}){13,}[\t\n\r\x20-\x7e]")
#: Escaped bytes: their mark, the runs they stand in with what is not escaped, and the escapes.
_ESCAPED = (
    ("%", re.compile(r"[!-~]{14,}"), re.compile(r"%([0-9A-Fa-f]{2})")),
    ("\\x", re.compile(r"[ -~]{14,}"), re.compile(r"\\x([0-9A-Fa-f]{2})|\\[0abtnvfr'\"\\]")),
    ("\\u00", re.compile(r"[ -~]{14,}"), re.compile(r"\\u00([0-9A-Fa-f]{2})|\\[btnfr\"\\/]")),
)
_SIMPLE = dict(zip("0abtnvfr", b"\0\a\b\t\n\v\f\r"))


@dataclass
class Layer:
    """A text with, for each character, the span of the original it came from."""

    text: str
    starts: np.ndarray | None  # None: the original itself
    ends: np.ndarray | None
    depth: int
    via: str

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.starts, self.ends


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what the base patterns find, leftmost and without overlaps in each kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]], via: str) -> Layer:
    """The layer with parts replaced; parts: start, end, new text, and the spans of its characters in the layer."""
    starts, ends = layer.spans()
    texts, lows, highs, at = [], [], [], 0
    for start, end, text, low, high in parts:
        texts += [layer.text[at:start], text]
        lows += [starts[at:start], starts[low]]
        highs += [ends[at:start], ends[high - 1]]
        at = end
    texts.append(layer.text[at:])
    lows.append(starts[at:])
    highs.append(ends[at:])
    return Layer("".join(texts), np.concatenate(lows), np.concatenate(highs), layer.depth + 1, f"{layer.via}/{via}")


def _utf8_offsets(text: str) -> np.ndarray:
    """Byte offset of each character, and of the end."""
    widths = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))]).astype(np.int64)


def _percent(layer: Layer) -> Layer | None:
    parts = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m.group().replace("%", ""))
        try:
            text = raw.decode()
            at = _utf8_offsets(text)
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
            at = np.arange(len(raw) + 1)
        parts.append((m.start(), m.end(), text, m.start() + 3 * at[:-1], m.start() + 3 * at[1:]))
    return _replaced(layer, parts, "percent") if parts else None


def _unicode(layer: Layer) -> Layer | None:
    parts = []
    for m in _UNICODE.finditer(layer.text):
        units = []
        for e in _ESCAPE.finditer(m.group()):
            decimal = e.group(6)
            code = int(decimal) if decimal else int(next(g for g in e.groups() if g), 16)
            units.append((code if code <= 0x10FFFF else 0xFFFD, e.start(), e.end()))
        chars, lows, highs, i = [], [], [], 0
        while i < len(units):
            code, low, high = units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
                i += 1
                code, high = 0x10000 + ((code - 0xD800) << 10) + units[i][0] - 0xDC00, units[i][2]
            chars.append(chr(0xFFFD if 0xD800 <= code < 0xE000 else code))
            lows.append(m.start() + low)
            highs.append(m.start() + high)
            i += 1
        parts.append((m.start(), m.end(), "".join(chars), np.array(lows), np.array(highs)))
    return _replaced(layer, parts, "unicode") if parts else None


def _member(data: memoryview, limit: int) -> tuple[bytes, int, bool]:
    """What one compressed stream holds, up to ``limit`` bytes; its length, and whether it has an end.

    Data is fed in pieces, so what follows a stream is not copied.
    """
    head, piece = bytes(data[:6]), 1 << 14
    if head.startswith(b"BZh"):
        reader = bz2.BZ2Decompressor()
    elif head[:1] == b"\xfd":
        reader = lzma.LZMADecompressor()
    elif head[:1] == b"\x28":
        import zstandard

        reader, piece = zstandard.ZstdDecompressor().decompressobj(), 64  # a block of 4 bytes may hold 128 KB
    else:
        reader = zlib.decompressobj(47)
    out, size, at = [], 0, 0
    try:
        while at < len(data) and not reader.eof and size < limit:
            part = bytes(data[at : at + piece])
            more = reader.decompress(part) if piece == 64 else reader.decompress(part, limit - size)
            out.append(more)
            size, at = size + len(more), at + len(part)
    except Exception:  # every library has its own error for data that only looks compressed
        return b"".join(out), len(data), False
    return b"".join(out), at - len(reader.unused_data) if reader.eof else len(data), reader.eof


def _unpack(data: memoryview) -> tuple[bytes, int, int] | None:
    """Decompressed data of the streams that follow each other, the length of those with an end, and of all.

    None if nothing is compressed. Raises OverflowError beyond LAYER_BYTES.
    """
    out, size, at, end = [], 0, 0, 0
    while bytes(data[at : at + 8]).startswith(_MAGIC):
        more, used, ended = _member(data[at:], LAYER_BYTES + 1 - size)
        out.append(more)
        size += len(more)
        if size > LAYER_BYTES:
            raise OverflowError
        if not ended:
            end = len(data)
            break  # cut off, or only looks like a stream: what it covers is opened from its own place too
        at = end = at + used
        while at < len(data) and data[at] == 0:  # padding
            at += 1
    return (b"".join(out), at, end) if size else None


def _decoded(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _inside(data: bytes, via: str, seen: set[bytes], plain: bool = True) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, str]]:
    """(text, first and last byte of each character, via) of what bytes hold; no text: packed data beyond LAYER_BYTES.

    ``plain``: also the bytes themselves. ``seen``: digests of the packed data already opened; data that unfolds to itself is opened once.
    """
    if plain and _PLAIN.search(data):
        at = np.arange(len(data))
        yield data.decode("latin-1"), at, at, via
    for m in _WIDE.finditer(data):
        step = 4 if m.group()[2] == 0 else 2
        at = np.arange(m.start(), m.end(), step)
        yield m.group()[::step].decode("latin-1"), at, np.minimum(at + step, m.end()) - 1, via + "/wide"
    view, done = memoryview(data), 0
    for m in _PACKED.finditer(data):
        start, end = m.start(), len(data)
        if start < done:
            continue  # inside a stream that was read to its end
        try:
            if len(via) > 800:
                raise OverflowError
            got = _unpack(view[start:])
        except OverflowError:
            yield None, np.array([start]), np.array([end - 1]), via + "/compressed"
            continue
        if got is None:
            continue
        more, done, end = got[0], start + got[1], start + got[2]
        digest = hashlib.blake2b(more, digest_size=16).digest()
        if digest in seen:
            continue
        seen.add(digest)
        for text, first, _, inner in _inside(more, via + "/compressed", seen):
            yield text, np.full(len(first), start), np.full(len(first), end - 1), inner


def _layers(layer: Layer, data: bytes, first: np.ndarray, last: np.ndarray, via: str, found: list, plain: bool = True) -> Iterator[Layer]:
    """The layers inside bytes; ``first`` and ``last``: the characters of the layer that each byte came from."""
    starts, ends = layer.spans()
    for text, low, high, inner in _inside(data, via, set(), plain):
        lows, highs = starts[first[low]], ends[last[high]]
        if text is None:
            found.append((OVERSIZE, int(lows.min()), int(highs.max()), f"{layer.via}/{inner}"))
        else:
            yield Layer(text, lows, highs, layer.depth + 1, f"{layer.via}/{inner}")


def _base64(layer: Layer, found: list) -> Iterator[Layer]:
    """The layers inside each run, at each alignment: something of the same alphabet may stand beside the data."""
    runs = [m.span() for m in _BASE64.finditer(layer.text)] + [m.span() for m in _WRAPPED.finditer(layer.text)]
    for start, end in runs:
        raw = layer.text[start:end]
        place = np.arange(start, end)
        if "\n" in raw:
            place = place[~np.isin(np.frombuffer(raw.encode(), dtype=np.uint8), (10, 13))]
            raw = raw.replace("\r", "").replace("\n", "")
        for skip in range(4):
            data = _decoded(raw[skip:])
            if _PLAIN.search(data) or _WIDE.search(data) or _PACKED.search(data):
                at = np.arange(len(data))
                yield from _layers(layer, data, place[skip + at * 8 // 6], place[skip + (at * 8 + 13) // 6 - 1], "base64", found)


def _escaped(layer: Layer, found: list) -> Iterator[Layer]:
    """The layers inside bytes written as escapes; their plain text is found by ``_percent`` and ``_unicode``."""
    for mark, run, token in _ESCAPED:
        if mark not in layer.text:
            continue
        for m in run.finditer(layer.text):
            parts, first, last, at = [], [], [], m.start()
            for t in token.finditer(layer.text, m.start(), m.end()):
                parts += [layer.text[at : t.start()].encode(), bytes([int(t[1], 16) if t[1] else _SIMPLE.get(t[0][1], ord(t[0][1]))])]
                first += [np.arange(at, t.start()), [t.start()]]
                last += [first[-2], [t.end() - 1]]
                at = t.end()
            if not parts:
                continue
            rest = np.arange(at, m.end())
            data = b"".join([*parts, layer.text[at : m.end()].encode()])
            first, last = np.concatenate([*first, rest]).astype(np.int64), np.concatenate([*last, rest]).astype(np.int64)
            ways = [data]
            if mark == "%" and "+" in m.group():  # forms write a space so
                ways.append(b"".join(x.replace(b"+", b" ") if k % 2 == 0 else x for k, x in enumerate([*parts, layer.text[at : m.end()].encode()])))
            for way in ways:
                if _WIDE.search(way) or _PACKED.search(way):
                    yield from _layers(layer, way, first, last, "bytes", found, plain=False)


def scan(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, depth, via) of every secret, by start and kind; depth 0 is the text itself."""
    found: dict[tuple[str, int, int], tuple[int, str]] = {}
    seen: set[tuple[bytes, int, int]] = set()
    work = deque([Layer(text, None, None, 0, "")])
    while work:
        layer = work.popleft()
        if not layer.text:
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in matches(layer.text):
            found.setdefault((kind, *layer.span(start, end)), (layer.depth, layer.via))
        oversize: list[tuple[str, int, int, str]] = []
        work += [x for x in (_percent(layer) if "%" in layer.text else None, _unicode(layer)) if x]
        work += _base64(layer, oversize)
        work += _escaped(layer, oversize)
        for *key3, via in oversize:
            found.setdefault(tuple(key3), (layer.depth + 1, via))
    order = {k: i for i, k in enumerate((*KINDS, OVERSIZE))}
    return sorted(((*k, *v) for k, v in found.items()), key=lambda x: (x[1], order[x[0]], x[2]))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("via", pa.string())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every secret of every whole text, spans in code points, end exclusive.

    ``depth`` 0 marks what the base patterns find in the text itself; those are
    always kept, deeper layers only add spans. One pass without a shuffle. Null
    and empty texts have no spans; null or repeated ids pass through row by row;
    further columns are not read; an empty table gives an empty table. Packed
    data that unfolds beyond ``LAYER_BYTES`` is reported as a span of its own.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "depth", "via"), s)) for s in scan(t)] if t else [] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN)], names=[id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(
        df.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,depth:int,via:string>>",
    )


def redacted(text: str, mark: str = "[secret]") -> str:
    """``text`` with every secret replaced; overlapping and touching spans become one mark."""
    out, at = [], 0
    for _, start, end, _, _ in scan(text):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with secrets replaced in ``text_col``; all rows and columns stay, null texts stay null."""
    at = df.columns.index(text_col)
    schema = df.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and redacted(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(df, run, schema)
