"""Byte-level BPE encoding and decoding with forced boundaries.

A merge can only join two bytes that stand next to each other in some token. So
a pair of bytes that no token contains marks a cut: both sides can be encoded on
their own and the ids put one after the other. Most words and punctuation marks
become fragments of their own, and a fragment seen before costs a lookup.

Cuts are only made where the tokenizer's splitting pattern, too, gives the same
pieces for both sides alone: between two ASCII bytes of which the first is not
white space (white space looks ahead), and not where an apostrophe could begin
a contraction on one reading only.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fragments remembered by a worker, and the longest one worth remembering.
CACHE = 200_000
LONGEST = 48
#: Fragments handled at a time, so that a very long text needs little memory.
CHUNK = 1 << 16


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _cut_table(tokens: list[bytes]) -> np.ndarray:
    """cut[x * 256 + y]: may a text be cut between the bytes x and y?"""
    joined = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            a = np.frombuffer(token, dtype=np.uint8)
            joined[a[:-1], a[1:]] = True
    for pair in (b"re", b"ve", b"ll"):  # inside contractions
        joined[pair[0], pair[1]] = True
    cut = np.zeros((256, 256), dtype=bool)
    word = [b for b in range(128) if chr(b).isalnum()]
    marks = [b for b in range(0x21, 0x7F) if b not in word]
    right = [*range(0x09, 0x0E), *range(0x20, 0x7F)]
    for x in (*word, *marks):
        for y in right:
            cut[x, y] = not joined[x, y]
    quote = ord("'")
    cut[marks, quote] = False
    cut[quote, [b for b in word if chr(b).isalpha()]] = False
    return cut.reshape(-1)


class Codec:
    """Encodes with a tokenizer file, fragment by fragment."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("forced boundaries are worked out for plain byte-level BPE files only")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings with them are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        symbols = _byte_symbols()
        self.pieces: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = _cut_table([p for i, p in enumerate(self.pieces) if i not in set(self.special.values())])
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.known: dict[bytes, bytes] = {}
        self.missed = 0
        held = [i for i, p in enumerate(self.pieces) if b"\0" in p]
        self.nul = held[0] if len(held) == 1 and self.pieces[held[0]] == b"\0" else None

    def _learn(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """Ids of fragments that are not known yet; short ones are remembered.

        They go to the library as one text with a NUL after each: no token joins a
        NUL to anything, so it, too, is a forced boundary. Fragments in which
        the pattern would see the NUL (white space at the end, an apostrophe at the
        start) go one by one.
        """
        new = list({f for f in fragments if f not in self.known})
        self.missed += len(new)
        if self.missed > 8 * CACHE:
            self.known.clear()
            self.missed = 0
            new = list(set(fragments))
        plain = [f for f in new if self.nul is not None and f[:1] != b"'" and not f[-1:].isspace() and f[-1] < 128 and b"\0" not in f]
        odd = list(set(new).difference(plain))
        got = {}
        if plain:
            text = (b"\0".join(plain) + b"\0").decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.nul).tolist()
            raw, at = ids.tobytes(), 0
            for f, end in zip(plain, ends):
                got[f] = raw[4 * at : 4 * end]
                at = end + 1
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            found = self.library.encode_batch_fast([f.decode() for f in part], add_special_tokens=False)
            got.update((f, np.array(e.ids, dtype="<u4").tobytes()) for f, e in zip(part, found))
        if len(self.known) < CACHE:
            self.known.update((f, ids) for f, ids in got.items() if len(f) <= LONGEST)
        return got

    def _plain(self, data: bytes) -> list[bytes]:
        """Ids of a text without special strings."""
        if not data:
            return []
        a = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(self.cut[(a[:-1].astype(np.uint16) << 8) | a[1:]]) + 1
        out = []
        for first in range(0, len(at) + 1, CHUNK):
            ends = at[first : first + CHUNK].tolist()
            if first + CHUNK > len(at):
                ends.append(len(data))
            starts = [int(at[first - 1]) if first else 0, *ends[:-1]]
            fragments = [data[s:e] for s, e in zip(starts, ends)]
            try:
                out.append(b"".join(map(self.known.__getitem__, fragments)))
            except KeyError:
                got = self._learn(fragments)
                out.append(b"".join([got[f] if f in got else self.known[f] for f in fragments]))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, rest = [], text
        while rest:
            # the leftmost special string, the longest of those that begin there
            hits = [(at, -len(s), s) for s in self.special if (at := rest.find(s)) >= 0]
            if not hits:
                out += self._plain(rest.encode())
                break
            at, _, s = min(hits)
            out += self._plain(rest[:at].encode())
            out.append(np.array([self.special[s]], dtype="<u4").tobytes())
            rest = rest[at + len(s) :]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        numbers = np.frombuffer(ids, dtype="<u4")
        parts = [b"".join([pieces[i] for i in numbers[at : at + CHUNK].tolist()]) for at in range(0, len(numbers), CHUNK)]
        return b"".join(parts).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every whole text; ``ids`` are little-endian unsigned 32-bit integers.

    One pass without a shuffle. A null text counts as empty and has no ids; null
    or repeated document ids pass through, row by row; other columns of ``df``
    are not read. An empty table gives an empty table. ``path`` must exist on
    every executor.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = [own.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
            names=[id_col, "n_tokens", "ids"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, decoded) of what ``encode`` returned; bytes that are no UTF-8 become U+FFFD."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        texts = [own.decode(x) if x else "" for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(
        df.select(id_col, "n_tokens", "ids"), run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string"
    )


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one pass, so that a task needs one worker with one vocabulary, not two."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = [own.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())],
            names=[id_col, "n_tokens", "ids", "decoded"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)
