"""Removal of repeated byte strings with run-length compressed indexes.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes.
An index of the whole corpus would be one unsplittable structure, so the corpus
is first dealt into many small ones, such that equal strings always meet:

1. Each window of ``length`` bytes has an anchor, its GRAM-byte substring with the
   smallest hash. Windows in a row with the same anchor form a segment. Equal windows
   have equal anchors, so only segments whose anchor occurs twice go on.
2. Those segments' bytes are dealt by anchor. Equal segments count as one.
3. Of the different segments of a block of anchors a run-length compressed Burrows-Wheeler
   transform is built, with samples at the ends of its runs: the text position
   there and the length of the match with the neighbouring run. Inside a run, a match
   is one longer for each byte to the left, so streaming over the text from sample to
   sample gives the matching statistics (the longest match elsewhere) of every position.
   Windows whose match reaches ``length`` are marked.

Hot strings stay cheap: what a batch holds twice is known to repeat at once, and
only one copy travels on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_partitions, small_batches, stored, tasks_for

LENGTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Bytes of text handled at a time in a task, of text per partition, and of an index.
CHUNK = 1 << 20
PARTITION = 8 << 20
BLOCK = 1 << 18
#: Seconds that Spark gets to delete the shuffle files of a stage before the next one writes its own.
CLEAN_UP = 1.0

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    w = _words(data)
    w *= _MIX[0]
    w ^= w >> _U(32)
    n = len(data) - GRAM + 1
    out = w[:n] * _MIX[1]
    for k in range(1, GRAM // 8):
        out += w[8 * k : 8 * k + n] * _MIX[1 + k % 3] * (_MIX[4] if k == 3 else _U(1))
    out ^= out >> _U(33)
    out *= _MIX[4]
    out ^= out >> _U(29)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def segments(data: bytes, starts: list[int], ends: list[int], length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash) of the segments of documents joined to ``data``."""
    text = np.frombuffer(data, dtype=np.uint8)
    valid = [np.arange(s, e - length + 1) for s, e in zip(starts, ends) if e - s >= length]
    if not valid:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    windows = np.concatenate(valid)
    hashes = gram_hashes(text)
    # of equal hashes the leftmost counts: its place is in the lower bits
    placed = (hashes >> _U(32) << _U(32)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_min(placed, length - GRAM + 1)[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = windows[np.concatenate([head[1:] - 1, [len(windows) - 1]])]
    first = windows[head]
    document = np.searchsorted(np.asarray(starts), first, side="right") - 1
    return document, first, last, hashes[anchor[head]].astype(np.int64)


def _pieces(keys: list[int], texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[int], list[int], list[int], list[int]]]:
    """Documents joined to chunks; one over CHUNK bytes is cut into pieces that share length - 1 bytes.

    Yields the joined bytes, starts, ends, keys and the offset of each piece in its document.
    """
    held: list[bytes] = []
    where: list[tuple[int, int]] = []
    size = 0
    for key, text in zip(keys, texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text if len(text) <= CHUNK else text[at : at + CHUNK + length - 1]
            held.append(piece)
            where.append((key, at))
            size += len(piece)
            if size >= CHUNK:
                yield _joined(held, where)
                held, where, size = [], [], 0
    if held:
        yield _joined(held, where)


def _joined(held: list[bytes], where: list[tuple[int, int]]):
    ends = np.cumsum([len(p) for p in held]).tolist()
    return b"".join(held), [0, *ends[:-1]], ends, [k for k, _ in where], [o for _, o in where]


def suffix_order(text: np.ndarray, ends: np.ndarray, deepest: int) -> np.ndarray:
    """Suffixes in order, each ending with its string; ``ends`` are the strings' ends, ``deepest`` the longest string.

    Prefix doubling from seven bytes on; only suffixes not yet told apart are sorted again.
    """
    n = len(text)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)  # bytes to the string's end
    depth = 7
    short = np.minimum(left, depth).astype(np.uint64)
    key = _words(np.concatenate([text, np.zeros(7, dtype=np.uint8)])).byteswap()
    # bytes behind the end are blanked; the last byte says how many there are
    key &= ~(_U(0xFFFFFFFFFFFFFFFF) >> (short * _U(8)))
    key |= short
    order = np.argsort(key, kind="stable")  # equal short ones stand in the order of their places, as below
    same = (key[order[1:]] == key[order[:-1]]) & (left[order[1:]] >= depth)

    def ranks(same: np.ndarray) -> np.ndarray:
        """For each place of an ordered list the place at which its group begins."""
        first = np.concatenate([[True], ~same])
        return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))

    rank = np.empty(n, dtype=np.int64)
    rank[order] = group = ranks(same)
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    place = np.flatnonzero(shared)  # places of the order that are still open
    while len(place) and depth < deepest:
        at = order[place]
        follow = at + depth
        inside = left[at] > depth
        # a suffix that ends here precedes the others, each in a place of its own
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + n, at)
        key = group[place] * (2 * n) + second
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[place] = at
        same = key[1:] == key[:-1]
        first = np.concatenate([[True], ~same])
        group[place] = np.maximum.accumulate(np.where(first, place, 0))
        rank[at] = group[place]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        place = place[shared]
        depth *= 2
    return order


def matching_statistics(strings: list[bytes]) -> np.ndarray:
    """For each position of the joined strings, the longest match that starts elsewhere and ends inside its string."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(strings), dtype=np.uint8)
    n = len(text)
    left = np.repeat(ends, sizes) - np.arange(n)
    order = suffix_order(text, ends, int(sizes.max()))
    # the transform, with a letter of its own before each string
    opens = np.zeros(n, dtype=bool)
    opens[ends - sizes] = True
    before = np.where(opens[order], 256 + order, text[order - 1].astype(np.int64))
    run_starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    # samples at the runs' ends: the last row of a run and the first row of the next
    low, high = order[run_starts[1:] - 1], order[run_starts[1:]]
    match = _common(text, low, high, np.minimum(left[low], left[high]))
    out = np.zeros(n, dtype=np.int64)
    edge = (np.array([order[0]]), np.array([0])), (np.array([order[-1]]), np.array([0]))
    for sampled, (row, none) in zip((high, low), edge):
        at = np.concatenate([sampled, row])
        size = np.concatenate([match, none])
        by = np.argsort(at, kind="stable")
        at, size = at[by], size[by]
        # between samples a match starts one byte later and is one byte shorter
        near = np.searchsorted(at, np.arange(n), side="right") - 1
        found = np.where(near >= 0, size[near] + at[near] - np.arange(n), 0)
        out = np.maximum(out, found)
    return np.minimum(out, left)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, up to ``most``."""
    words = _words(np.concatenate([text, np.zeros(8, dtype=np.uint8)]))
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.arange(len(a))
    done = 0
    while len(open_):
        differ = words[a[open_] + done] ^ words[b[open_] + done]
        equal = differ == 0
        stopped = open_[~equal]
        lowest = differ[~equal]
        lowest &= ~lowest + _U(1)
        out[stopped] = done + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        open_ = open_[equal]
        done += 8
        out[open_] = done
        open_ = open_[most[open_] > done]
    return np.minimum(out, most)


def _covered(strings: list[bytes], many: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """Byte intervals of each string that repeated windows cover."""
    reach = matching_statistics(strings)
    out, at = [], 0
    for s, whole in zip(strings, many):
        if whole:
            out.append([(0, len(s))])
        else:
            hit = np.flatnonzero(reach[at : at + len(s) - length + 1] >= length)
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                first = hit[np.concatenate([[0], cut + 1])].tolist()
                last = hit[np.concatenate([cut, [len(hit) - 1]])].tolist()
                out.append([(a, b + length) for a, b in zip(first, last)])
            else:
                out.append([])
        at += len(s)
    return out


def _row_hash(turn: int) -> Column:
    return F.xxhash64(F.lit(turn), "doc_id", "text")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): key tells rows apart; equal rows share one. Null texts count as empty.

    Rows are told apart by two hashes. Where different rows share the first, those rows alone get
    another one until none do: a handful among 10^10 rows in the first turn, none in the second.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, turn = rows.withColumn("key", _row_hash(0)), 0
    while True:
        other = keyed.select("key", F.xxhash64("text", "doc_id", F.lit(-1)).alias("other"))
        shared = other.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
        if shared.isEmpty():
            return keyed
        turn += 1
        again = stored(shared.select(F.col("key").alias("_shared")), "shared-keys")
        keyed = keyed.join(again, F.col("key") == F.col("_shared"), "left").select(
            "doc_id", "text", F.when(F.col("_shared").isNull(), F.col("key")).otherwise(_row_hash(turn)).alias("key")
        )


_SEGMENTS = pa.schema(
    [("deal", pa.int64()), ("anchor", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("more", pa.int16()), ("known", pa.bool_()), ("leads", pa.bool_())]
)


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """(deal, anchor, key, first, more, known, leads) of all segments; ``known``: seen to repeat in its own batch.

    Of a batch's segments with one anchor one leads and is dealt by the anchor, the others
    by their own place. What can be told from the rest is left 0, for the shuffle to compress:
    the anchor of a leading segment; ``more`` is the number of windows after the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for data, starts, ends, keys, offsets in _pieces(batch.column(0).to_pylist(), texts, length):
                doc, first, last, anchor = segments(data, starts, ends, length)
                shift = np.asarray(offsets)[doc] - np.asarray(starts)[doc]
                key = np.asarray(keys, dtype=np.int64)[doc]
                _, lead, back, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                leads = np.zeros(len(anchor), dtype=bool)
                leads[lead] = True
                known = times[back] > 1
                own = key ^ ((first + shift) * np.int64(0x5851F42D))
                columns = (
                    np.where(leads, anchor, own),
                    np.where(leads, 0, anchor),
                    key,
                    (first + shift).astype(np.int32),
                    (last - first).astype(np.int16),
                    known,
                    leads,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_SEGMENTS)

    return map_partitions(rows.select("key", "text"), run, "deal long, anchor long, key long, first int, more short, known boolean, leads boolean")


def _repeated(dealt: DataFrame) -> DataFrame:
    """(key, anchor, first, last) of the segments whose anchor occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _SEGMENTS)
        if not table.num_rows:
            return
        deal, anchor, key, first, more, known, leads = (c.to_numpy() for c in table.columns)
        anchor = np.where(leads, deal, anchor)
        _, back, times = np.unique(anchor[leads], return_inverse=True, return_counts=True)
        keep = known.copy()
        keep[np.flatnonzero(leads)[times[back] > 1]] = True
        out = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, anchor, first, first + more)], names=["key", "anchor", "first", "last"])
        for at in range(0, out.num_rows, 1 << 16):
            yield out.slice(at, 1 << 16)

    return map_partitions(dealt, run, "key long, anchor long, first int, last int")


_OUT = "deal long, key long, start int, stop int, anchor long, content binary, many boolean"


def _merged(intervals: list[list[int]]) -> list[list[int]]:
    """Intervals in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for start, stop in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def _cut_out(joined: DataFrame, length: int) -> DataFrame:
    """Bytes of the repeated segments, dealt by anchor; of equal ones in a batch only one travels, the others as merged intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            rows: list[list] = []
            for key, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                known: list[list[int]] = []
                for part in parts:
                    first, anchor = part["first"], part["anchor"]
                    content = data[first : part["last"] + length]
                    stop = first + len(content)
                    if content in seen:
                        rows[seen[content]][6] = True
                        known.append([first, stop])
                    else:
                        seen[content] = len(rows)
                        rows.append([anchor, key, first, stop, anchor, content, False])
                rows += [[key ^ first, key, first, stop, 0, None, True] for first, stop in _merged(known)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
                names = [x.split()[0] for x in _OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_partitions(joined.select("key", "text", "parts"), run, _OUT)


def _marked(dealt: DataFrame, length: int) -> DataFrame:
    """(key, start, stop): byte intervals that repeat, from the indexes of a partition's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per anchor, per content: occurs more than once, and where
        by_anchor: dict[int, dict[bytes, list]] = {}
        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for _, key, start, stop, anchor, content, many in zip(*(c.to_pylist() for c in batch.columns)):
                if content is None:
                    found.append((key, start, stop))
                    continue
                held = by_anchor.setdefault(anchor, {}).get(content)
                if held is None:
                    by_anchor[anchor][content] = [many, [(key, start)]]
                else:
                    held[0] = True
                    held[1].append((key, start))
        strings: list[bytes] = []
        states: list[list] = []
        size = 0

        def flush() -> None:
            for state, parts in zip(states, _covered(strings, [s[0] for s in states], length) if strings else []):
                for a, b in parts:
                    found.extend((key, start + a, start + b) for key, start in state[1])
            strings.clear()
            states.clear()

        for contents in by_anchor.values():
            if len(contents) == 1:  # nothing else to match
                ((content, (many, places)),) = contents.items()
                if many:
                    found += [(key, start, start + len(content)) for key, start in places]
                continue
            for content, state in contents.items():
                strings.append(content)
                states.append(state)
                size += len(content)
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        for at in range(0, len(found), 1 << 16):
            part = zip(*found[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, (pa.int64(), pa.int32(), pa.int32()))], names=["key", "start", "stop"])

    return map_partitions(dealt, run, "key long, start int, stop int")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every whole text as UTF-8 bytes.

    ``spans`` are the removed byte runs (start, end exclusive), as long as
    possible; ``kept`` is what is left. A string repeats if it starts at two
    places of the corpus, in one document or two; matches never cross documents.
    Null texts count as empty; texts under ``length`` bytes lose nothing; equal
    rows are documents of their own and so remove each other's text; null and
    repeated ids are rows like any other. An empty table gives an empty table;
    columns beside id and text are not read.

    Texts move twice, to meet their segments and to meet their spans; segments
    move as 24-byte rows, and as bytes only if their anchor repeats.
    """
    if length < 2 * GRAM:
        raise ValueError(f"at least {2 * GRAM} bytes")
    small_batches(df.sparkSession)
    rows = _keyed(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(tasks_for(df), -(-total // PARTITION))
    repeated = stored(_repeated(_anchored(rows, length).repartition(parts, "deal")), "segments")
    discard(df.sparkSession, wait=CLEAN_UP)
    lists = repeated.groupBy("key").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("parts"))
    marked = stored(_marked(_cut_out(rows.join(lists, "key"), length).repartition(parts, "deal"), length), "spans")
    del lists
    discard(df.sparkSession, repeated, wait=CLEAN_UP)
    spans = marked.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                runs = _merged([[s["start"], s["stop"]] for s in found or ()])
                cuts = [0, *[x for r in runs for x in r], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                merged.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    whole = rows.join(spans, "key", "left").select("doc_id", "text", "found")
    kind = df.schema[id_col].dataType.simpleString()
    return map_partitions(whole, run, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
