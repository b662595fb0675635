"""Similarity join on word shingles with PartEnum signatures.

Two sets whose similarity is at least the threshold differ in few elements. The
domain of the elements is cut by hash into cells; each differing element spoils
one cell. With more cells than elements that may differ, the sets agree on whole cells,
and a signature made of such cells is shared by both (PartEnum). In detail:

* Sets are grouped into bands of like size. A pair meets in the space of the
  band of its larger set, so each set signs in its own band's space and, if it
  can have a partner there, in the next one's.
* Few differences (small sets): first-level parts of three cells each, one
  signature for every subset of two. Of the parts one has at most one difference, so one of
  its subsets is free of any. A signature without an element would be shared
  by strangers; sets that have one sign once more with other cells.
* Many differences: first-level parts of two cells, subsets of one. There are some
  more cells than needed, so a set may leave out the emptiest: with c cells, a set that
  differs from any partner in at most h elements leaves out (c - 1 - h) / 2, and two such
  sets still share a signature.

Equal sets are one node, found by their hash before any signature is made. Nodes
with one signature form a bucket. Inside a bucket pairs are told apart by short
parity sketches: one bit for each of many cells, the parity of the elements
there. A differing element turns one bit, so sets whose sketches differ in more bits
than they may in elements are no link, for certain. Of the pairs that remain a bucket
sends a spanning forest, not all. All links lie inside the components of those
forests, so each component is gathered once, with whole texts, and its pairs are
compared exactly; large components are cut into tiles, in which any two nodes meet
once. A spanning forest of the links goes on to the components; the links themselves
are counted there, for each node by the rows of the nodes it links with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_joins, discard, map_partitions, small_batches, stored, tasks_for

WORDS = 5
#: Similarity of a link, in hundredths.
PERCENT = 80
#: Width of a band: its largest size over its smallest.
BAND = 1.6
#: From this many differences on, parts have two cells; share of cells added to leave out.
MANY = 16
SPARE = 0.05
#: Times that a set with an empty signature signs again.
AGAIN = 3
#: Text bytes for each partition of signatures.
PARTITION = 16 << 20
#: Bits of a parity sketch for each element of the band's largest set.
BITS = 1
#: Nodes that one task compares with each other; larger buckets and components are cut into tiles.
TILE = 4096
#: Numbers of a product of set matrices held at a time.
CELLS = 4_000_000
#: Bytes from which a word is hashed on its own.
LONG_WORD = 256

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b"\t\n\v\f\r ")] = True
_LOWEST = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data``, eight bytes of each at a time; eight bytes follow the last."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = length.astype(np.uint64) * _ODD[1]
    at, left, open_ = start, length, np.flatnonzero(length < LONG_WORD)
    at, left = at[open_], left[open_]
    while len(open_):
        held = eight[at] & _LOWEST[np.minimum(left, 8)]
        mixed = (out[open_] ^ held) * _ODD[0]
        out[open_] = (mixed ^ (mixed >> _U(29))) * _ODD[4]
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length >= LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]])
    return out ^ (out >> _U(32))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words; fewer words make one run; empty without words."""
    rows = [t.encode().lower() if t else b"" for t in texts]  # bytes: A-Z only
    data = b"\n".join([*rows, b"\0" * 8])
    begin = np.cumsum([0, *(len(r) + 1 for r in rows)])
    blank = _SPACE[np.frombuffer(data, dtype=np.uint8)[: begin[-1]]]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    w = _word_hashes(data, start, end - start)
    run = np.zeros(max(0, len(w) - words + 1), dtype=np.uint64)
    for j in range(words):
        run += w[j : j + len(run)] * _ODD[j % 5] * _U(2 * (j // 5) + 1)
    run = _mixed(run)
    first = np.searchsorted(start, begin).tolist()
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            whole = sum(int(x) * (2 * j + 3) * 0x9E3779B97F4A7C15 for j, x in enumerate(w[a:b].tolist())) + b - a
            out.append(_mixed(np.array([whole & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64), 9))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


#: Names that different sets were found to share, round by round.
Clashes = tuple[tuple[int, ...], ...]


def identities(sets: list[np.ndarray], clashes: Clashes = ()) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; 0 for an empty one.

    The first names the set. Where different sets were found to share a name, in one round after the
    other, the second hash is mixed in: together they tell sets apart by 128 bits.
    """
    sizes = np.array([len(e) for e in sets])
    out = np.zeros((2, len(sets)), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        all_ = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[full]
        for k in (0, 1):
            out[k, full] = np.add.reduceat(_mixed(all_, 11 + k), at).view(np.int64)
    for turn, names in enumerate(clashes):
        hit = np.isin(out[0], names)
        out[0, hit] = _mixed(out[0, hit].view(np.uint64) ^ _mixed(out[1, hit].view(np.uint64), 31 + turn), 47 + turn).view(np.int64)
    return out[0], out[1]


@lru_cache(maxsize=8)
def _bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Largest size of each band. Sets below the first size have equal partners only."""
    first = -(-percent // (100 - percent))
    out = [first - 1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int((out[-1] + 1) * BAND)))
    return np.array(out)


def plan(size: int, percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """(space, cells, cells to leave out, small) of each space in which a set of this size signs."""
    tops = _bands(percent)
    band = int(np.searchsorted(tops, size))
    if band == 0:
        return []
    reach = size * 100 // percent  # largest partner
    out = []
    for space in range(band, len(tops)):
        if space > band and reach <= tops[space - 1]:
            break
        top = int(tops[space])
        most = 2 * top * (100 - percent) // (100 + percent)  # differences of any pair here
        own = (size + min(top, reach)) * (100 - percent) // (100 + percent)  # and of this set's pairs
        if most < MANY:
            out.append((space, 3 * (most // 2 + 1), 0, True))
        else:
            cells = most + 1 + 2 * max(1, int(most * SPARE / 2 + 0.5))
            out.append((space, cells, (cells - 1 - own) // 2, False))
    return out


def signatures(elements: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """PartEnum signatures of a set, by space."""
    spaces = []
    for space, cells, leave, small in plan(len(elements), percent):
        out: list[np.ndarray] = []
        for seed in range(AGAIN + 1 if small else 1):
            hashed = _mixed(elements, 1000 + 8 * space + seed)
            cell = ((hashed >> _U(32)) * _U(cells) >> _U(32)).astype(np.int64)
            order = np.argsort(cell)
            filled, first, count = np.unique(cell[order], return_index=True, return_counts=True)
            sums = np.zeros(cells, dtype=np.uint64)
            sums[filled] = np.add.reduceat(hashed[order], first)
            held = np.zeros(cells, dtype=np.int64)
            held[filled] = count
            tag = _U(((space * 8 + seed + 1) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
            if not small:
                kept = np.argsort(held, kind="stable")[leave:]
                out.append(_mixed(sums[kept] * _ODD[1] + tag + kept.astype(np.uint64) * _ODD[2]))
                break
            s, h = sums.reshape(-1, 3), held.reshape(-1, 3)
            parts = np.arange(len(s), dtype=np.uint64)
            empty = False
            for subset, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                use = h[:, a] + h[:, b] > 0
                empty |= not use.all()
                if seed == AGAIN:
                    use[:] = True
                out.append(_mixed(s[use, a] * _ODD[1] + s[use, b] * _ODD[3] + tag + (parts[use] * _U(3) + _U(subset)) * _ODD[2]))
            if not empty:
                break
        spaces.append((space, np.concatenate(out)))
    return spaces


def sketch(elements: np.ndarray, space: int, percent: int = PERCENT) -> bytes:
    """Parity of the elements in each cell, a bit for each; all sets of a space have the same cells."""
    words = -(-BITS * int(_bands(percent)[space]) // 64)
    cell = ((_mixed(elements, 500 + space) >> _U(32)) * _U(64 * words) >> _U(32)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=64 * words) & 1).astype(np.uint8)).tobytes()


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, clashes: Clashes = ()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, proof): a node for each distinct set; null for texts without words."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            sizes = np.array([len(e) for e in sets], dtype=np.int64)
            node, proof = identities(sets, clashes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(proof, mask=sizes == 0)],
                names=["doc_id", "text_hash", "n_shingles", "node", "proof"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_partitions(rows, run, f"doc_id {kind}, text_hash long, n_shingles long, node long, proof long")


def _signed(df: DataFrame, text_col: str, parts: int, words: int, percent: int, clashes: Clashes = ()) -> DataFrame:
    """(part, held): signatures with their nodes, packed by partition; a node signs once in a batch.

    ``held``: the number of runs; for each run its node, its space and its number of signatures; the signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            signs, nodes, spaces = [np.zeros(0, dtype=np.uint64)], [], []
            for node, e in {n: e for n, e in zip(identities(sets, clashes)[0].tolist(), sets) if len(e)}.items():
                for space, s in signatures(e, percent):
                    signs.append(s)
                    nodes.append(node)
                    spaces.append(space)
            many = [len(s) for s in signs[1:]]
            sign, run_of = np.concatenate(signs), np.repeat(np.arange(len(many)), many)
            if not len(sign):
                continue
            node, space = np.array(nodes, dtype="<i8"), np.array(spaces, dtype="<u4")
            part = (sign % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, sign, run_of = part[order], (sign[order] >> _U(32)).astype("<u4"), run_of[order]
            head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(part)]):
                runs, count = np.unique(run_of[a:b], return_counts=True)
                blobs.append(
                    b"".join(x.tobytes() for x in (np.array([len(runs)], "<u4"), node[runs], space[runs], count.astype("<u4"), sign[a:b]))
                )
            yield pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array(blobs, pa.binary())], names=["part", "held"])

    return map_partitions(df.select(text_col), run, "part long, held binary")


def _buckets(signed: DataFrame) -> DataFrame:
    """(bucket, space, node): nodes that share a signature; buckets with the same nodes once for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = int(np.frombuffer(blob, "<u4", 1)[0])
                nodes = np.frombuffer(blob, "<i8", n, 4)
                spaces, many = np.frombuffer(blob, "<u4", n, 4 + 8 * n), np.frombuffer(blob, "<u4", n, 4 + 12 * n)
                held.setdefault(part, []).append((np.frombuffer(blob, "<u4", -1, 4 + 16 * n), np.repeat(nodes, many), np.repeat(spaces, many)))
        for chunks in held.values():
            sign, node, space = (np.concatenate([c[i] for c in chunks]) for i in range(3))
            chunks.clear()
            order = np.argsort((sign.astype(np.uint64) << _U(16)) | space.astype(np.uint64))
            sign, node, space = sign[order], node[order], space[order]
            new = np.concatenate([[True], (sign[1:] != sign[:-1]) | (space[1:] != space[:-1])])
            group = np.cumsum(new) - 1
            shared = np.bincount(group)[group] > 1  # most signatures are alone and go
            group, node, space = group[shared], node[shared], space[shared]
            order = np.lexsort((node, group))
            group, node, space = group[order], node[order], space[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (node[1:] != node[:-1])]) if len(group) else np.zeros(0, dtype=bool)
            group, node, space = group[new], node[new], space[new]  # a node may come from many batches
            if not len(group):
                continue
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.concatenate([head, [len(group)]]))
            names = _mixed(np.add.reduceat(_mixed(node.view(np.uint64), 77), head) + space[head].astype(np.uint64) * _ODD[2])
            many = np.flatnonzero(size > 1)
            _, once = np.unique(names[many], return_index=True)
            many = many[once]
            head, size, names = head[many], size[many], names[many]
            at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names.view(np.int64), size)), pa.array(space[at].astype(np.int32)), pa.array(node[at])],
                names=["bucket", "space", "node"],
            )
            for k in range(0, out.num_rows, 1 << 16):
                yield out.slice(k, 1 << 16)

    return map_partitions(signed, run, "bucket long, space int, node long")


def _sketched(df: DataFrame, text_col: str, words: int, percent: int, clashes: Clashes = ()) -> DataFrame:
    """(node, space, size, bits): the sketch of each node in each space where it signs; once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            rows = []
            for node, e in {n: e for n, e in zip(identities(sets, clashes)[0].tolist(), sets) if len(e)}.items():
                rows += [(node, space, len(e), sketch(e, space, percent)) for space, *_ in plan(len(e), percent)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["node", "space", "size", "bits"])

    return map_partitions(df.select(text_col), run, "node long, space int, size int, bits binary").dropDuplicates(["node", "space"])


def _tiled(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with (tile, half): nodes of a group of over TILE are dealt to blocks, and any two blocks meet in a tile.

    Half 0 and 1 tell the two blocks of a tile apart; in a tile of one block all are 0.
    """
    large = rows.groupBy(group).count().where(F.col("count") > TILE).select(group, F.ceil(F.col("count") / TILE).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1))
    met = rows.join(large, group, "left").withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    tile = F.least("_own", "_other").cast("long") * (1 << 31) + F.greatest("_own", "_other")
    return met.withColumns({"tile": tile, "half": (F.col("_own") > F.col("_other")).cast("int")}).drop("_own", "_other", "_blocks")


class _Forest:
    """Components of nodes given by place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, near: np.ndarray) -> list[int]:
        """Join ``i`` with the places ``near``; one place of each component that was not yet joined with it."""
        roots, first = np.unique(self.root[near], return_index=True)
        new = roots != self.root[i]
        if new.any():
            self.root[np.isin(self.root, roots[new])] = self.root[i]
        return near[first[new]].tolist()


def _likely(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each bucket a spanning forest of the pairs that sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for bucket, tile, half, node, size, bits in zip(*(c.to_pylist() for c in batch.columns)):
                buckets.setdefault((bucket, tile), []).append((half, node, size, bits))
        found: set[tuple[int, int]] = set()
        for members_ in buckets.values():
            members_.sort(key=lambda m: (m[0], m[1]))
            bits = np.frombuffer(b"".join(m[3] for m in members_), dtype=np.uint64).reshape(len(members_), -1)
            size = np.array([m[2] for m in members_], dtype=np.int64)
            half = sum(m[0] == 0 for m in members_) if members_[-1][0] else 0
            forest = _Forest(len(members_))
            for i in range(half or len(members_) - 1):
                from_ = half or i + 1
                differ = np.bitwise_count(bits[from_:] ^ bits[i]).sum(axis=1, dtype=np.int64)
                most = (size[from_:] + size[i]) * (100 - percent) // (100 + percent)
                near = np.minimum(size[from_:], size[i]) * 100 >= percent * np.maximum(size[from_:], size[i])
                for j in forest.join(i, np.flatnonzero((differ <= most) & near) + from_):
                    found.add((members_[i][1], members_[j][1]))
        pairs = sorted(found)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs[at : at + (1 << 16)])], names=["a", "b"])

    return map_partitions(rows.select("bucket", "tile", "half", "node", "size", "bits"), run, "a long, b long")


def _links(sets: list[np.ndarray], half: int, percent: int, copies: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among sets (between the first ``half`` and the others, if given), by place;
    and for each set the ``copies`` of all sets it links with.

    Intersections are products of the sets as rows of a matrix, with a column for each element that two sets hold.
    """
    n = len(sets)
    size = np.array([len(e) for e in sets])
    all_ = np.concatenate(sets)
    values, number, times = np.unique(all_, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), size)[shared[number]]
    column = column[number[shared[number]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, CELLS // n)
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    firsts = half or n
    step = max(1, CELLS // n)
    kind = np.float32 if size.max() < 1 << 24 else np.float64  # counts stay exact
    forest, found = _Forest(n), []
    met = np.zeros(n, dtype=np.int64)
    for lo in range(0, firsts, step):
        hi = min(firsts, lo + step)
        both = np.zeros((hi - lo, n), dtype=kind)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            held = np.zeros((n, width), dtype=kind)
            held[row[a:b], column[a:b] - k * width] = 1
            both += held[lo:hi] @ held.T
        for i in range(lo, hi):
            from_ = half or i + 1
            inside = both[i - lo, from_:].astype(np.int64)
            linked = 100 * inside >= percent * (size[from_:] + size[i] - inside)
            near = np.flatnonzero(linked) + from_
            met[i] += copies[near].sum()
            met[near] += copies[i]
            found += [(i, j) for j in forest.join(i, near)]
    return found, met


def _exact(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, met): spanning forests of the links in each component, or tile of one, by whole sets.

    Rows without b have in ``met`` the rows of all nodes that a links with in its component or tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            label, tile, half, node, _, copies = (c.to_pylist() for c in batch.columns)
            for k, e in enumerate(shingle_sets(batch.column(4).to_pylist(), words)):
                groups.setdefault((label[k], tile[k]), []).append((half[k], node[k], e, copies[k]))
        found: list[tuple[int, int | None, int | None]] = []
        while groups:
            (_, tile), members_ = groups.popitem()
            members_.sort(key=lambda m: (m[0], m[1]))
            half = 0
            if tile >> 31 != tile & 0x7FFFFFFF:  # two blocks; the pairs inside each have their own tile
                half = sum(m[0] == 0 for m in members_)
                if half in (0, len(members_)):
                    continue
            links, met = _links([m[2] for m in members_], half, percent, np.array([m[3] for m in members_], dtype=np.int64))
            found += [(members_[i][1], members_[j][1], None) for i, j in links]
            found += [(m[1], None, n) for m, n in zip(members_, met.tolist()) if n]
        for at in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + (1 << 16)])], names=["a", "b", "met"])

    return map_partitions(rows.select("label", "tile", "half", "node", "text", "rows"), run, "a long, b long, met long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over (a, b) edges, for every node that has an edge.

    Labels spread over edges and then skip to their own label's label, so the number
    of rounds grows with the logarithm of the longest path. Each round is stored.
    """
    earlier: list[DataFrame] = []
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    earlier.append(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        now = stored(
            spread.join(ahead, "label").select("node", "old", F.least("label", "far").alias("label")), "labels"
        )
        discard(edges.sparkSession, *earlier)
        earlier = [now]
        labels = now.select("node", "label")
        if now.where("old <> label").isEmpty():
            discard(edges.sparkSession, both)
            return labels


def similar(df: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, component, text_hash, n_links), one row per row of ``df``.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its
    distinct shingles of ``words`` words, or its whole word sequence if it has
    fewer. Documents link when 100 * |intersection| >= percent * |union|; a
    component's id is its smallest document id; ``component`` names it by its sets, for
    tables in which ids repeat; ``n_links`` is the number of other rows that a row links with, its copies included. Null and empty texts and texts of
    white space have no shingles, link with nothing and keep their own id. Repeated rows are
    documents of their own and share a component; a null id does not count for the
    smallest, and stays null where a component has no other. An empty table gives an
    empty table; columns beside id and text are not read.
    """
    if not 50 <= percent < 100:
        raise ValueError("the similarity of a link lies between 50 and 99 hundredths")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    clashes: Clashes = ()
    while True:
        member = stored(members(docs, "doc_id", "text", words, clashes), "members")
        nodes = member.where(F.col("node").isNotNull())
        known = nodes.groupBy("node").agg(
            F.min("proof").alias("p"), F.max("proof").alias("q"), F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("low"),
            F.count("*").alias("copies"),
        )
        known = stored(known, "nodes")
        # n sets share n * n / 2^65 names: ten or so of 2 * 10^10
        shared = tuple(r["node"] for r in known.where("p <> q").select("node").collect())
        if not shared:
            break
        discard(df.sparkSession, member, known)
        clashes = (*clashes, shared)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(tasks_for(df), -(-total // PARTITION))
    buckets = _buckets(_signed(docs, "text", parts, words, percent, clashes).repartition(parts, "part"))
    buckets = stored(buckets.dropDuplicates(["bucket", "node"]), "buckets")
    discard(df.sparkSession)
    labels = known.limit(0).select("node", F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("met"))
    if not buckets.isEmpty():
        labels = _linked(docs, nodes, buckets, words, percent, parts, clashes)
    discard(df.sparkSession, buckets)
    grouped = known.select("node", "low").join(labels, "node").groupBy("label").agg(F.min("low").alias("_lowest"))
    linked = labels.join(grouped, "label").select("node", "label", "_lowest", "met")
    own = known.select("node", "low", "copies").join(linked, "node", "left").select(
        "node",
        F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("_lowest")).alias("component_id"),
        F.coalesce("label", "node").alias("component"),
        (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return member.join(own, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component",
        "text_hash",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text, rows) of the wanted nodes, each from the one row that stands for it.

    Few texts are wanted, so rows are dropped by a Bloom filter before the shuffle.
    """
    with bloom_joins(docs.sparkSession):
        rows = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted.where("rows > 0"), "text_hash")
        rows = rows.where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text", "rows")
        return stored(rows.dropDuplicates(["node"]), "texts")


def _linked(
    docs: DataFrame, nodes: DataFrame, buckets: DataFrame, words: int, percent: int, parts: int, clashes: Clashes = ()
) -> DataFrame:
    """(node, label, met): components of the nodes that link with another, and the rows of all nodes each links with."""
    spark = docs.sparkSession
    rows = _tiled(buckets.join(_sketched(docs, "text", words, percent, clashes), ["node", "space"]), "bucket")
    forest = stored(_likely(rows.repartition(parts, "bucket", "tile"), percent).distinct(), "forest")
    discard(spark)
    likely = components(forest)
    wanted = nodes.join(likely.select("node"), "node", "left_semi")
    wanted = wanted.groupBy("node").agg(
        F.min(F.struct("text_hash", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one"), F.count("*").alias("rows")
    )
    wanted = stored(wanted.select("node", F.col("one.text_hash").alias("text_hash"), F.col("one.doc_id").alias("_id"), "rows"), "wanted")
    texts = _texts(docs, wanted)
    rows = _tiled(likely, "label").join(texts, "node")
    links = stored(_exact(rows.repartition(parts, "label", "tile"), words, percent), "links")
    labels = components(links.where(F.col("b").isNotNull()))
    met = links.where(F.col("met").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("met").alias("met"))
    met = stored(met, "met")
    discard(spark, wanted, texts, forest, links)
    return labels.join(met, "node")
