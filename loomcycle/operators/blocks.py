"""Earliest arrivals within a time block, in memory: a task holds the edges of two windows and extends all starts of the first.

Edges are dealt by blocks of width omega, each to its own block and the one before, so what a start can reach
within omega lies in its task. A task takes its starts by chunks and extends them round by round with binary
searches; a row that improves looks only at the edges between its new and its old time, so a start meets an
edge once. Nothing but the edges is shuffled. Blocks with many edges are dealt to several tasks by the start's source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Above BLOCK_EDGES edges in two windows the joins of `seeds` run instead. A task has the starts of about TASK_EDGES edges.
BLOCK_EDGES, TASK_EDGES = 4_000_000, 500_000
_CELLS, _DENSE_STARTS, _SPARSE_STARTS, _EXPANDED, _ROWS = 1 << 22, 256, 2048, 1 << 22, 1 << 16
_BITS = 1 << 28  # of a table of vertices and starts
_Found = Callable[["_Block", np.ndarray], Iterator[list[pa.Array]]]


class _Dense:
    """Codes 0 to size - 1 -> int32; what isn't known gives `missing`."""

    def __init__(self, size: int, missing: int):
        self.values, self.missing = np.full(size, missing, np.int32), missing

    def get(self, codes: np.ndarray) -> np.ndarray:
        return self.values[codes]

    def put(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.values[codes] = values

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.flatnonzero(self.values != self.missing)
        return codes, self.values[codes]


class _Sparse:
    """The same for codes of any size, as sorted arrays."""

    def __init__(self, missing: int):
        self.codes, self.values, self.missing = np.empty(0, np.int64), np.empty(0, np.int32), missing

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def get(self, codes: np.ndarray) -> np.ndarray:
        at, there = self._find(codes)
        out = np.full(len(codes), self.missing, np.int32)
        out[there] = self.values[at[there]]
        return out

    def put(self, codes: np.ndarray, values: np.ndarray) -> None:
        at, there = self._find(codes)
        self.values[at[there]] = values[there]
        if not there.all():
            both = np.concatenate([self.codes, codes[~there]])
            order = np.argsort(both, kind="stable")
            self.codes, self.values = both[order], np.concatenate([self.values, values[~there]]).astype(np.int32)[order]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        return self.codes, self.values


class _Block:
    """Distinct edges of one task; vertices and times are their ranks, so orders hold."""

    def __init__(self, src: pa.ChunkedArray, dst: pa.ChunkedArray, t: np.ndarray, start: np.ndarray, omega: int):
        ends = [x.to_numpy() for x in (src, dst)]
        self.labels, ends = np.unique(np.concatenate(ends), return_inverse=True)
        self.kind, self.times = src.type, np.unique(t)
        self.n, self.m = len(self.labels), len(self.times) + 1
        s, d, r = ends[: len(t)], ends[len(t) :], np.searchsorted(self.times, t)
        order = np.lexsort((d, r, s))
        s, d, r, start = s[order], d[order], r[order], start[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (r[1:] != r[:-1])
        s, d, r, start = s[new], d[new], r[new], start[new]
        self.out_key, self.out_dst, self.out_t = s * self.m + r, d, r
        back = np.lexsort((r, d))
        self.in_key, self.in_src, self.in_t = (d * self.m + r)[back], s[back], r[back]
        # a start is a source and a time; own numbers the start of each first edge, in order
        key, self.own = np.unique(self.out_key[start], return_inverse=True)
        self.first, self.x, self.tx = d[start], key // self.m, key % self.m
        self.limit = np.searchsorted(self.times, self.times[self.tx] + omega)

    def returning(self) -> None:
        """Keeps the starts whose source is reached again, and bounds them by the latest such time."""
        last = np.searchsorted(self.in_key, self.x * self.m + self.limit) - 1
        good = (last >= 0) & (self.in_key[last] > self.x * self.m + self.tx)
        stays = good[self.own]
        self.own, self.first = (np.cumsum(good) - 1)[self.own[stays]], self.first[stays]
        self.x, self.tx, self.limit = self.x[good], self.tx[good], self.in_t[last[good]] + 1

    def parts(self, rows: int) -> Iterator[slice]:
        size = _CELLS // self.n if _CELLS // self.n >= _DENSE_STARTS else _SPARSE_STARTS
        for at in range(0, rows, size):
            yield slice(at, min(at + size, rows))

    def _table(self, rows: int, missing: int) -> _Dense | _Sparse:
        return _Dense(rows * self.n, missing) if rows * self.n <= _CELLS else _Sparse(missing)

    def forward(self, part: slice) -> tuple[_Dense | _Sparse, list[np.ndarray]]:
        """(start * n + v -> first arrival) of some starts, numbered from 0, and their closing edges: start, time, source."""
        x, limit = self.x[part], self.limit[part]
        known, closed = self._table(len(x), self.m), [[], [], []]
        edges = slice(*np.searchsorted(self.own, [part.start, part.stop]))
        i, v = self.own[edges] - part.start, self.first[edges]
        known.put(i * self.n + v, self.tx[part][i])
        todo = [(i, v, self.tx[part][i] + 1, limit[i])]
        while todo:
            i, v, lo, hi = todo.pop()
            for rows, e in _between(self.out_key, v * self.m + lo, v * self.m + hi):
                at, d, t = i[rows], self.out_dst[e], self.out_t[e]
                back = d == x[at]
                for out, values in zip(closed, (at[back], t[back], v[rows][back])):
                    out.append(values)
                at, d, t = at[~back], d[~back], t[~back]
                codes, t = _first(at * self.n + d, t)
                old = known.get(codes)
                better = t < old
                codes, t, old = codes[better], t[better], old[better]
                if len(codes):
                    known.put(codes, t)
                    at = codes // self.n
                    todo.insert(0, (at, codes % self.n, t + 1, np.minimum(old + 1, limit[at])))
        return known, [np.concatenate(c) if c else np.empty(0, np.int64) for c in closed]

    def backward(self, begin: np.ndarray, end: np.ndarray, seed: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """seed, c, time: the last time to leave c, after begin, so as to reach one of the seed's last vertices before end."""
        leaves = self._table(len(begin), -1)
        codes = np.unique(seed * self.n + last)
        k = codes // self.n
        leaves.put(codes, end[k])
        todo = [(k, codes % self.n, begin[k] + 1, end[k])]
        while todo:
            k, v, lo, hi = todo.pop()
            for rows, e in _between(self.in_key, v * self.m + lo, v * self.m + hi):
                codes, t = _first(k[rows] * self.n + self.in_src[e], -self.in_t[e])
                t, old = -t, leaves.get(codes)
                better = t > old
                codes, t, old = codes[better], t[better], old[better]
                if len(codes):
                    leaves.put(codes, t)
                    at = codes // self.n
                    todo.insert(0, (at, codes % self.n, np.maximum(old, begin[at] + 1), t))
        codes, t = leaves.items()
        return codes // self.n, codes % self.n, t

    def vertex(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.labels[codes], self.kind)

    def time(self, ranks: np.ndarray) -> pa.Array:
        return pa.array(self.times[ranks])


def _between(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all keys with lo <= key < hi of each row, by bounded parts."""
    first = np.searchsorted(keys, lo)
    count = np.maximum(np.searchsorted(keys, hi) - first, 0)
    some = np.flatnonzero(count)
    ends = np.cumsum(count[some])
    at = 0
    while at < len(some):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + _EXPANDED, "right")))
        rows = np.repeat(some[at:stop], count[some[at:stop]])
        inside = np.arange(len(rows)) - np.repeat(np.concatenate([[0], ends[at : stop - 1] - done]), count[some[at:stop]])
        yield rows, first[rows] + inside
        at = stop


def _first(codes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, in order, each with its least t."""
    order = np.lexsort((t, codes))
    codes, t = codes[order], t[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return codes[new], t[new]


def arrivals(block: _Block) -> Iterator[list[pa.Array]]:
    """v, x, tx, ta"""
    for part in block.parts(len(block.x)):
        codes, ta = block.forward(part)[0].items()
        for at in range(0, len(codes), _ROWS):
            own = codes[at : at + _ROWS]
            start = part.start + own // block.n
            yield [block.vertex(own % block.n), block.vertex(block.x[start]), block.time(block.tx[start]), block.time(ta[at : at + _ROWS])]


def walks(block: _Block) -> Iterator[list[pa.Array]]:
    """root, begin, end

    Only which starts have reached a vertex matters, not when: one pass over the edges in time order hands on a bit for each start.
    """
    block.returning()
    order = np.argsort(block.out_t, kind="stable")
    src, dst, t = (block.out_key // block.m)[order].tolist(), block.out_dst[order].tolist(), block.out_t[order]
    groups = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
    t, size = t.tolist(), max(64, _BITS // block.n)
    for begin in range(0, len(block.x), size):
        part = slice(begin, min(begin + size, len(block.x)))
        i, end = np.divmod(np.unique(_returns(block, part, src, dst, t, groups)), block.m)
        for at in range(0, len(i), _ROWS):
            own = part.start + i[at : at + _ROWS]
            yield [block.vertex(block.x[own]), block.time(block.tx[own]), block.time(end[at : at + _ROWS])]


def _returns(block: _Block, part: slice, src: list[int], dst: list[int], t: list[int], groups: list[int]) -> np.ndarray:
    """start * m + end of some starts, numbered from 0, given all edges by ascending time and where equal times begin."""
    x, limit = block.x[part], block.limit[part]
    lo, hi = (np.searchsorted(x, np.arange(block.n), side).tolist() for side in ("left", "right"))  # a root's starts
    edges = slice(*np.searchsorted(block.own, [part.start, part.stop]))
    own, to = block.own[edges] - part.start, block.first[edges]
    leaves = block.tx[part][own]
    order = np.argsort(leaves, kind="stable")
    own, to, leaves = own[order].tolist(), to[order].tolist(), leaves[order].tolist()
    reached, some, left, found = np.zeros((block.n, -(-len(x) // 8)), np.uint8), [False] * block.n, 0, [np.empty(0, np.int64)]
    for first, stop in zip(groups, groups[1:]):
        now = t[first]
        while left < len(own) and leaves[left] < now:
            reached[to[left], own[left] >> 3] |= 1 << (own[left] & 7)
            some[to[left]] = True
            left += 1
        # edges of one time don't follow each other: all are read before any is handed on
        for v, bits in [(dst[e], reached[src[e]].copy()) for e in range(first, stop) if some[src[e]]]:
            if lo[v] < hi[v]:  # a start ends where it returns
                own_bytes = slice(lo[v] >> 3, (hi[v] + 7) >> 3)
                flags = np.unpackbits(bits[own_bytes], bitorder="little")
                inside = flags[lo[v] & 7 : (lo[v] & 7) + hi[v] - lo[v]]
                back = np.flatnonzero(inside) + lo[v]
                if len(back):
                    found.append(back[limit[back] > now] * block.m + now)
                    inside[:] = 0
                    bits[own_bytes] = np.packbits(flags, bitorder="little")
            reached[v] |= bits
            some[v] = True
    return np.concatenate(found)


def seeds(block: _Block) -> Iterator[list[pa.Array]]:
    """root, begin, end, candidates"""
    block.returning()
    for part in block.parts(len(block.x)):
        known, (i, end, last) = block.forward(part)
        interval, seed = np.unique(i * block.m + end, return_inverse=True)
        order = np.argsort(seed, kind="stable")
        seed, last = seed[order], last[order]
        start, end = np.divmod(interval, block.m)
        root, begin = block.x[part][start], block.tx[part][start]
        for few in block.parts(len(interval)):
            closing = slice(*np.searchsorted(seed, [few.start, few.stop]))
            k, c, leaves = block.backward(begin[few], end[few], seed[closing] - few.start, last[closing])
            inner = (c != root[few][k]) & (known.get(start[few][k] * block.n + c) < leaves)
            every = np.arange(few.stop - few.start)
            codes = np.unique(np.concatenate([k[inner] * block.n + c[inner], every * block.n + root[few], (seed[closing] - few.start) * block.n + last[closing]]))
            offsets = np.searchsorted(codes, np.arange(len(every) + 1) * block.n)
            yield [block.vertex(root[few]), block.time(begin[few]), block.time(end[few]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), block.vertex(codes % block.n))]


def by_block(edges: DataFrame, omega: int, found: _Found, schema: str, tasks: int, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """What `found` gives of each block's edges (src, dst, t), or of the blocks in share k of n."""
    names = [x.split()[0] for x in schema.split(", ")]
    block = F.floor(F.col("t") / omega)
    dealt = edges.select("src", "dst", "t", F.explode(F.array(block, block - 1)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task") if tasks > 1 else F.lit(0).alias("task"))
    if share[1] > 1:
        dealt = dealt.where(F.pmod("block", F.lit(share[1])) == share[0])
    dealt = dealt.withColumn("start", (F.col("block") == block) & (F.pmod(F.xxhash64("src"), F.lit(tasks)) == F.col("task")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            start = table["start"].to_numpy()
            if start.any():
                for columns in found(_Block(table["src"], table["dst"], table["t"].to_numpy(), start, omega)):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.repartition("block", "task").sortWithinPartitions("block", "task").mapInArrow(run, schema)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (block, task) of sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "task")]
        cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = (keys[0][lo], keys[1][lo])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
