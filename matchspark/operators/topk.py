"""Exact top-k vector search as a tiled matrix product.

The corpus is cut into groups (a hash of the item id, or given cells), each of which fits into one task; the queries are dealt over the
tasks of every group. A tile (group, share of the queries) is one task: it gets the rows of its group first and keeps them as one matrix of
unit vectors, then its queries stream through in blocks of at most ``block_rows``. A block meets the whole group in one product in single precision
(``LOOK_CELLS`` cells at most): the k-th of the best of stretches of columns and the bound of the product's error tell which pairs may be among the k best of
a query, and these are scored in float64. Where a block reads some cells of the group only, it meets them one by one with running lists. k
entries per query and group leave the task, as lists in rows of at most ``PIECE`` entries: a row per pair would cost more than its score. Where there are several
groups, or a query's id comes more than once, its lists are merged. A query is there once per group and a
corpus row once per share of the queries: what is shuffled grows with the rows, not with the pairs of blocks, and what a task holds is bounded
by the group (``GROUP_BYTES``), one block of queries and its lists.

Vectors of different dimensions have no cosine: such pairs are left out, or score 0 where the search keeps absent items as 0.

Scores are cosine similarities: vectors are L2-normalised in float64 (zero vectors kept as zeros, so they score 0), which equals inner product
search on unit vectors. They are rounded to ``DIGITS`` digits before they are compared, so equal vectors tie wherever they
stand in a product; ties go to the smaller item id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.functions.vector import present

DIGITS = 12
#: bytes of float64 corpus vectors that a task holds at most, besides half as many in single precision (a broadcast limit below it asks for smaller groups, but not below the least)
GROUP_BYTES, LEAST_GROUP_BYTES = 64 << 20, 16 << 20
#: pairs that a task scores at least and at most, and the number of tasks up to which they get no more than the least
PAIRS_LEAST, PAIRS_MOST, TASKS = 50_000_000, 10_000_000_000, 64
#: entries of the running lists of one block of queries
LIST_ENTRIES = 1_000_000
#: pairs scored again in double at once, and the length from which vectors are not looked at in single precision
HITS_AT_ONCE, LONGEST = 32_768, 1e15
#: cells and columns of a first look at most, entries that a block of queries holds before they are cut to its lists, and the share of the group
#: that a block must read for a look at all of it
LOOK_CELLS, LOOK_COLUMNS, HELD, LOOK_SHARE = 8_000_000, 1 << 19, 1_000_000, 0.25
#: entries in a row of a list that travels
PIECE = 128


# ---------------------------------------------------------------- tiles
def tiles_of(n_q: int, n_c: int, groups: int) -> int:
    """Shares into which the queries of each group are dealt."""
    pairs = n_q * n_c
    tasks = max(min(pairs // PAIRS_LEAST, TASKS), pairs // PAIRS_MOST, 1)
    return max(1, min(math.ceil(tasks / groups), n_q))


def dealt(parts: list[DataFrame], tiles: int, order: list[str]) -> DataFrame:
    """Rows of all ``parts`` (column ``_t``: tile, ``order``: what comes first in it), one tile a task."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.repartitionById(tiles, F.col("_t")).sortWithinPartitions("_t", *order)


def runs_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with the same values of some integer columns, in order."""
    if not batch.num_rows:
        return
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def by_dimension(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of the vectors that are there."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        some = vectors if len(rows) == len(vectors) else vectors.take(pa.array(rows))
        yield d, rows, some.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    n[n == 0] = 1.0
    m /= n[:, None]
    return m


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids of two columns are (no id: equal to none)."""
    both = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = codes[:len(a)], codes[len(a):].copy()
    y[y < 0] = -2
    return x, y


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best finite scores of each row; among equals the first columns."""
    k = min(k, s.shape[1])
    if k <= 0:
        return np.zeros_like(s, dtype=bool)
    if k == s.shape[1]:
        return np.isfinite(s)
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
    above, tie = s > kth, s == kth
    room = k - above.sum(axis=1, keepdims=True)
    return (above | (tie & (np.cumsum(tie, axis=1) <= room))) & np.isfinite(s)


def _floor(s: np.ndarray, k: int, clamp: bool) -> np.ndarray:
    """At most the k-th best score of each row, by the best of its stretches of columns."""
    width = min(16, s.shape[1] // k)
    n = s.shape[1] // width
    tops = s[:, :n * width].reshape(len(s), n, width).max(axis=2)
    kth = np.partition(tops, n - k, axis=1)[:, n - k]
    return np.where(kth < 0, -np.inf, np.minimum(kth, 1.0)) if clamp else kth


# ---------------------------------------------------------------- one tile
class UnitRows:
    """Unit vectors of single-precision rows, made when they are asked for: what is held is a third of the vectors in both precisions."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.norm = raw, np.ones(len(raw))
        for x in range(0, len(raw), 2048):
            m = raw[x:x + 2048].astype(np.float64)
            self.norm[x:x + 2048] = np.sqrt(np.einsum("ij,ij->i", m, m))
        self.plain = bool(((self.norm == 0) | ((self.norm >= 1 / LONGEST) & (self.norm <= LONGEST))).all())   # no length is out of the range of products
        self.norm[self.norm == 0] = 1.0

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, at) -> np.ndarray:
        m = self.raw[at].astype(np.float64)
        m /= self.norm[at][..., None]
        return m


class Group:
    """The corpus rows of a tile: ids in ascending order (an item is known by its place there), and per dimension the unit vectors, ordered by
    cell and place."""

    def __init__(self, batches: list[pa.RecordBatch], normalize: bool):
        """The batches are taken out of the list one by one: the vectors are never there a third time."""
        ids = pa.concat_arrays([b.column("_c") for b in batches])
        order = pc.sort_indices(ids, null_placement="at_start")
        self.ids = ids.take(order)
        place = np.empty(len(ids), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(ids))
        named = "_cell" in batches[0].schema.names
        single = normalize and pa.types.is_float32(batches[0].column("_v").type.value_type)
        cells = np.concatenate([b.column("_cell").to_numpy(zero_copy_only=False) for b in batches]) if named else np.zeros(len(ids), dtype=np.int64)
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(b.column("_v")), -1).to_numpy(zero_copy_only=False) for b in batches])
        self.blocks, to = {}, np.zeros(len(ids), dtype=np.int64)        # dimension: (places, unit vectors, cells, first row of each cell)
        for d in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == d)
            o = np.lexsort((place[at], cells[at]))
            to[at[o]] = np.arange(len(at))
            cell, first = np.unique(cells[at][o], return_index=True)
            self.blocks[d] = (place[at][o], np.empty((len(at), d), dtype=np.float32 if single else np.float64), cell, np.append(first, len(at)))
        begin, batches[:] = 0, batches[::-1]
        while batches:
            batch = batches.pop()
            for d, at, m in by_dimension(batch.column("_v")):
                for x in range(0, len(at), 2048):
                    some = m[x:x + 2048]
                    self.blocks[d][1][to[begin + at[x:x + 2048]]] = _unit_rows(some) if normalize and not single else some
            begin += batch.num_rows
        # for the first look: the vectors in single precision, the longest, and what the products are scaled by
        self.short = {}
        for d, (places, m, cell, first) in self.blocks.items():
            if single:
                units = UnitRows(m)
                self.blocks[d] = places, units if units.plain else _unit_rows(m), cell, first
                if units.plain:
                    self.short[d] = m, 1.0, (1 / units.norm).astype(np.float32)
                    continue
                m = self.blocks[d][1]
            with np.errstate(over="ignore"):
                self.short[d] = m.astype(np.float32)
            self.short[d] = self.short[d], float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))), None


class Lists:
    """The running k best (score, place) of a block of queries; ``least``: the score that a row must reach to enter."""

    def __init__(self, rows: int, k: int, width: int):
        self.k, self.fill = k, np.zeros(rows, dtype=np.int64)
        self.score = np.full((rows, k + max(k, width)), -np.inf)
        self.place = np.zeros(self.score.shape, dtype=np.int32)
        self.least = np.full(rows, -np.inf)

    def add(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Entries sorted by row."""
        if not len(row):
            return
        n = np.bincount(row, minlength=len(self.fill))
        if (self.fill + n).max() > self.score.shape[1]:
            self.cut()
        at = self.fill[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        self.score[row, at], self.place[row, at] = score, place
        self.fill += n
        if self.fill.max() > self.k + max(self.k, 64) or (np.isneginf(self.least) & (self.fill >= self.k)).any():
            self.cut()

    def cut(self) -> None:
        m = int(self.fill.max())
        s, p = self.score[:, :m], self.place[:, :m]
        if m > self.k:
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1:self.k]
            ties = np.flatnonzero((((s >= kth) & np.isfinite(s)).sum(axis=1)) > self.k)
            if len(ties):       # among equals the first places stay
                o = np.argsort(p[ties] + np.where(np.isfinite(s[ties]), 0, 1 << 31), axis=1)
                s[ties], p[ties] = np.take_along_axis(s[ties], o, 1), np.take_along_axis(p[ties], o, 1)
        row, col = np.nonzero(_best(s, self.k))
        kept, place = s[row, col], p[row, col]
        n = np.bincount(row, minlength=len(self.fill))
        self.score[:, :m] = -np.inf
        at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        self.score[row, at], self.place[row, at], self.fill = kept, place, n
        full = np.flatnonzero(n == self.k)
        self.least[full] = self.score[full, :self.k].min(axis=1)


class Held:
    """Entries (row, place, score) of a block of queries, cut to the k best of each row whenever there are many; ``least``: the score that
    an entry must reach after a cut."""

    def __init__(self, rows: int, k: int):
        self.k, self.rows, self.parts, self.n, self.limit = k, rows, [], 0, HELD
        self.least = np.full(rows, -np.inf)

    def add(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((row, place, score))
        self.n += len(row)
        if self.n > self.limit:
            self.cut()
            self.limit = self.n + HELD

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries that stay, by row, score descending and place."""
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        row, place, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        first = np.searchsorted(row, np.arange(self.rows + 1))
        kept = np.arange(len(row)) - first[row] < self.k
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = score[first[full] + self.k - 1]
        self.parts, self.n = [(row[kept], place[kept], score[kept])], int(kept.sum())
        return self.parts[0]


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """At most the k-th best score of each row: the k-th of the best of stretches of columns."""
    if s.shape[1] < k:
        return np.full(len(s), -np.inf)
    width = max(1, min(16, s.shape[1] // (4 * k)))
    n = s.shape[1] // width
    tops = s[:, :n * width].reshape(len(s), width, n).max(axis=1) if width > 1 else s
    return np.partition(tops, n - k, axis=1)[:, n - k]


def _tile(k: int, exclude_self: bool, clamp: bool, positive_only: bool, normalize: bool, other_dim_zero: bool, block_rows: int, piece: int = 0) -> Callable:
    """``piece``: the lists leave in rows of at most so many entries; 0: a row for each entry."""
    slack = 10.0 ** (1 - DIGITS)

    def zeros_of(group: Group, d: int) -> np.ndarray:
        """The first places of items of other dimensions, which score 0: enough of them."""
        if not other_dim_zero:
            return np.zeros(0, dtype=np.int64)
        return np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *[b[0] for x, b in group.blocks.items() if x != d]]))[:k + exclude_self]

    def limits(group: Group, d: int, q: np.ndarray) -> tuple[np.ndarray, bool]:
        """More than a product in single precision is off, and whether that can be said."""
        longest = group.short[d][1]
        length = np.sqrt(np.einsum("ij,ij->i", q, q))
        off = (d + 8) * 2.0 ** -23 * longest * length + slack
        return off, bool(np.isfinite(off).all() and longest < LONGEST and length.max(initial=0.0) < LONGEST)

    def looked(group: Group, ids: pa.Array, d: int, q: np.ndarray, off: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query by a look at the whole group. ``bits``: which cells each query reads."""
        held, (places, units, _, first), (short, _, scale) = Held(len(ids), k), group.blocks[d], group.short[d]
        cell = None if bits is None else np.repeat(np.arange(len(first) - 1), np.diff(first))
        if exclude_self:
            code_q, code_c = _codes(ids, group.ids)
            by_code = np.argsort(code_c[places], kind="stable")
            lo, hi = (np.searchsorted(code_c[places][by_code], code_q, side=x) for x in ("left", "right"))
            own_row = np.repeat(np.arange(len(ids)), hi - lo)
            own = by_code[np.arange(len(own_row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]

        def offer(row, place, score):
            score = np.round(score, DIGITS) + 0.0
            if clamp:
                np.clip(score, 0.0, 1.0, out=score)
            ok = np.isfinite(score) & (score >= held.least[row])
            if positive_only:
                ok &= score > 0
            if exclude_self:
                ok &= code_q[row] != code_c[place]
            held.add(row[ok], place[ok], score[ok])

        zeros = zeros_of(group, d)
        for a in range(0, len(zeros), block_rows):
            some = zeros[a:a + block_rows]
            offer(np.repeat(np.arange(len(ids)), len(some)), np.tile(some, len(ids)), np.zeros(len(ids) * len(some)))
        step = max(1, LOOK_CELLS // max(1, min(len(units), LOOK_COLUMNS)))
        for x in range(0, len(units), LOOK_COLUMNS):
            y = min(len(units), x + LOOK_COLUMNS)
            if x:
                held.cut()
            for a in range(0, len(ids), step):
                b = min(len(ids), a + step)
                s = q[a:b].astype(np.float32) @ short[x:y].T
                if scale is not None:
                    s *= scale[x:y]
                if bits is not None:
                    np.copyto(s, np.float32(-np.inf), where=~bits[a:b][:, cell[x:y]])
                if exclude_self:
                    here = (own_row >= a) & (own_row < b) & (own >= x) & (own < y)
                    s[own_row[here] - a, own[here] - x] = -np.inf
                floor = _kth(s, k).astype(np.float64) - off[a:b]
                if clamp:
                    floor = np.where(floor < 0, -np.inf, np.minimum(floor, 1.0))
                floor = np.maximum(floor, held.least[a:b]) - off[a:b]
                if positive_only:
                    floor = np.maximum(floor, -off[a:b])
                near = s >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
                if np.isneginf(floor).any():
                    near &= s > -np.inf
                hit = np.flatnonzero(near)
                # scored one by one, so that equal vectors have equal scores whatever product found them
                for c in range(0, len(hit), HITS_AT_ONCE):
                    row, col = np.divmod(hit[c:c + HITS_AT_ONCE], y - x)
                    offer(row + a, places[x + col], np.einsum("ij,ij->i", q[row + a], units[x + col]))
        return held.cut()

    def scored(group: Group, ids: pa.Array, d: int, q: np.ndarray, reads: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if d in group.blocks:
            off, fits = limits(group, d, q)
            bits = None
            if reads is not None and fits:
                first = group.blocks[d][3]
                bits = np.unpackbits(np.frombuffer(b"".join(reads), dtype=np.uint8).reshape(len(ids), -1), axis=1)[:, group.blocks[d][2]].astype(bool)
                fits = (bits.sum(axis=0) * np.diff(first)).sum() >= LOOK_SHARE * len(ids) * first[-1]
                bits = None if bits.all() else bits
            if fits:
                return looked(group, ids, d, q, off, bits)
        return by_stretches(group, ids, d, q, reads)

    def by_stretches(group: Group, ids: pa.Array, d: int, q: np.ndarray, reads: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = Lists(len(ids), k, block_rows)
        code_q, code_c = _codes(ids, group.ids) if exclude_self else (None, None)

        def offer(row, place, score):
            score = np.round(score, DIGITS) + 0.0
            if clamp:
                np.clip(score, 0.0, 1.0, out=score)
            ok = np.isfinite(score) & (score >= lists.least[row])
            if positive_only:
                ok &= score > 0
            if exclude_self:
                ok &= code_q[row] != code_c[place]
            lists.add(row[ok], place[ok], score[ok])

        zeros = zeros_of(group, d)
        for a in range(0, len(zeros), block_rows):
            some = zeros[a:a + block_rows]
            offer(np.repeat(np.arange(len(ids)), len(some)), np.tile(some, len(ids)), np.zeros(len(ids) * len(some)))
        if d in group.blocks:
            places, units, cells, first = group.blocks[d]
            (short, _, scale), (off, fits) = group.short[d], limits(group, d, q)
            rough = np.empty(len(q) * min(block_rows, len(units)), dtype=np.float32) if fits else None
            near = np.empty(rough.shape, dtype=bool) if fits else None
            for asked, a, b in _stretches(reads, cells, first, len(ids)):
                mine = q if len(asked) == len(q) else q[asked]
                mine_short = mine.astype(np.float32) if fits else None
                for x in range(a, b, block_rows):
                    y = min(b, x + block_rows)
                    least = lists.least[asked]
                    if not fits:
                        s = mine @ units[x:y].T
                        hit = np.flatnonzero(s >= (least - slack)[:, None])
                    elif np.isneginf(least).any():
                        s = mine @ units[x:y].T
                        if y - x > 2 * k:
                            if exclude_self:
                                s[code_q[asked][:, None] == code_c[places[x:y]]] = -np.inf
                            least = np.maximum(least, _floor(s, k, clamp))
                        hit = np.flatnonzero(s >= (least - slack)[:, None])
                    else:
                        n = len(mine) * (y - x)
                        s, m = rough[:n].reshape(len(mine), -1), near[:n].reshape(len(mine), -1)
                        np.matmul(mine_short, short[x:y].T, out=s)
                        if scale is not None:
                            s *= scale[x:y]
                        np.greater_equal(s, np.nextafter((least - off[asked]).astype(np.float32), np.float32(-np.inf))[:, None], out=m)
                        hit = np.flatnonzero(m)
                    # scored one by one, so that equal vectors have equal scores whatever product found them
                    for c in range(0, len(hit), HITS_AT_ONCE):
                        row, col = np.divmod(hit[c:c + HITS_AT_ONCE], y - x)
                        offer(asked[row], places[x + col], np.einsum("ij,ij->i", mine[row], units[x + col]))
        lists.cut()
        row, col = np.nonzero(np.arange(max(1, int(lists.fill.max(initial=0)))) < lists.fill[:, None])
        place, score = lists.place[row, col], lists.score[row, col]
        order = np.lexsort((place, -score, row))
        return row[order], place[order], score[order]

    def sent(t: int, group: Group, ids: pa.Array, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        c, s = group.ids.take(pa.array(place)), pa.array(score)
        if not piece:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), c, s], names=["q", "c", "s"])
        return list_rows([("q", ids)], row, [("c", c), ("s", s)], piece, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, min(block_rows, LIST_ENTRIES // (k + max(k, block_rows))))
        tile, held, group = None, [], None
        for batch in batches:
            for (t, side), part in runs_of(batch, ["_t", "_side"]):
                if t != tile:
                    tile, held, group = t, [], None
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    group, held = Group(held, normalize), []
                if group is None:
                    continue
                for d, at, m in by_dimension(part.column("_v")):
                    ids = part.column("_q").take(pa.array(at))
                    reads = part.column("_reads").take(pa.array(at)).to_pylist() if "_reads" in part.schema.names else None
                    for a in range(0, len(at), rows):
                        unit = _unit_rows(m[a:a + rows]) if normalize else m[a:a + rows].astype(np.float64)
                        some = ids.slice(a, rows)
                        yield sent(t, group, some, *scored(group, some, d, unit, reads and reads[a:a + rows]))

    return run


def _stretches(reads: list | None, cells: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(queries, from, to): stretches of corpus rows whose cells the same queries read; ``reads``: per query the bits of its cells (None: all)."""
    everyone = np.arange(n)
    if reads is None:
        yield everyone, 0, int(first[-1])
        return
    bits = np.unpackbits(np.frombuffer(b"".join(reads), dtype=np.uint8).reshape(n, -1), axis=1)[:, cells].astype(bool)
    same = (bits[:, 1:] == bits[:, :-1]).all(axis=0) if len(cells) > 1 else np.zeros(0, dtype=bool)
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(cells)]
    for a, b in zip(cuts, cuts[1:]):
        asked = np.flatnonzero(bits[:, a])
        if len(asked):
            yield asked, int(first[a]), int(first[b])


def tile_top_k(queries: DataFrame, corpus: DataFrame, k: int, tiles: int, *, exclude_self: bool = False, clamp: bool = False,
               positive_only: bool = False, normalize: bool = True, other_dim_zero: bool = False, block_rows: int = 2048, lists: bool = False) -> DataFrame:
    """(q, c, s): the k best of every query in every tile; as lists: (q, t, r, c, s) with the tile and the ranks in it. ``queries``: _t, _q, _v and, where it
    reads some cells only, _reads; ``corpus``: _t, _c, _v and _cell."""
    kinds = [queries.schema["_v"].dataType, corpus.schema["_v"].dataType]
    if kinds[0] != kinds[1]:
        queries, corpus = (x.withColumn("_v", F.col("_v").cast("array<double>")) for x in (queries, corpus))
    q, c = queries.schema["_q"].dataType, corpus.schema["_c"].dataType
    schema = (lists_schema(q, c, "t") if lists else
              T.StructType([T.StructField("q", q), T.StructField("c", c), T.StructField("s", T.DoubleType())]))
    rows = dealt([corpus.withColumn("_side", F.lit(0)), queries.withColumn("_side", F.lit(1))], tiles, ["_side"])
    return rows.mapInArrow(_tile(k, exclude_self, clamp, positive_only, normalize, other_dim_zero, block_rows, PIECE if lists else 0), schema)


# ---------------------------------------------------------------- lists
def lists_schema(q: T.DataType, c: T.DataType, of: str) -> T.StructType:
    """(q, ``of``, r, c, s): a piece of the list of q: ranks, items and scores."""
    return T.StructType([T.StructField("q", q), T.StructField(of, T.IntegerType()), T.StructField("r", T.ArrayType(T.IntegerType())),
                         T.StructField("c", T.ArrayType(c)), T.StructField("s", T.ArrayType(T.DoubleType()))])


def list_rows(keys: list[tuple[str, pa.Array]], row: np.ndarray, values: list[tuple[str, pa.Array]], piece: int, t: int | None = None,
              rank: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries, those of a row of ``keys`` side by side, as lists of at most ``piece`` entries with their ranks (in the row, if not given)."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[:len(row)])
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    starts = np.flatnonzero(nth % piece == 0)
    ends = pa.array(np.append(starts, len(row)).astype(np.int32))
    lists = [("r", pa.array((nth + 1 if rank is None else rank).astype(np.int32))), *values]
    named = [(n, c.take(pa.array(row[starts]))) for n, c in keys]
    if t is not None:
        named.append(("t", pa.array(np.full(len(starts), t, dtype=np.int32))))
    named += [(n, pa.ListArray.from_arrays(ends, v)) for n, v in lists]
    return pa.RecordBatch.from_arrays([v for _, v in named], names=[n for n, _ in named])


def id_order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, those that are null first."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, cut: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.Table]:
    """Tables of rows ordered by ``key`` in which no key is cut. ``cut`` shortens the rows of one key that fills a whole table."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(codes[1:] != codes[:-1])
        last = int(new[-1]) + 1 if len(new) else 0
        if last:
            yield rows.slice(0, last).combine_chunks()
        held = rows.slice(last).combine_chunks()
        if cut and not last:
            held = cut(held)
    if held is not None and held.num_rows:
        yield held


def _merge(k: int) -> Callable:
    def best(rows: pa.Table) -> pa.RecordBatch:
        q, c = rows.column("q").combine_chunks(), rows.column("c").combine_chunks()
        row = pc.list_parent_indices(c).to_numpy(zero_copy_only=False)
        code = q.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[row]
        items, s = c.flatten(), rows.column("s").combine_chunks().flatten()
        order = np.lexsort((id_order(items), -s.to_numpy(zero_copy_only=False), code))
        first = np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
        rank = np.arange(len(order)) - first[code[order]] + 1
        order, rank = order[rank <= k], rank[rank <= k]
        # a piece holds items of one group of them
        g = rows.column("g").combine_chunks().to_numpy(zero_copy_only=False)[row]
        by = np.lexsort((rank, g[order], code[order]))
        order, rank = order[by], rank[by]
        new = np.append(True, (code[order][1:] != code[order][:-1]) | (g[order][1:] != g[order][:-1]))[:len(order)]
        at = row[order][new]
        return list_rows([("q", q.take(pa.array(at))), ("g", pa.array(g[order][new].astype(np.int32)))], np.cumsum(new) - 1,
                         [("c", items.take(pa.array(order))), ("s", s.take(pa.array(order)))], PIECE, rank=rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, "q", lambda x: pa.Table.from_batches([best(x)]).select(x.column_names)):
            yield best(rows)

    return run


@dataclass
class TopLists:
    """Top-k lists as (q, g, r, c, s): ranks, items and scores of a list in pieces, each of one group of the items."""

    rows: DataFrame
    groups: int     # g = pmod(xxhash64(item), groups)

    def edges(self, q: str, c: str, s: str, r: str) -> DataFrame:
        """A row per entry."""
        return self.rows.select(F.col("q").alias(q), F.inline(F.arrays_zip("c", "s", "r")).alias(c, s, r))


# ---------------------------------------------------------------- exact search
def _pair_stats(q: DataFrame, qvec: str, c: DataFrame, cvec: str) -> tuple[int, int, int]:
    """(query rows, corpus rows, corpus dim) in one job (two aggregates unioned)."""
    a = q.agg(F.lit(0).alias("side"), F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("d"))
    b = c.agg(F.lit(1).alias("side"), F.count(F.lit(1)).alias("n"), F.max(F.size(cvec)).alias("d"))
    rows = {r["side"]: r for r in a.unionByName(b).collect()}
    return int(rows[0]["n"] or 0), int(rows[1]["n"] or 0), int(rows[1]["d"] or 0)


def rank_top_k(scored: DataFrame, query_id: str, item_id: str, score: str, k: int,
               rank_col: str = "rank", tie_cols: list | None = None) -> DataFrame:
    """Keep the k best rows per query: score desc, then tie columns (default item id asc)."""
    order = [F.col(score).desc()] + [F.col(c) for c in (tie_cols or [item_id])]
    w = Window.partitionBy(query_id).orderBy(*order)
    return scored.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int, *,
                query_id: str, query_vec: str, item_id: str, item_vec: str,
                out_query: str | None = None, out_item: str | None = None,
                exclude_self: bool = False, clamp: bool = False, positive_only: bool = False,
                absent_items_score_zero: bool = False, normalize: bool = True,
                block_rows: int = 2048, broadcast_limit_bytes: int = 256 << 20) -> DataFrame:
    """Top-k items per query by cosine of present vectors (exact).

    Output: (out_query, out_item, similarity DOUBLE, rank INT), rank 1 = best, ties by item id.
    ``clamp`` ranks by the score clamped to [0, 1]; ``positive_only`` drops scores <= 0;
    ``absent_items_score_zero`` keeps items without a vector as zero vectors (score 0) instead
    of dropping them, as the exact per-pair path does. ``block_rows``: rows of either side in one matrix product;
    ``broadcast_limit_bytes``: bytes of the corpus that may be copied to every share of the queries as one group, within the bounds of ``GROUP_BYTES``.
    """
    out_query = out_query or query_id
    out_item = out_item or item_id
    if out_query == out_item:
        raise ValueError("query and item output columns need different names (set out_item)")
    found = top_k_lists(queries, corpus, k, query_id=query_id, query_vec=query_vec, item_id=item_id, item_vec=item_vec, exclude_self=exclude_self, clamp=clamp,
                        positive_only=positive_only, absent_items_score_zero=absent_items_score_zero, normalize=normalize, block_rows=block_rows,
                        broadcast_limit_bytes=broadcast_limit_bytes)
    return found.edges(out_query, out_item, "similarity", "rank")


def top_k_lists(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str, query_vec: str, item_id: str, item_vec: str, exclude_self: bool = False,
                clamp: bool = False, positive_only: bool = False, absent_items_score_zero: bool = False, normalize: bool = True,
                block_rows: int = 2048, broadcast_limit_bytes: int = 256 << 20) -> TopLists:
    """The lists of ``exact_top_k`` as lists."""
    q = queries.where(present(query_vec)).select(query_id, query_vec)
    if absent_items_score_zero:  # an absent vector has dimension 0, which no query has
        empty = F.array().cast(corpus.schema[item_vec].dataType)
        c = corpus.select(item_id, F.when(present(item_vec), F.col(item_vec)).otherwise(empty).alias(item_vec))
    else:
        c = corpus.where(present(item_vec)).select(item_id, item_vec)
    n_q, n_c, dim = _pair_stats(q, query_vec, c, item_vec)
    if n_q == 0 or n_c == 0 or k <= 0:
        return TopLists(queries.sparkSession.createDataFrame([], lists_schema(queries.schema[query_id].dataType, corpus.schema[item_id].dataType, "g")), 1)
    room = min(GROUP_BYTES, max(LEAST_GROUP_BYTES, broadcast_limit_bytes))
    # a group of vectors in double is held in both precisions, one of floats as it is
    single = normalize and {queries.schema[query_vec].dataType, corpus.schema[item_vec].dataType} == {T.ArrayType(T.FloatType())}
    groups = math.ceil(n_c * max(1, dim) * (8 / 3 if single else 8) / room)
    shares = tiles_of(n_q, n_c, groups)
    at = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_rows = q.select(at(query_id, shares).alias("_s"), F.col(query_id).alias("_q"), F.col(query_vec).alias("_v"), every(groups).alias("_g"))
    c_rows = c.select(at(item_id, groups).alias("_g"), F.col(item_id).alias("_c"), F.col(item_vec).alias("_v"), every(shares).alias("_s"))
    tile = (F.col("_g") * shares + F.col("_s")).alias("_t")
    local = tile_top_k(q_rows.select(tile, "_q", "_v"), c_rows.select(tile, "_c", "_v"), k, groups * shares, exclude_self=exclude_self, clamp=clamp,
                       positive_only=positive_only, normalize=normalize, other_dim_zero=absent_items_score_zero, block_rows=block_rows, lists=True)
    local = local.select("q", F.floor(F.col("t") / shares).cast("int").alias("g"), "r", "c", "s")
    if groups == 1 and q.agg(F.count_distinct(query_id)).first()[0] == n_q:
        return TopLists(local, 1)
    merged = local.repartition("q").sortWithinPartitions("q").mapInArrow(_merge(k), local.schema)
    return TopLists(merged, groups)


def weighted_top_k(queries: DataFrame, corpus: DataFrame, k: int, fields: list[tuple[str, str, float]], *,
                   query_id: str, item_id: str, out_query: str | None = None,
                   out_item: str | None = None, **kw) -> DataFrame:
    """Top-k by the weighted field similarity sum(w_i * cos(q_i, c_i)) / sum(w_i).

    A weighted sum of cosines is one inner product of concatenated vectors: the query side is
    ``concat(w_i * unit(q_i))``, the item side ``concat(unit(c_i))``, with an absent field
    replaced by zeros (cosine 0). So the exact blocked kernel runs unchanged, without
    normalisation, on vectors of ``sum(dim_i)`` entries.
    """
    from matchspark.functions.vector import l2_normalize

    total = float(sum(w for _, _, w in fields))
    row = corpus.agg(*[F.max(F.size(cf)).alias(f"d{i}") for i, (_, cf, _) in enumerate(fields)]).first()
    dims = {qf: int(row[f"d{i}"] or 0) for i, (qf, _, _) in enumerate(fields)}

    def side(df, idc, cols_w):
        parts = []
        for col, w, d in cols_w:
            unit = l2_normalize(col)
            scaled = F.transform(unit, lambda x: x * F.lit(w)) if w != 1.0 else unit
            parts.append(F.when(present(col), scaled).otherwise(F.array_repeat(F.lit(0.0), d)))
        return df.select(idc, F.concat(*parts).alias("wvec"))

    qside = side(queries, query_id, [(qf, w / total if total else 0.0, dims[qf]) for qf, _, w in fields])
    cside = side(corpus, item_id, [(cf, 1.0, dims[qf]) for qf, cf, _ in fields])
    return exact_top_k(qside, cside, k, query_id=query_id, query_vec="wvec", item_id=item_id,
                       item_vec="wvec", out_query=out_query, out_item=out_item, normalize=False, **kw)
