"""Exact nearest-neighbour scans.

The gallery streams through Arrow batches; each task keeps only the best k per
query, so nothing but k rows per query and task is ever shuffled. Two ways to
bring queries and gallery together:

* up to `MAX_SHIPPED_QUERIES` queries or `MAX_SHIPPED_BYTES` (checked by a bounded fetch): the packed
  queries travel to every task and the gallery is scanned where it lies, with
  no shuffle of it at all;
* beyond that: queries are cut into blocks, one a task, and the whole gallery streams past
  each block. A query's list is finished in one task, so k rows a query leave it, and
  there are as many blocks as shuffle partitions, up to `BLOCKS`, until they are full: what is shuffled grows
  with the tables, not with their product. Sorted partitions let the block be read first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.session import shuffle_partitions

MAX_SHIPPED_QUERIES = 8192
# Bytes of their values, at eight a component: wide vectors travel in smaller numbers.
MAX_SHIPPED_BYTES = 256 << 20
# Blocks on the shuffled way while they have room, and the most queries of one; fewer if their lists or vectors are long.
BLOCKS = 32
QUERY_BLOCK = 1 << 16
# Numbers (components or list entries) that the queries of a block may have: some 200 MB with the work on them.
BLOCK_NUMBERS = 2 << 20
# Cells of the score matrix worked on at once.
_TILE = 1 << 18
# Gallery rows of such a tile: no power of two, so that rows of the tile don't share cache lines' places.
_COLUMNS = 1000
# Pairs whose vectors are laid side by side at once.
_PAIRS = 1 << 14
# Share of the cells up to which single pairs are cheaper than a product.
_FEW = 1 / 32

METRICS = ("hamming", "cosine", "dot", "euclid")


# --- numpy kernels --------------------------------------------------------

def _sortable(x: np.ndarray) -> np.ndarray:
    """Non-NaN keys -> int64 in the same order."""
    if x.dtype != np.float32:
        return x.astype(np.int64)
    bits = (x + np.float32(0)).view(np.int32)
    return np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits).astype(np.int64)


def _prepare(metric: str, m: np.ndarray) -> tuple:
    if metric == "hamming":  # word-major, so that one word of all rows is contiguous
        return (np.ascontiguousarray(m.T).view(np.uint64),)
    m = m.astype(np.float64)
    return m, np.sqrt(np.einsum("ij,ij->i", m, m))


def _keys(metric: str, q: tuple, g: tuple) -> np.ndarray:
    """(queries x gallery) keys, smaller is nearer: bits, or float32 of the negated score."""
    if metric == "hamming":
        if len(q[0]) == 1:
            return np.bitwise_count(np.bitwise_xor(q[0][0][:, None], g[0][0][None, :]))
        shape = (q[0].shape[1], g[0].shape[1])
        out, differ, ones = (np.zeros(shape, t) for t in (np.uint16, np.uint64, np.uint8))
        for qw, gw in zip(q[0], g[0]):
            np.bitwise_xor(qw[:, None], gw[None, :], out=differ)
            out += np.bitwise_count(differ, out=ones)
        return out
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        dots = q[0] @ g[0].T
        if metric == "dot":
            key = -dots
        elif metric == "euclid":
            key = np.sqrt(np.maximum(q[1][:, None] ** 2 + g[1][None, :] ** 2 - 2 * dots, 0))
        else:
            norms = q[1][:, None] * g[1][None, :]
            key = -np.where(norms == 0, 0.0, dots / norms)
    key = key.astype(np.float32)
    if not (np.isfinite(q[1]).all() and np.isfinite(g[1]).all()):
        key[np.isnan(key)] = np.inf
    return key


def _score(metric: str, key: np.ndarray) -> np.ndarray:
    if metric == "hamming":
        return key.astype(np.int32)
    return key if metric == "euclid" else np.float32(0) - key


def _rows(metric: str, q: tuple, part: slice | np.ndarray) -> tuple:
    return (q[0][:, part],) if metric == "hamming" else tuple(a[part] for a in q)


def _pair_keys(metric: str, q: tuple, g: tuple, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """`_keys` of single pairs of finite vectors."""
    out = np.empty(len(row), np.float32)
    step = max(64, (_PAIRS << 2) // max(1, q[0].shape[1]))  # half a megabyte of each side
    for s in range(0, len(row), step):
        r, c = row[s : s + step], col[s : s + step]
        dots = np.einsum("ij,ij->i", q[0][r], g[0][c])
        if metric == "cosine":
            norms = q[1][r] * g[1][c]
            dots = np.where(norms == 0, 0.0, dots / np.where(norms == 0, 1.0, norms))
        out[s : s + step] = -dots
    return out


def _plain(metric: str, m: tuple) -> np.ndarray | None:
    """Rows whose products float32 can bound: finite, and zero or of a length far from its limits. None: no measure for it."""
    if metric not in ("cosine", "dot"):
        return None
    return np.flatnonzero((m[1] == 0) & ~m[0].any(axis=1) | (m[1] > 1e-15) & (m[1] < 1e15))


def _unit(m: tuple, rows: slice | np.ndarray) -> np.ndarray:
    length = m[1][rows]
    return (m[0][rows] / np.where(length == 0, 1.0, length)[:, None]).astype(np.float32)


def _cells(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table with few true cells."""
    flat = np.zeros(-(-hit.size // 8) * 8, bool)
    flat[: hit.size] = hit.ravel()
    some = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(some[flat[some]], hit.shape[1])


class _Nearest:
    """Best k gallery ids per query by one measure, nearest first, ties by id.

    The first rows fill the lists. After that only pairs that come before a query's current worst are kept, in a
    buffer merged when it has grown.
    """

    def __init__(self, metric: str, k: int, n: int):
        self.metric, self.k, self.n = metric, k, n
        kind = np.uint16 if metric == "hamming" else np.float32
        self.best_key = np.empty((n, 0), dtype=kind)
        self.best_id = np.empty((n, 0), dtype=np.int64)
        self.buffer, self.buffered = [], 0

    @property
    def full(self) -> bool:
        return self.best_key.shape[1] >= self.k

    def fill(self, row: int, key: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of some rows' keys against a few gallery rows sorted by id, together with what is listed."""
        b = len(gid)
        shift = max(1, int(b - 1).bit_length())
        if b > self.k:
            tagged = (_sortable(key) << shift) | np.arange(b)
            col = np.partition(tagged, self.k - 1, axis=1)[:, : self.k] & ((1 << shift) - 1)
        else:
            col = np.broadcast_to(np.arange(b), key.shape)
        part = slice(row, row + len(key))
        key = np.concatenate([self.best_key[part], np.take_along_axis(key, col, axis=1)], axis=1)
        cid = np.concatenate([self.best_id[part], gid[col]], axis=1)
        pick = np.lexsort((cid, key), axis=1)[:, : self.k]
        return np.take_along_axis(key, pick, axis=1), np.take_along_axis(cid, pick, axis=1)

    def add(self, row: np.ndarray, key: np.ndarray, cid: np.ndarray) -> None:
        """Keep of these pairs what comes before its query's worst."""
        worst = self.best_key[row, -1]
        near = np.flatnonzero((key < worst) | ((key == worst) & (cid < self.best_id[row, -1])))
        if len(near):
            self.buffer.append((row[near], key[near], cid[near]))
            self.buffered += len(near)

    @property
    def grown(self) -> bool:
        return self.buffered > max(self.n * self.k, _TILE)

    def merge(self) -> None:
        if not self.buffer:
            return
        n, k = self.best_key.shape
        row = np.concatenate([np.repeat(np.arange(n), k), *[x[0] for x in self.buffer]])
        key = np.concatenate([self.best_key.ravel(), *[x[1] for x in self.buffer]])
        cid = np.concatenate([self.best_id.ravel(), *[x[2] for x in self.buffer]])
        order = np.lexsort((cid, (row << 32) + _sortable(key)))
        starts = np.searchsorted(row[order], np.arange(n))
        pick = order[starts[:, None] + np.arange(k)]
        self.best_key, self.best_id = key[pick], cid[pick]
        self.buffer, self.buffered = [], 0


class _TopK:
    """Best k gallery ids per query.

    Most pairs are ruled out by bits or by a float32 product of unit vectors, whose error has a bound (`_slack`); keys in
    double are computed for the first rows, for what is left, and for vectors whose length float32 can't be trusted with.
    """

    def __init__(self, metric: str, k: int, ids: np.ndarray, matrix: np.ndarray, extra=None):
        self.metric, self.ids = metric, ids
        self.q = _prepare(metric, matrix)
        self.width = matrix.shape[1]
        self.lists = self._lists(metric, k, len(ids))
        self.head = max(64, *(50 * x.k for x in self.lists))
        self.plain = _plain(metric, self.q)
        if self.plain is not None:
            self.unit = _unit(self.q, self.plain)
            self.rest = np.setdiff1d(np.arange(len(ids)), self.plain)
            self._bounds()

    @staticmethod
    def _lists(metric: str, k: int, n: int) -> list[_Nearest]:
        return [_Nearest(metric, k, n)]

    def feed(self, gid: np.ndarray, gmat: np.ndarray) -> None:
        if len(self.ids) == 0 or len(gid) == 0:
            return
        order = np.argsort(gid, kind="stable")
        gid, gmat = gid[order], gmat[order]
        at = 0
        while at < len(gid) and not all(x.full for x in self.lists):
            self._fill(gid[at : at + self.head], _prepare(self.metric, gmat[at : at + self.head]))
            at += self.head
        for s in range(at, len(gid), _COLUMNS):
            part = slice(s, s + _COLUMNS)
            self._pass(gid[part], _prepare(self.metric, gmat[part]))

    def _fill(self, gid: np.ndarray, g: tuple) -> None:
        step = max(1, _TILE // len(gid))
        for x in self.lists:
            found = [x.fill(s, _keys(x.metric, _rows(x.metric, self.q, slice(s, s + step)), g), gid)
                     for s in range(0, len(self.ids), step)]
            x.best_key, x.best_id = (np.concatenate(f) for f in zip(*found))
        self._bounds()

    def _pass(self, gid: np.ndarray, g: tuple) -> None:
        if self.metric == "hamming":
            self._bits(gid, g)
            return
        every = np.arange(len(self.ids))
        plain = _plain(self.metric, g)
        if self.plain is None or plain is None:
            self._exact(self.lists, every, gid, g)
            return
        if len(plain) < len(gid):
            odd = np.setdiff1d(np.arange(len(gid)), plain)
            self._exact(self.lists, every, gid[odd], _rows(self.metric, g, odd))
            gid, g = gid[plain], _rows(self.metric, g, plain)
        if len(gid):
            self._exact(self.lists, self.rest, gid, g)
            self._products(gid, g)

    def _exact(self, lists: list[_Nearest], rows: np.ndarray, gid: np.ndarray, g: tuple) -> None:
        """Every key in double."""
        step = max(1, _TILE // len(gid))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            for x in lists:
                key = _keys(x.metric, _rows(x.metric, self.q, part), g)
                row, col = _cells(key <= x.best_key[part, -1, None])
                x.add(part[row], key[row, col], gid[col])
            self._grown()

    def _bits(self, gid: np.ndarray, g: tuple) -> None:
        best = self.lists[0]
        step = max(1, _TILE // len(gid))
        for s in range(0, len(self.ids), step):
            key = _keys("hamming", _rows("hamming", self.q, slice(s, s + step)), g)
            worst = best.best_key[s : s + step, -1]
            hit = np.flatnonzero(key.min(axis=1) <= worst)
            if len(hit):
                key = key[hit]
                row, col = _cells(key <= worst[hit, None])
                best.add(hit[row] + s, key[row, col].astype(np.uint16), gid[col])
                self._grown()

    def _products(self, gid: np.ndarray, g: tuple) -> None:
        length = g[1]
        other = np.ascontiguousarray(_unit(g, slice(None)).T)
        longest, shortest = length.max(), length.min()
        step = max(1, _TILE // len(gid))
        out = np.empty((min(step, len(self.plain)), len(gid)), np.float32)
        for s in range(0, len(self.plain), step):
            rows = self.plain[s : s + step]
            near = np.matmul(self.unit[s : s + step], other, out=out[: len(rows)])
            top = near.max(axis=1).astype(np.float64)
            for x, need in zip(self.lists, self.need):
                need = need[s : s + step]
                if x.metric == "dot":
                    need = need - self._slack() * longest
                    hit = np.flatnonzero(np.where(top < 0, top * shortest, top * longest) >= need)
                else:
                    need = need - self._slack()
                    hit = np.flatnonzero(top >= need)
                if not len(hit):
                    continue
                found = near if len(hit) == len(rows) else near[hit]
                if x.metric == "dot":
                    found = found * length.astype(np.float32)
                row, col = _cells(found >= np.nextafter(need[hit].astype(np.float32), np.float32(-np.inf))[:, None])
                if len(row) > found.size >> 4:  # many: cheaper all together
                    self._exact([x], rows[hit], gid, g)
                    continue
                row = rows[hit[row]]
                x.add(row, _pair_keys(x.metric, self.q, g, row, col), gid[col])
            self._grown()

    def _slack(self) -> float:
        """More than float32 can be wrong by in a product of two unit vectors, and in its product with a length of 1."""
        return (self.width + 8) * 2.0**-23

    def _grown(self) -> None:
        if any(x.grown for x in self.lists):
            self._merge()

    def _merge(self) -> None:
        for x in self.lists:
            x.merge()
        self._bounds()

    def _bounds(self) -> None:
        """What a plain query's product with a unit vector (dot: times the length) must reach to come into a list."""
        if self.plain is None or not all(x.full for x in self.lists):
            return
        length = np.where(self.q[1] == 0, 1.0, self.q[1])[self.plain]
        self.need = []
        for x in self.lists:
            worst = np.minimum(-x.best_key[self.plain, -1].astype(np.float64), np.finfo(np.float32).max)
            # scores that float32 rounds to the worst one: relative, and next to zero
            worst = worst - (np.abs(worst) * 2.0**-22 + 1e-44)
            self.need.append(worst / length if x.metric == "dot" else worst)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for x in self.lists:
            per = x.best_id.shape[1]
            if per == 0:
                continue
            step = max(1, 65536 // per)
            for s in range(0, len(self.ids), step):
                part = slice(s, s + step)
                ids = np.repeat(self.ids[part], per)
                yield self._batch(x, ids, x.best_id[part].ravel(), _score(x.metric, x.best_key[part]).ravel())

    @staticmethod
    def _batch(x: _Nearest, ids: np.ndarray, image: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(image), pa.array(value)],
            names=["query_id", "image_id", "distance" if x.metric == "hamming" else "score"])

    @staticmethod
    def schema(metric: str) -> str:
        value = "distance int" if metric == "hamming" else "score float"
        return f"query_id long, image_id long, {value}"


class _TopKAndDot(_TopK):
    """Best k by the measure, and the best one by inner product, from the same products."""

    @staticmethod
    def _lists(metric: str, k: int, n: int) -> list[_Nearest]:
        return [_Nearest(metric, k, n), _Nearest("dot", 1, n)]

    @staticmethod
    def _batch(x: _Nearest, ids: np.ndarray, image: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(image), pa.array(value), pa.array(np.repeat(x.metric, len(ids)))],
            names=["query_id", "image_id", "score", "measure"])

    @staticmethod
    def schema(metric: str) -> str:
        return "query_id long, image_id long, score float, measure string"


class _Ahead:
    """How many gallery rows beat, or tie with, each query's own answer.

    Queries of one answer (the damaged copies of a picture) lie close together, so most rows are ruled out for all of them
    by one comparison with their common centre and the triangle inequality: of angles, in float32 with a bound on its error,
    or of bits. Pairs that are left are compared in float32 with the same bound, and in double where it can't tell. A
    group's widest queries, for which the centre rules too little out, meet the rows themselves.
    """

    numbers = 8 << 20  # of a block: half of them lie in double, once; answers keep together
    together = True

    def __init__(self, metric: str, k: int, ids: np.ndarray, matrix: np.ndarray, extra):
        self.metric, self.ids = metric, ids
        self.q = _prepare(metric, matrix)
        self.width = matrix.shape[1]
        self.answer, own = extra
        self.own = own.astype(np.uint16) if metric == "hamming" else (
            own if metric == "euclid" else -own).astype(np.float32)
        self.ahead = np.zeros(len(ids), dtype=np.int64)
        self.found, self.waiting = [], 0
        self.by_answer = np.argsort(self.answer, kind="stable")
        self.answers = self.answer[self.by_answer]
        self.space = {}
        self.plain = np.arange(len(ids)) if metric == "hamming" else _plain(metric, self.q)
        if self.plain is None:
            self.plain = np.empty(0, np.int64)
        elif metric != "hamming":
            self.plain = self.plain[np.isfinite(self.own[self.plain])]
        self.rest = np.setdiff1d(np.arange(len(ids)), self.plain)
        self._group()

    def _group(self) -> None:
        """`members`: a row per answer, its queries from the closest to the centre's limit to the farthest; -1: none."""
        answer, group, n = np.unique(self.answer[self.plain], return_inverse=True, return_counts=True)
        # an answer of very many queries is no group of close ones: rows of at most eight
        order = np.argsort(group, kind="stable")
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        row = np.unique(group[order] * (len(order) // 8 + 1) + place // 8, return_inverse=True)[1]
        wide = int(min(8, n.max(initial=0)))
        members = np.full((int(row.max(initial=-1)) + 1, wide), -1)
        members[row, place % 8] = self.plain[order]
        if self.metric == "hamming":
            self._bit_centres(members)
        else:
            self._centres(members)
        loose = np.where(members < 0, np.inf, self.loose[members])
        self.members = np.take_along_axis(members, np.argsort(loose, axis=1, kind="stable"), axis=1)
        self.limits = {}

    def _bit_centres(self, members: np.ndarray) -> None:
        """The word of a row's queries that leaves least, by each query's limit: its own bits and those to the centre."""
        words, size = self.q[0].T, members.shape[1]
        self.centre = np.empty((self.width, len(members)), np.uint64)
        self.loose = np.zeros(len(self.ids))
        step = max(1, _TILE // max(1, size * size * self.width))
        for s in range(0, len(members), step):
            part = members[s : s + step]
            away = np.bitwise_count(words[part][:, :, None] ^ words[part][:, None]).sum(axis=-1)
            limit = (away + self.own[part].astype(np.int64)[:, :, None]).astype(np.float64)
            pick = self._least((limit - 32 * self.width) / (4 * math.sqrt(self.width)), part >= 0, part >= 0)
            at = np.arange(len(part))
            self.centre[:, s : s + step] = words[part[at, pick]].T
            self.loose[part[part >= 0]] = limit[at, :, pick][part >= 0]

    def _centres(self, members: np.ndarray) -> None:
        """The unit vector, of a row's queries or in their mean direction, that leaves least, and each query's angle to it."""
        self.unit = np.zeros((len(self.ids), self.width), np.float32)
        self.unit[self.plain] = _unit(self.q, self.plain)
        # scores below `low` surely lose, above `high` surely win; what lies between is computed in double
        own = -self.own.astype(np.float64)
        off = np.abs(own) * 2.0**-22 + 1e-44
        length = np.where((self.q[1] == 0) | (self.metric == "cosine"), 1.0, self.q[1])
        with np.errstate(invalid="ignore", over="ignore"):
            self.low, self.high = (own - off) / length, (own + off) / length
            gap = np.arccos(np.clip(self.low, -1, 1))
        self.centre = np.empty((len(members), self.width), np.float32)
        self.angle, self.loose = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        step = max(1, _TILE // max(1, self.width * members.shape[1]))
        for s in range(0, len(members), step):
            part = members[s : s + step]
            there = part >= 0
            every = np.where(there[:, :, None], self.unit[part], np.float32(0)).astype(np.float64)
            mean = every.sum(axis=1, keepdims=True)
            mean /= np.maximum(np.sqrt((mean * mean).sum(axis=2, keepdims=True)), 1e-3)
            centre = np.concatenate([every, mean.astype(np.float32)], axis=1)
            # float32 units have lengths a little off 1
            angle = np.arccos(np.clip(every @ centre.transpose(0, 2, 1) - self._slack(), -1, 1))
            limit = np.minimum(angle + gap[part][:, :, None], np.pi)
            pick = self._least(-np.cos(limit) * math.sqrt(self.width), there, np.pad(there, ((0, 0), (0, 1)), constant_values=True))
            at = np.arange(len(part))
            self.centre[s : s + step] = centre[at, pick]
            self.angle[part[there]] = angle[at, :, pick][there]
            self.loose[part[there]] = limit[at, :, pick][there]

    @staticmethod
    def _least(z: np.ndarray, members: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The centre for which the members' shares of all rows, guessed from their limits in deviations, add up to least."""
        with np.errstate(over="ignore", invalid="ignore"):
            share = np.where(members[:, :, None], 1 / (1 + np.exp(-1.7 * z)), 0).sum(axis=1)
        return np.where(centres, share, np.inf).argmin(axis=1)

    _slack = _TopK._slack

    def feed(self, gid: np.ndarray, gmat: np.ndarray) -> None:
        if len(self.ids) == 0 or len(gid) == 0:
            return
        g = _prepare(self.metric, gmat)
        if self.metric == "hamming":
            self._tiles(gid, g)
            return
        every = np.arange(len(self.ids))
        plain = _plain(self.metric, g)
        if plain is None:
            self._each(every, gid, g)
            return
        if len(plain) < len(gid):
            odd = np.setdiff1d(np.arange(len(gid)), plain)
            self._each(every, gid[odd], _rows(self.metric, g, odd))
        plain = plain[np.argsort(g[1][plain], kind="stable")]  # tiles of nearly equal lengths
        gid, g = gid[plain], _rows(self.metric, g, plain)
        self._each(self.rest, gid, g)
        self._tiles(gid, g)

    def _each(self, rows: np.ndarray, gid: np.ndarray, g: tuple) -> None:
        """Every key in double."""
        if not len(gid):
            return
        step = max(1, _TILE // len(gid))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            key = _keys(self.metric, _rows(self.metric, self.q, part), g)
            other = gid[None, :] != self.answer[part, None]
            self.ahead[part] += ((key <= self.own[part, None]) & other).sum(axis=1)

    def _tiles(self, gid: np.ndarray, g: tuple) -> None:
        # how many of a row's queries the centre speaks for, by chunk of rows
        self.open = {}
        for s in range(0, len(gid), _COLUMNS):
            part = slice(s, s + _COLUMNS)
            tile = _Tile(self, gid[part], _rows(self.metric, g, part))
            limit = self._limit(tile)
            step = max(1, _TILE // len(tile.gid))
            for c in range(0, len(self.members), step):
                self._chunk(c, step, limit, tile)
        self._flush()

    def _limit(self, tile: "_Tile") -> np.ndarray:
        """What a row's centre must be to a gallery row of the tile for a query to be beaten: cosine at least, or bits at most."""
        if tile.steps in self.limits:
            return self.limits[tile.steps]
        if self.metric == "hamming":
            limit, none = self.loose, -1.0
        else:
            longest, shortest = tile.bounds
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                cos = np.where(self.low > 0, self.low / longest, np.where(self.low == 0, 0.0, self.low / shortest))
            limit = np.cos(np.minimum(self.angle + np.arccos(np.clip(cos, -1, 1)) + 1e-6, np.pi)) - 2 * self._slack()
            none = 2.0
        if len(self.limits) >= 16:
            self.limits.clear()
        limit = self.limits[tile.steps] = np.where(self.members < 0, none, limit[self.members]).astype(np.float32)
        return limit

    def _chunk(self, c: int, step: int, limit: np.ndarray, tile: "_Tile") -> None:
        members, limit = self.members[c : c + step], limit[c : c + step]
        used = self.open.get(c, members.shape[1])
        if used:
            near = tile.centres(c, step)
            if c not in self.open:
                some = [tile.within(near[::8], limit[::8, x, None]).mean() for x in range(used)]
                used = self.open[c] = int((np.cumsum(some) < _FEW).sum())
        if used:
            row, col = tile.reached(near, limit[:, :used])
            if len(row) > 4 * _FEW * near.size:
                del self.open[c]  # no longer few: look again at the next tile
            pair, layer = np.nonzero(tile.within(near[row, col][:, None], limit[row, :used]))
            self._pairs(members[row[pair], layer], col[pair], tile)
        for layer in range(used, members.shape[1]):
            rows = members[:, layer]
            rows = rows[rows >= 0]
            if len(rows):
                tile.meet(rows)

    def _pairs(self, row: np.ndarray, col: np.ndarray, tile: "_Tile") -> None:
        other = tile.gid[col] != self.answer[row]
        row, col = row[other], col[other]
        for s in range(0, len(row), _PAIRS >> 2):
            tile.compare(row[s : s + (_PAIRS >> 2)], col[s : s + (_PAIRS >> 2)])

    def count(self, row: np.ndarray) -> None:
        """A rank more for each of these queries; tallied many at a time."""
        self.found.append(row)
        self.waiting += len(row)
        if self.waiting > _TILE << 2:
            self._flush()

    def _flush(self) -> None:
        if self.found:
            self.ahead += np.bincount(np.concatenate(self.found), minlength=len(self.ids))
            self.found, self.waiting = [], 0

    def exact(self, row: np.ndarray, col: np.ndarray, g: tuple) -> None:
        key = _pair_keys(self.metric, self.q, g, row, col)
        self.count(row[key <= self.own[row]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if len(self.ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids), pa.array(self.ahead)], names=["query_id", "ahead"])

    @staticmethod
    def schema(metric: str) -> str:
        return "query_id long, ahead long"


def _ones(table: np.ndarray) -> np.ndarray:
    """True cells of each row."""
    if table.shape[1] % 8 or table.shape[1] > 2040:
        return table.sum(axis=1)
    lanes = table.view(np.uint64).sum(axis=1)  # bytes of at most 255
    return lanes.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


class _Tile:
    """Some gallery rows, laid out for `_Ahead`."""

    def __init__(self, ahead: _Ahead, gid: np.ndarray, g: tuple):
        self.ahead, self.gid, self.g = ahead, gid, g
        self.bits = ahead.metric == "hamming"
        # queries whose answer is here, with its places: these pairs never count
        first, last = (np.searchsorted(ahead.answers, gid, side=x) for x in ("left", "right"))
        n = last - first
        self.mine = ahead.by_answer[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.place = np.repeat(np.arange(len(gid)), n)
        order = np.argsort(self.mine, kind="stable")
        self.mine, self.place = self.mine[order], self.place[order]
        self.steps = None
        if self.bits:
            return
        self.unit = _unit(g, slice(None))
        self.turned = np.ascontiguousarray(self.unit.T)
        self.length = np.ones(len(gid)) if ahead.metric == "cosine" else g[1]
        # in steps of 1 %, so that tiles share their limits
        with np.errstate(divide="ignore"):
            up, down = np.ceil(np.log2(self.length.max()) * 64), np.floor(np.log2(self.length.min()) * 64)
        self.steps = (up, down)
        self.bounds = (2.0 ** (up / 64), 2.0 ** (down / 64))

    def centres(self, c: int, step: int) -> np.ndarray:
        if self.bits:
            return _keys("hamming", (self.ahead.centre[:, c : c + step],), self.g)
        return self._product("centres", self.ahead.centre[c : c + step])

    def _product(self, name: str, unit: np.ndarray) -> np.ndarray:
        return np.matmul(unit, self.turned, out=self._space(name, len(unit), np.float32))

    def _space(self, name: str, rows: int, kind: type) -> np.ndarray:
        space = self.ahead.space.get(name)
        if space is None or space.shape[1] != len(self.gid) or len(space) < rows:
            space = self.ahead.space[name] = np.empty((rows, len(self.gid)), kind)
        return space[:rows]

    def within(self, value: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return value <= limit if self.bits else value >= limit

    def reached(self, near: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that some of their row's queries might count."""
        if self.bits:
            most = np.clip(limit.max(axis=1), -1, np.iinfo(near.dtype).max)
            hit = np.flatnonzero(near.min(axis=1) <= most)
            row, col = _cells(near[hit] <= np.maximum(most[hit], 0).astype(near.dtype)[:, None])
        else:
            least = limit.min(axis=1)
            hit = np.flatnonzero(near.max(axis=1) >= least)
            row, col = _cells((near if len(hit) == len(near) else near[hit]) >= least[hit, None])
        return hit[row], col

    def compare(self, row: np.ndarray, col: np.ndarray) -> None:
        """Single pairs."""
        a = self.ahead
        if self.bits:
            key = np.bitwise_count(a.q[0][:, row] ^ self.g[0][:, col]).sum(axis=0)
            a.count(row[key <= a.own[row]])
            return
        cos = np.einsum("ij,ij->i", a.unit[row], self.unit[col]).astype(np.float64)
        score, off = cos * self.length[col], a._slack() * self.length[col]
        a.count(row[score - off > a.high[row]])
        unsure = (score + off >= a.low[row]) & (score - off <= a.high[row])
        if unsure.any():
            a.exact(row[unsure], col[unsure], self.g)

    def meet(self, rows: np.ndarray) -> None:
        """Some queries with every row."""
        a = self.ahead
        at = np.searchsorted(self.mine, rows)
        end = np.searchsorted(self.mine, rows, side="right")
        mine = np.repeat(np.arange(len(rows)), end - at)
        place = self.place[np.repeat(at - np.cumsum(end - at) + (end - at), end - at) + np.arange(len(mine))]
        if self.bits:
            key = _keys("hamming", _rows("hamming", a.q, rows), self.g)
            # no key is the largest number of its kind
            own = np.minimum(a.own[rows, None], np.iinfo(key.dtype).max).astype(key.dtype)
            some = np.less_equal(key, own, out=self._space("some", len(rows), bool))
            some[mine, place] = False
            a.ahead[rows] += _ones(some)
            return
        score = self._product("queries", a.unit[rows])
        if a.metric == "dot":
            score *= self.length.astype(np.float32)
        score[mine, place] = -np.inf
        off = a._slack() * self.length.max()
        with np.errstate(over="ignore"):
            low = np.nextafter((a.low[rows] - off).astype(np.float32), np.float32(-np.inf))
            high = np.nextafter((a.high[rows] + off).astype(np.float32), np.float32(np.inf))
        some = np.greater_equal(score, low[:, None], out=self._space("some", len(rows), bool))
        n = _ones(some)
        if not n.any():
            return
        sure = np.greater(score, high[:, None], out=self._space("sure", len(rows), bool))
        surely = _ones(sure)
        a.ahead[rows] += surely
        many = n - surely > len(self.gid) * _FEW
        if many.any():  # copies of one picture tie: cheaper all together
            a.ahead[rows[many]] -= surely[many]
            a._each(rows[many], self.gid, self.g)
        left = np.flatnonzero((n > surely) & ~many)
        if len(left):
            row, col = _cells(some[left] & ~sure[left])
            for s in range(0, len(row), _PAIRS):
                a.exact(rows[left[row[s : s + _PAIRS]]], col[s : s + _PAIRS], self.g)


class _Within:
    """How many pictures have a word within `k` bits of each query's, and the nearest of them, ties by id.

    Values are (word, pictures that have it); a query's id is its word.
    """

    nearest = 0

    def __init__(self, metric: str, k: int, ids: np.ndarray, matrix: np.ndarray, extra):
        self.ids, self.width = ids, matrix.shape[1]
        self.words = matrix[:, 0].astype(np.int64)
        self.most = k - self.nearest
        self.matches = np.zeros(len(ids), dtype=np.int64)
        self.bits = np.full(len(ids), 255, dtype=np.uint8)
        self.image = np.zeros(len(ids), dtype=np.int64)

    def feed(self, gid: np.ndarray, gmat: np.ndarray) -> None:
        order = np.argsort(gid, kind="stable")  # of equal distances the first column has the smallest id
        gid, word, n = gid[order], gmat[order, 0], gmat[order, 1]
        step = max(1, _TILE // max(1, len(gid)))
        differ, bits = np.empty((step, len(gid)), np.int64), np.empty((step, len(gid)), np.uint8)
        for s in range(0, len(self.ids), step):
            asked = self.words[s : s + step, None]
            d, b = differ[: len(asked)], bits[: len(asked)]
            np.bitwise_count(np.bitwise_xor(asked, word[None, :], out=d).view(np.uint64), out=b)
            b -= np.uint8(self.nearest)  # bits below the nearest wrap around to the farthest
            row, col = np.nonzero(b <= self.most)
            if not len(row):
                continue
            self.matches[s : s + step] += np.bincount(row, n[col], len(asked)).astype(np.int64)
            hit = np.unique(row)
            col = b[hit].argmin(axis=1)
            key, cid, at = b[hit, col], gid[col], hit + s
            better = (key < self.bits[at]) | ((key == self.bits[at]) & (cid < self.image[at]))
            self.bits[at[better]], self.image[at[better]] = key[better], cid[better]

    def rows(self) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(self.matches)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[found]), pa.array(self.matches[found]),
                 pa.array(self.bits[found].astype(np.int32) + self.nearest), pa.array(self.image[found])],
                names=["word", "matches", "distance", "image_id"])

    @staticmethod
    def schema(metric: str) -> str:
        return "word long, matches long, distance int, image_id long"


class _OthersWithin(_Within):
    """The same without the query's own word."""

    nearest = 1


# --- Arrow plumbing -------------------------------------------------------

def _matrix(lists, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """List column -> (matrix, kept row positions); rows of another length are dropped."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(lengths.max()) if len(lengths) else 0
    kept = np.flatnonzero(lengths == width)
    if len(kept) != len(lengths):
        lists = lists.take(pa.array(kept))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(kept), width), kept


def _numbers(col) -> np.ndarray:
    return col.to_numpy() if isinstance(col, pa.ChunkedArray) else col.to_numpy(zero_copy_only=False)


def _feed(state, ids: np.ndarray, lists) -> None:
    matrix, kept = _matrix(lists, state.width)
    if len(kept):
        state.feed(ids[kept], matrix)


def _in_place(make, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make(*sent.value)
        for b in batches:
            _feed(state, _numbers(b.column(0)), b.column(1))
        yield from state.rows()

    return run


def _paired(make, width: int | None):
    """Rows (block, role, id, values, answer, own) sorted by block, role: queries, then gallery."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, waiting = None, None, []

        def start():
            t = pa.Table.from_batches(waiting)
            matrix, kept = _matrix(t.column("values"), width)
            extra = (_numbers(t.column("answer"))[kept], _numbers(t.column("own"))[kept])
            return make(_numbers(t.column("id"))[kept], matrix, extra)

        for b in batches:
            key = _numbers(b.column(0)).astype(np.int64) * 2 + _numbers(b.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                run_part, role = divmod(int(key[s]), 2)
                if run_part != part:
                    if state is not None:
                        yield from state.rows()
                    part, state, waiting = run_part, None, []
                piece = b.slice(s, e - s)
                if role == 0:
                    waiting.append(piece)
                elif waiting or state is not None:
                    if state is None:
                        state, waiting = start(), []
                    _feed(state, _numbers(piece.column(2)), piece.column(3))
        if state is not None:
            yield from state.rows()

    return run


@dataclass(frozen=True)
class Shipped:
    """A query set small enough to travel to every task."""

    ids: np.ndarray
    matrix: np.ndarray
    extra: tuple[np.ndarray, np.ndarray]

    def __len__(self) -> int:
        return len(self.ids)


def _as_queries(queries: DataFrame, values: str, answer: str | None = None,
                own: str | None = None) -> DataFrame:
    return queries.select(
        F.col("query_id").cast("bigint").alias("id"), F.col(values).alias("values"),
        (F.col(answer) if answer else F.lit(0)).cast("bigint").alias("answer"),
        (F.col(own) if own else F.lit(0)).cast("double").alias("own"))


def _as_gallery(gallery: DataFrame, values: str) -> DataFrame:
    return gallery.select(F.col("image_id").cast("bigint").alias("id"),
                          F.col(values).alias("values"))


def stored_width(gallery: DataFrame, values: str) -> int | None:
    """The most frequent length of the stored lists, of several the one of the smallest image id; None without any that has values."""
    sizes = gallery.where(F.size(values) > 0).groupBy(F.size(values).alias("width")).agg(F.count("*").alias("n"), F.min("image_id").alias("id"))
    row = sizes.orderBy(F.desc("n"), F.asc_nulls_last("id"), "width").first()
    return row["width"] if row else None


def wrong_sized(queries: DataFrame, values: str, width: int | None, id_column: str = "query_id") -> DataFrame:
    """Queries that can't be answered: no values, or not as many as the stored lists have.

    With `id_column` image_id, the gallery rows that take part in no search.
    """
    fits = F.coalesce(F.size(values) == F.lit(width), F.lit(False))
    return queries.where(~fits).select(id_column, F.size(values).alias("size"), F.lit(width).alias("wanted"))


def ship(queries: DataFrame, values: str, max_rows: int = MAX_SHIPPED_QUERIES,
         answer: str | None = None, own: str | None = None, width: int | None = None) -> Shipped | None:
    """Fetch the queries if there are at most `max_rows`, else None.

    One bounded job; it fetches a row more than allowed, never the whole set. Of wide lists fewer are allowed. Queries that don't
    have `width` values get no answer (`wrong_sized` lists them) and keep no other from one.
    """
    if width:
        max_rows = min(max_rows, MAX_SHIPPED_BYTES // (8 * width))
    t = _as_queries(queries, values, answer, own).limit(max_rows + 1).toArrow()
    if t.num_rows > max_rows:
        return None
    matrix, kept = _matrix(t.column("values"), width)
    return Shipped(_numbers(t.column("id"))[kept], matrix,
                   (_numbers(t.column("answer"))[kept], _numbers(t.column("own"))[kept]))


def _scan(reducer, metric: str, k: int, queries: DataFrame, gallery: DataFrame,
          shipped: Shipped | None, width: int | None) -> DataFrame:
    """queries(id, values, answer, own) against gallery(id, values)."""
    spark = queries.sparkSession
    schema = reducer.schema(metric)

    def make(ids, matrix, extra):
        return reducer(metric, k, ids, matrix, extra)

    if shipped is not None:
        sent = spark.sparkContext.broadcast((shipped.ids, shipped.matrix, shipped.extra))
        return gallery.mapInArrow(_in_place(make, sent), schema)

    n = queries.count()
    numbers = getattr(reducer, "numbers", BLOCK_NUMBERS)
    blocks = block_count(n, max(1, k, width or 0), shuffle_partitions(spark), numbers)
    # ids next to each other of one answer stay together; a frequent answer's others go elsewhere
    key = ("answer", F.shiftright("id", 6)) if getattr(reducer, "together", False) else ("id",)
    left = queries.select(
        F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int").alias("block"),
        F.lit(0).alias("role"), "id", "values", "answer", "own")
    right = gallery.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(1).alias("role"), "id", "values",
        F.lit(0).cast("bigint").alias("answer"), F.lit(0.0).alias("own"))
    return (
        left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("block", "role")
        .mapInArrow(_paired(make, width), schema)
    )


def block_count(queries: int, per_query: int, parts: int, numbers: int = BLOCK_NUMBERS) -> int:
    """Blocks of the shuffled way: the same for all tables up to some size, then as many as keep a block within bounds."""
    most = max(1, min(QUERY_BLOCK * numbers // BLOCK_NUMBERS, numbers // per_query))
    return max(1, min(BLOCKS, max(parts, 8)), math.ceil(queries / most))


# --- operators ------------------------------------------------------------

def topk_per_query(cands: DataFrame, k: int, *order, rank: str = "rank") -> DataFrame:
    """Top-k rows per query; the limit is applied on both sides of the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return cands.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest_codes(queries: DataFrame, codes: DataFrame, k: int, code: str = "code",
                  max_shipped: int = MAX_SHIPPED_QUERIES, shipped: Shipped | None = None,
                  width: int | None = None) -> DataFrame:
    """k nearest binary codes of each query by Hamming distance, ties by image id.

    `shipped` saves the fetch when the caller already did it; `width`, the words of a code, saves a pass
    over the gallery that finds it.
    """
    width = width or stored_width(codes, code)
    shipped = shipped or ship(queries, code, max_shipped, width=width)
    partial = _scan(_TopK, "hamming", k, _as_queries(queries, code), _as_gallery(codes, code), shipped, width)
    return topk_per_query(partial, k, "distance", "image_id")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine",
                    vector: str = "vector", max_shipped: int = MAX_SHIPPED_QUERIES,
                    shipped: Shipped | None = None, width: int | None = None) -> DataFrame:
    """k nearest vectors of each query by full-precision score, ties by image id.

    `width` is the model's vector size; without it a pass over the gallery finds it.
    """
    if metric not in METRICS[1:]:
        raise ValueError(f"unknown metric {metric!r}")
    width = width or stored_width(vectors, vector)
    shipped = shipped or ship(queries, vector, max_shipped, width=width)
    partial = _scan(_TopK, metric, k, _as_queries(queries, vector), _as_gallery(vectors, vector), shipped, width)
    best = F.asc("score") if metric == "euclid" else F.desc("score")
    return topk_per_query(partial, k, best, "image_id")


def nearest_and_best_dot(queries: DataFrame, vectors: DataFrame, k: int, vector: str = "vector",
                         max_shipped: int = MAX_SHIPPED_QUERIES, shipped: Shipped | None = None,
                         width: int | None = None) -> DataFrame:
    """`nearest_vectors` by cosine, and the best one by inner product, in one scan: column `measure` is cosine or dot."""
    width = width or stored_width(vectors, vector)
    shipped = shipped or ship(queries, vector, max_shipped, width=width)
    partial = _scan(_TopKAndDot, "cosine", k, _as_queries(queries, vector), _as_gallery(vectors, vector), shipped, width)
    w = Window.partitionBy("query_id", "measure").orderBy(F.desc("score"), "image_id")
    best = F.when(F.col("measure") == "dot", 1).otherwise(k)
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") <= best)


def answer_rank(queries: DataFrame, gallery: DataFrame, metric: str, values: str, own: str,
                max_shipped: int = MAX_SHIPPED_QUERIES, width: int | None = None) -> DataFrame:
    """0-based pessimistic rank of each query's `answer_id`: rows better plus rows tied.

    `own` names the column with the query's score against its answer. Tasks emit
    a count per query, never the scores themselves. `width` as in `nearest_vectors`.
    """
    width = width or stored_width(gallery, values)
    shipped = ship(queries, values, max_shipped, "answer_id", own, width)
    counts = _scan(_Ahead, metric, 0, _as_queries(queries, values, "answer_id", own),
                   _as_gallery(gallery, values), shipped, width)
    return counts.groupBy("query_id").agg(
        F.sum("ahead").cast("bigint").alias("rank"))


def words_within(queries: DataFrame, gallery: DataFrame, bits: int, others: bool = False,
                 max_shipped: int = MAX_SHIPPED_QUERIES) -> DataFrame:
    """queries(word) x gallery(word, n, least) -> (word, b: (distance, least), matches) of the distinct words that match.

    `matches` adds up the n of all gallery words within `bits`; `b` is the nearest, ties by `least`. With `others` a word
    doesn't match itself. Every word meets every other: tasks emit one row per word, never the pairs.
    """
    first = F.lit(-(1 << 63))  # null ids come before all others
    asked = queries.select(F.col("word").alias("query_id"), F.array("word", F.lit(0).cast("bigint")).alias("values"))
    stored = gallery.select(F.coalesce(F.col("least").cast("bigint"), first).alias("image_id"), F.array("word", "n").alias("values"))
    shipped = ship(asked, "values", max_shipped, width=2)
    found = _scan(_OthersWithin if others else _Within, "hamming", bits, _as_queries(asked, "values"),
                  _as_gallery(stored, "values"), shipped, 2)
    least = F.nullif("image_id", first).alias("least")
    return found.groupBy("word").agg(F.sum("matches").alias("matches"), F.min(F.struct("distance", least)).alias("b"))
