"""The k nearest profiles of each profile, by blocks of dense rows that tasks read from the shared folder.

Rows with the same features that lie close together are put into crowds first, once for all tasks. A task holds a block of
the queries and meets all of history, one block at a time. Crowds are compared by a matrix product of their centres in
float32; by their radii and the product's bounded rounding, only rows of crowds that may hold one of the k nearest
are computed exactly, in double. Rows whose features few others have are compared one by one, over values and marks of
presence. The k best of each query never leave the task before the end.

Several measures can be searched for at once where they differ only in the features that they see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.blocks import block_files, matrix, parts, read_blocks, read_part
from stillhouse.sources.tables import stage

#: Numbers that a block holds at most (65,536 rows of 120 features: the more rows of a block crowd, the fewer crowds meet), rows or crowds of a tile of queries and of history, least rows with the same features that are put into crowds where more sets of features than the last number occur.
_NUMBERS, _OWN, _MEET, _LEAST, _KINDS = 1 << 23, 512, 1_024, 64, 32
#: Width of a crowd in each feature, in spreads, on average; crowds whose rows are compared to get a first limit.
_WIDE, _FIRST = 0.15, 8


@dataclass(frozen=True)
class Measure:
    """How two rows are compared, per feature.

    spread: what differences are divided by (NaN: not compared); weight: of the squared difference. relative: divided by the
    larger size (at least 1) instead. centre: taken off first; only with zeros, where absent features count as 0 and the
    distance is Euclid's (rows that share no feature aren't compared, and how many they share doesn't count). decimals: distances are ranked as rounded to so many.
    seen: marks the features that are compared; None: all.
    """

    spread: np.ndarray
    weight: np.ndarray
    relative: bool = False
    zeros: bool = False
    centre: np.ndarray | None = None
    decimals: int = 9
    seen: np.ndarray | None = None

    def exact(self, u: np.ndarray, v: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, shared) of paired rows by each row of ``seen``, one column each; infinite where they can't be compared."""
        masks = seen.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.zeros:
                shared = (~np.isnan(u) & ~np.isnan(v)) @ masks
                a, b = (np.nan_to_num((x - self.centre) / self.spread, nan=0.0) for x in (u, v))
                return np.where(shared > 0, np.sqrt(_sums((a - b) ** 2, seen)), np.inf), np.zeros(shared.shape, np.int64)
            part = (u - v) / (np.fmax(np.fmax(np.abs(u), np.abs(v)), 1.0) if self.relative else self.spread)
            there = ~np.isnan(part)
            total, weight, shared = _sums(np.where(there, self.weight * part * part, 0.0), seen), (there * self.weight) @ masks, there @ masks
            return np.where(weight > 0, np.sqrt(total / weight) + 1.0 / shared, np.inf), shared.astype(np.int64)


def _sums(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Row sums over each set of features; infinite values count only where they are seen."""
    if np.isfinite(x).all():
        return x @ seen.T.astype(float)
    return np.stack([x[:, s].sum(axis=1) for s in seen], axis=1)


def crowds(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the crowd of each row in that order): rows are cut along their widest feature, at the widest gap of its
    middle half, until a part is narrow or a single row. Any division gives right results; a good one saves work."""
    z = np.where(np.isfinite(z), z, 0.0).astype(np.float32)
    n, wide = len(z), z.shape[1] * _WIDE * _WIDE
    done, label, given = [], [], 0
    rows, size = np.arange(n), np.array([n] if n else [], np.int64)
    while len(rows):
        start = np.cumsum(size) - size
        here = z[rows]
        width = np.maximum.reduceat(here, start, axis=0) - np.minimum.reduceat(here, start, axis=0)
        with np.errstate(over="ignore"):
            open_ = (size > 1) & ((width.astype(float) ** 2).sum(axis=1) > wide)
        node = np.repeat(np.arange(len(size)), size)
        shut = ~open_[node]
        done.append(rows[shut])
        label.append(given + node[shut])
        given += len(size)
        if not open_.any():
            break
        keep, axis, size = ~shut, width.argmax(axis=1)[open_], size[open_]
        rows, value = rows[keep], here[keep, np.repeat(axis, size)]
        start = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((value, node))
        rows, value = rows[order], value[order]
        at = np.arange(len(rows)) - start[node]
        gap = np.r_[0, np.diff(value)]
        gap = np.where((at >= 1) & (4 * at >= size[node]) & (4 * at <= 3 * size[node] + 3), gap, -1.0)
        widest = np.flatnonzero(gap == np.maximum.reduceat(gap, start)[node])
        first = np.r_[True, node[widest][1:] != node[widest][:-1]]
        left = at[widest[first]]
        size = np.stack([left, size - left], axis=1).ravel()
    order, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done, label))
    return order, label


def _patterns(has: np.ndarray) -> tuple[np.ndarray, int]:
    """A number per set of features; where there are more than _KINDS, those that fewer than _LEAST rows have share the largest one, which is returned too."""
    packed = np.packbits(has, axis=1)
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)
    packed = packed.ravel() if packed.shape[1] == 1 else packed.view([("", np.void, 8 * packed.shape[1])]).ravel()
    _, kind, size = np.unique(packed, return_inverse=True, return_counts=True)
    return np.where((size >= _LEAST) | (len(size) <= _KINDS), np.arange(len(size)), len(size))[kind], len(size)


class _Kind:
    """The rows lo to hi of a block, which have the same features, and their crowds."""

    def __init__(self, block: _Block, lo: int, hi: int, crowd: np.ndarray):
        self.has, self.made = block.has[lo], {}
        start = np.flatnonzero(np.r_[True, crowd[lo + 1 : hi] != crowd[lo : hi - 1]])
        size = np.diff(np.r_[start, hi - lo])
        z = block.z[lo:hi]
        with np.errstate(invalid="ignore", over="ignore"):
            self.middle = np.add.reduceat(z, start, axis=0, dtype=np.float64) / size[:, None]
            off = z - np.repeat(self.middle.astype(np.float32), size, axis=0)
            self.radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", off, off), start)).astype(float) * (1 + 1e-5)
        self.radius[np.isnan(self.radius)] = np.inf
        self.radius[size == 1] = 0.0
        self.start, self.size = start + lo, size

    def times(self, on: np.ndarray, left: bool) -> np.ndarray:
        """One side of the product that gives the squared distances of centres over some features."""
        key = on.tobytes(), left
        if key not in self.made:
            if len(self.made) > 16:
                self.made.clear()
            z = self.middle[:, on]
            square, one = (z * z).sum(axis=1)[:, None], np.ones((len(z), 1))
            self.made[key] = (np.concatenate([-2.0 * z, square, one], axis=1) if left else np.concatenate([z, one, square], axis=1)).astype(np.float32)
        return self.made[key]


class _Block:
    """Rows ordered by their features and crowds; ``kinds`` of the same features, and from row ``rest`` on all others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: Measure, centre: np.ndarray, crowd: np.ndarray | None = None, carried: np.ndarray | None = None):
        x = np.ascontiguousarray(x)
        has = ~np.isnan(x) & ~np.isnan(m.spread)
        kind, other = _patterns(has)
        crowd = np.arange(len(x)) if crowd is None else crowd
        change = np.r_[True, (crowd[1:] != crowd[:-1]) | (kind[1:] != kind[:-1]), True]
        single = change[1:] & change[:-1]
        order = np.lexsort((single, kind))
        crowd = np.cumsum(change[:-1])
        if not np.array_equal(order, np.arange(len(order))):  # staged rows stand in order
            ids, x, has, kind, crowd = ids[order], x[order], has[order], kind[order], crowd[order]
            carried = None if carried is None else carried[order]
        self.ids, self.x, self.has, self.carried = ids, x, has, carried
        with np.errstate(invalid="ignore", over="ignore"):
            y = x - centre
            y /= m.spread / np.sqrt(m.weight)
            y[~has] = 0.0
            self.z = y.astype(np.float32)  # what rounding takes is within the bounds of the products
            self.most = float(np.sqrt(np.einsum("ij,ij->i", self.z, self.z).max(initial=0.0))) * (1 + 1e-5)
        self.rest = 0 if m.relative else int(np.searchsorted(kind, other))
        starts = np.flatnonzero(np.r_[True, kind[1 : self.rest] != kind[: self.rest - 1]]) if self.rest else []
        self.kinds = [_Kind(self, lo, hi, crowd) for lo, hi in zip(starts, [*starts[1:], self.rest])]


class _Best:
    """The k best of each row so far: by rounded distance, more shared features, smaller id."""

    def __init__(self, rows: int, k: int, decimals: int, ids: np.ndarray, carried: int = 0):
        self.k, self.decimals = k, decimals
        self.key, self.d = np.full((rows, k), np.inf), np.full((rows, k), np.inf)
        self.shared, self.i = np.zeros((rows, k), np.int64), np.full((rows, k), ids[0])
        self.v = np.full((rows, k, carried), np.nan) if carried else None

    def push(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray, shared: np.ndarray, carried: np.ndarray | None = None) -> None:
        key = np.round(d, self.decimals)
        ok = np.isfinite(key) & (key <= self.key[rows, -1])
        if not ok.any():
            return
        touched = np.unique(rows[ok])
        rows = np.concatenate([rows[ok], np.repeat(touched, self.k)])
        key, d = np.concatenate([key[ok], self.key[touched].ravel()]), np.concatenate([d[ok], self.d[touched].ravel()])
        shared, ids = np.concatenate([shared[ok], self.shared[touched].ravel()]), np.concatenate([ids[ok], self.i[touched].ravel()])
        if self.v is not None:
            carried = np.concatenate([carried[ok], self.v[touched].reshape(-1, self.v.shape[2])])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -shared, key, rows))
        rows = rows[order]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        top = rank < self.k
        order, to = order[top], (rows[top], rank[top])
        self.key[to], self.d[to], self.shared[to], self.i[to] = key[order], d[order], shared[order], ids[order]
        if self.v is not None:
            self.v[to] = carried[order]


def _pairs(a: _Kind, i: np.ndarray, b: _Kind, j: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of paired crowds, about ``most`` at once."""
    wide = b.size[j]
    number = a.size[i] * wide
    upto = np.cumsum(number)
    for at in range(0, int(upto[-1]) if len(upto) else 0, most):
        n = np.arange(at, min(at + most, int(upto[-1])))
        pair = np.searchsorted(upto, n, side="right")
        off = n - (upto - number)[pair]
        yield a.start[i[pair]] + off // wide[pair], b.start[j[pair]] + off % wide[pair]


def _meet(own: _Block, other: _Block, bests: list[_Best], m: Measure, seen: np.ndarray, p: np.ndarray, q: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """Compare paired rows exactly, of which ``may`` leaves those that can pass the limits."""
    step = max(1, (1 << 20) // own.x.shape[1])
    for at in range(0, len(p), step):
        i, j = p[at : at + step], q[at : at + step]
        keep = own.ids[i] != other.ids[j]
        if may is not None:
            keep &= may(i, j)
        if not keep.all():
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        d, shared = m.exact(own.x[i], other.x[j], seen)
        for c, best in enumerate(bests):
            best.push(i, other.ids[j], d[:, c], shared[:, c], None if best.v is None else other.carried[j])


def _crowded(own: _Block, other: _Block, bests: list[_Best], m: Measure, seen: np.ndarray, a: _Kind, b: _Kind, error: float) -> None:
    """Two kinds of rows: crowds by the distance of their centres over the features that all measures see, then rows over those of each."""
    both = np.ones_like(a.has) if m.zeros else a.has & b.has
    shared = seen & a.has & b.has
    sets = [c for c, on in enumerate(shared) if on.any() and m.weight[on].sum() > 0]
    if not sets:
        return
    least = [0.0 if m.zeros else 1.0 / shared[c].sum() for c in sets]
    total = [1.0 if m.zeros else m.weight[shared[c]].sum() for c in sets]
    marks = (seen[sets] & both).T.astype(np.float32)
    slack = 2 * 10.0**-m.decimals

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        part = own.z[i] - other.z[j]
        square = (part * part) @ marks
        ok = np.zeros(len(i), bool)
        for n, c in enumerate(sets):
            limit = bests[c].key[i, -1] + slack - least[n]
            ok |= ~(square[:, n] > np.where(limit < 0, -np.inf, limit * limit * total[n] * (1 + 1e-5) + error))
        return ok

    on = seen.all(axis=0) & both
    step = max(1, (1 << 20) // own.x.shape[1])
    left, right = a.times(on, True), b.times(on, False).T
    tile = max(16, min(_OWN, (1 << 22) // len(b.size)))
    for lo in range(0, len(a.size), tile):
        part = slice(lo, min(lo + tile, len(a.size)))
        first = a.start[part]
        end = int(first[-1] + a.size[part][-1])

        def reach() -> np.ndarray:
            """How far the centres may be apart, without the radii."""
            out = np.full(len(first), -np.inf)
            for n, c in enumerate(sets):
                limit = np.maximum.reduceat(bests[c].key[first[0] : end, -1], first - first[0]) + slack - least[n]
                out = np.maximum(out, np.where(limit < 0, -np.inf, limit * np.sqrt(total[n])))
            return out

        def within(far: np.ndarray) -> np.ndarray:
            return np.where(far < 0, -np.inf, far * far * (1 + 1e-6) + error).astype(np.float32)

        near = left[part] @ right
        met = np.zeros(near.shape, bool)
        fresh = any(np.isinf(bests[c].key[first[0] : end, -1]).any() for c in sets)
        many = min(_FIRST, near.shape[1]) if fresh else 1
        j = np.argpartition(np.nan_to_num(near, nan=np.inf), many - 1, axis=1)[:, :many].ravel() if fresh else near.argmin(axis=1)
        i = np.repeat(np.arange(len(near)), many)
        ok = ~(near[i, j] > within(reach()[i] + a.radius[part][i] + b.radius[j]))
        i, j = i[ok], j[ok]
        met[i, j] = True
        for p, q in _pairs(a, part.start + i, b, j, step):  # the nearest crowds bring the limits down
            _meet(own, other, bests, m, seen, p, q, may)
        far = reach() + a.radius[part]
        for at in range(0, len(b.size), _MEET):
            prod = near[:, at : at + _MEET]
            i, j = np.divmod(np.flatnonzero(~(prod > within(far + b.radius[at : at + _MEET].max())[:, None])), prod.shape[1])  # what isn't a number is looked at
            ok = ~(met[i, at + j] | (prod[i, j] > within(far[i] + b.radius[at + j])))
            for p, q in _pairs(a, part.start + i[ok], b, at + j[ok], step):
                _meet(own, other, bests, m, seen, p, q, may)


def _mixed(own: _Block, p: slice, other: _Block, q: slice, m: Measure, on: np.ndarray, error: float, limit: np.ndarray, k: int) -> np.ndarray:
    """Which pairs of rows that differ in their features may pass the limits."""
    za, zb, ma, mb = (x[:, on].astype(np.float32, copy=False) for x in (own.z[p], other.z[q], own.has[p], other.has[q]))
    shared = ma @ mb.T
    one = np.ones_like(ma), np.ones_like(mb)
    sa, sb = one if m.zeros else (ma, mb)
    square = np.concatenate([za * za, sa, -2 * za], axis=1) @ np.concatenate([sb, zb * zb, zb], axis=1).T
    total = 1.0 if m.zeros else np.maximum(ma @ (mb * m.weight[on].astype(np.float32)).T, np.float32(0))
    add = 0.0 if m.zeros else 1.0 / shared
    low = np.where(shared > 0, np.sqrt(np.maximum(square - error, 0) / total) * (1 - 1e-5) + add, np.inf)
    fresh = np.isinf(limit)
    if fresh.any() and low.shape[1] > k:
        high = np.where(shared > 0, np.sqrt((np.maximum(square, 0) + error) / total) * (1 + 1e-5) + add, np.inf)
        at = min(k + 1, high.shape[1]) - 1  # one more: the row itself may be among them
        limit = np.where(fresh, np.partition(high, at, axis=1)[:, at], limit)
    return ~(low > (limit + 2 * 10.0**-m.decimals + 1e-6 * np.where(np.isfinite(limit), limit, 0.0))[:, None])


def _alike(seen: np.ndarray) -> list[list[int]]:
    """Measures by what they see in common: together where each sees few features besides."""
    out: list[list[int]] = []
    for c in np.argsort(-seen.sum(axis=1), kind="stable").tolist():
        for group in out:
            if seen[[*group, c]].all(axis=0).sum() >= 0.85 * seen[[*group, c]].sum(axis=1).max():
                group.append(c)
                break
        else:
            out.append([c])
    return out


def _search(own: _Block, other: _Block, bests: list[_Best], m: Measure, seen: np.ndarray) -> None:
    # a sum of 3 F + 2 products of float32 is off by no more than this part of the squared norms
    size = own.most + other.most
    error = (3 * own.x.shape[1] + 24) * 2.0**-22 * size * size + 1e-30
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for a in own.kinds:
            for b in sorted(other.kinds, key=lambda b: -int((a.has & b.has).sum())):
                for group in _alike(seen):
                    _crowded(own, other, [bests[c] for c in group], m, seen[group], a, b, error)
        n, k = len(own.ids), len(other.ids)
        for lo, hi, start, end in ((0, own.rest, other.rest, k), (own.rest, n, 0, k)):
            for at in range(start, end, _MEET):
                q = slice(at, min(at + _MEET, end))
                for row in range(lo, hi, _OWN):
                    p = slice(row, min(row + _OWN, hi))
                    may = np.zeros((p.stop - p.start, q.stop - q.start), bool)
                    for best, on in zip(bests, seen):
                        may |= m.relative or _mixed(own, p, other, q, m, on, error, best.key[p, -1], best.k)
                    i, j = np.divmod(np.flatnonzero(may), may.shape[1])  # far faster than nonzero of a matrix
                    _meet(own, other, bests, m, seen, i + row, j + at)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return np.asarray(column.to_numpy(), dtype=np.int64)
    return np.array(column.to_pylist(), dtype=object)


def _in_crowds(rows: DataFrame, m: Measure, used: np.ndarray, most: int) -> DataFrame:
    """Staged (id, x, crowd): rows of each block in the order of their crowds, which are numbered in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, most):
            x = matrix(table.column("x"))
            with np.errstate(invalid="ignore", over="ignore"):
                z = x[:, used] / m.spread * np.sqrt(m.weight)
            has = ~np.isnan(z)
            kind, other = _patterns(has)
            order, crowd, given = [], [], 0
            for number in np.unique(kind):
                own = np.flatnonzero(kind == number)
                at, label = crowds(z[own][:, has[own[0]]]) if number != other else (np.arange(len(own)), np.arange(len(own)))
                order.append(own[at])
                crowd.append(label + given)
                given += int(label.max()) + 1
            order, crowd = np.concatenate(order), np.concatenate(crowd)
            single = np.bincount(crowd)[crowd] == 1
            again = np.lexsort((crowd, single, kind[order]))
            order, crowd = order[again], crowd[again]
            columns = [table.column("id").combine_chunks().take(pa.array(order)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x[order].ravel())), pa.array(crowd, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "crowd"])

    return stage(rows.select("id", "x").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, x array<double>, crowd bigint"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Found:
    """What a task has found for a block of queries: per measure the k best (``best[s].d`` and so on, in order), the queries' ids and values of the carried features."""

    ids: np.ndarray
    carried: np.ndarray | None
    best: list[_Best]


def search(queries: DataFrame, history: DataFrame, k: int, measure: Measure, seen: np.ndarray | None = None, query_rows: int = 1 << 20, history_rows: int = 65_536) -> DataFrame:
    """(query_id, id, distance, shared, rank) of the k nearest of each query.

    ``queries`` and ``history`` are staged tables of unique id and x, a list with null for an absent feature; ``seen`` marks the
    features that are compared. Ties go to more shared features, then to the smaller id; a row isn't its own neighbour.
    """
    kind = dict(history.dtypes)["id"]
    schema = f"query_id {kind}, id {kind}, distance double, shared bigint, rank int"

    def finish(f: Found) -> pa.RecordBatch:
        best = f.best[0]
        r, c = np.nonzero(np.isfinite(best.key))
        return pa.RecordBatch.from_arrays([pa.array(f.ids[r].tolist()), pa.array(best.i[r, c].tolist()), pa.array(best.d[r, c]), pa.array(best.shared[r, c]), pa.array(c + 1, pa.int32())], ["query_id", "id", "distance", "shared", "rank"])

    found = search_all(queries, history, k, measure, None if seen is None else seen[None, :], finish, schema.replace(f"{kind},", "bigint,") if kind in ("int", "smallint", "tinyint") else schema, query_rows=query_rows, history_rows=history_rows)
    return found.select(F.col("query_id").cast(kind).alias("query_id"), F.col("id").cast(kind).alias("id"), "distance", "shared", "rank")


def search_all(queries: DataFrame, history: DataFrame, k: int, measure: Measure, seen: np.ndarray | None, finish: Callable[[Found], pa.RecordBatch], schema: str, carry: list[int] | None = None, query_rows: int = 1 << 20, history_rows: int = 65_536) -> DataFrame:
    """``finish`` of each block of queries: the k nearest by ``measure`` over each row of ``seen``, all in one pass.

    ``carry`` has places of features whose values are kept for each query and neighbour (``best[s].v``).
    """
    spark = history.sparkSession
    features = len(measure.spread)
    sets = np.ones((1, features), bool) if seen is None else seen
    if not measure.relative:
        sets = sets & ~np.isnan(measure.spread)
    used = np.flatnonzero(sets.any(axis=0))
    if not len(used):
        return spark.createDataFrame([], schema)
    m = replace(measure, spread=np.ones(len(used)) if measure.relative else measure.spread[used], weight=measure.weight[used], centre=None if measure.centre is None else measure.centre[used])
    sets = sets[:, used]
    most = max(1, _NUMBERS // max(1, features))
    same = queries is history
    if not measure.relative:
        history = _in_crowds(history, m, used, min(history_rows, most))
        queries = history if same else _in_crowds(queries, m, used, most)
    mine, theirs = block_files(queries), block_files(history)
    if not mine or not theirs:
        return spark.createDataFrame([], schema)
    tasks = parts(mine, query_rows, spark.sparkContext.defaultParallelism)  # each reads all of history
    columns = ["id", "x"] + ["crowd"] * (not measure.relative)

    def block(rows: pa.Table | pa.RecordBatch, centre: np.ndarray | None) -> tuple[_Block, np.ndarray]:
        every = matrix(rows.column("x"))
        x = every if len(used) == every.shape[1] else every[:, used]
        if centre is None:
            with np.errstate(invalid="ignore", over="ignore"):
                centre = np.where(np.isfinite(x), x, 0.0).sum(axis=0) / np.maximum(1, np.isfinite(x).sum(axis=0)) if m.centre is None else m.centre
        return _Block(_ids(rows.column("id")), x, m, centre, rows.column("crowd").to_numpy() if "crowd" in columns else None, every[:, carry] if carry else None), centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for batch in batches for i in batch.column("id").to_pylist()):
            uri, lo, hi = tasks[number]
            turn = next((i for i, f in enumerate(theirs) if f[0] == uri), number % len(theirs))  # rows beside their own first
            for start in range(lo, hi, most):
                own, centre = block(read_part(uri, start, min(hi, start + most), columns), None)
                bests = None
                for batch in read_blocks(theirs[turn:] + theirs[:turn], min(history_rows, most), columns):
                    other, _ = block(batch, centre)
                    bests = bests or [_Best(len(own.ids), k, m.decimals, other.ids, len(carry or [])) for _ in sets]
                    _search(own, other, bests, m, sets)
                yield finish(Found(own.ids, own.carried, bests))

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)
