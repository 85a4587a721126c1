"""The k nearest vectors of every vector by a block matrix join.

Vectors are cut into blocks; a task holds one block and reads the others, one at a time, from the shared folder, so
nothing is sent. Its vectors are parted into tiles along their principal axes; of another block only the vectors whose
projections come near a tile's box meet it, by products of int8 codes. Codes and known rounding residuals bound each
distance from below and above; pairs whose lower bound passes the current limit are recomputed in double precision and
kept in bounded heaps. The bounds are proven, so nothing is lost: recall is 1 by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.blocks import block_files, matrix, parts, read_blocks, read_part
from stillhouse.sources.tables import stage

#: Feature keys are read by the driver, so their number is checked; beyond it the call fails.
MAX_FEATURES = 4_096
#: Rows per block at most; a task holds two blocks of no more than _BLOCK_NUMBERS numbers each.
BLOCK_ROWS = 65_536
_BLOCK_NUMBERS = 1 << 22
#: Rows of a tile, and those of the other block that meet it at once.
_TILE, _MEET = 256, 1_024
#: Principal axes that tiles are cut along, and those that boxes are compared on; beyond _MOST_AXES features the
#: features that vary most take their place.
_CUTS, _AXES, _MOST_AXES = 3, 6, 512


def plain_feature(key):
    """A feature key trimmed, lower-cased, with blanks as underscores."""
    return F.replace(F.lower(F.trim(key)), F.lit(" "), F.lit("_"))


def dense_vectors(profiles: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """(id, vector) over all feature keys in alphabetical order, one row per id.

    Absent, null and NaN features and null maps count as 0. Of keys that are spelled differently but mean the same in
    one map, the value of the alphabetically last spelling with a number counts. Of several rows with one id, the
    largest vector (compared as an array) counts. Rows without id are left out.
    """
    keys = [r[0] for r in profiles.select(F.explode(F.map_keys(map_col)).alias("k")).distinct().select(plain_feature(F.col("k")).alias("k")).distinct().limit(MAX_FEATURES + 1).collect()]
    if len(keys) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    place = {k: i for i, k in enumerate(sorted(keys))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column("m")
            n = batch.num_rows
            dense = np.zeros((n, max(1, len(place))))
            offsets = maps.offsets.to_numpy()
            size = np.diff(offsets)
            rows = np.repeat(np.arange(n), size)
            names = maps.keys.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            values = maps.items.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
            spelled = names.dictionary.to_pylist()
            rank = np.argsort(np.argsort(spelled)) if spelled else np.empty(0, int)
            target = np.array([place[s.strip(" ").lower().replace(" ", "_")] for s in spelled], dtype=np.int64)
            code = names.indices.to_numpy()
            good = np.isfinite(values)
            order = np.argsort(rank[code[good]], kind="stable") if good.any() else np.empty(0, int)
            dense[rows[good][order], target[code[good][order]]] = values[good][order]
            flat = pa.array(dense.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, dense.shape[1]), pa.int32()), flat)], ["id", "v"])

    source = profiles.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(map_col), F.expr("cast(map() as map<string,double>)")).alias("m"))
    vectors = source.mapInArrow(run, "id bigint, v array<double>")
    if source.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
        return vectors  # without repeated ids no vector has to be moved
    return vectors.groupBy("id").agg(F.max("v").alias("v"))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes with a scale per row, the squared norm of what they stand for, and the residual's norm."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    approx = q * scale[:, None]
    return q, scale, (approx * approx).sum(axis=1), np.sqrt(((x - approx) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of int8 codes; below 1,040 features every partial sum is an integer that float32 holds."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


class _Heaps:
    """The k nearest of each row so far: (distance, id) in order, ties to the smaller id."""

    def __init__(self, rows: int, k: int, radius: float):
        self.k, self.d, self.i = k, np.full((rows, k), np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.radius = radius

    def limit(self) -> np.ndarray:
        return np.minimum(self.d[:, -1], self.radius)

    def push(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        ok = dist <= np.minimum(self.d[rows, -1], self.radius)
        if not ok.any():
            return
        rows, ids, dist = rows[ok], ids[ok], dist[ok]
        touched = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.i[touched].ravel()])
        dist = np.concatenate([dist, self.d[touched].ravel()])
        order = np.lexsort((ids, dist, rows))
        rows, ids, dist = rows[order], ids[order], dist[order]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        top = rank < self.k
        self.d[rows[top], rank[top]], self.i[rows[top], rank[top]] = dist[top], ids[top]


class _Block:
    """Vectors with their ids, codes and places on the axes."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, axes: np.ndarray | None = None):
        self.ids = rows.column("id").to_numpy(**({"zero_copy_only": False} if isinstance(rows, pa.RecordBatch) else {}))
        self.x = matrix(rows.column("v"))
        self.axes = _axes(self.x) if axes is None else axes
        self.at = self.x @ self.axes
        self.codes = _codes(self.x)
        self.size = float(np.sqrt((self.x * self.x).sum(axis=1).max(initial=0.0)))


def _axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal directions along which the rows lie far apart; any such set gives valid bounds."""
    f = x.shape[1]
    if f > _MOST_AXES:
        return np.eye(f)[:, np.argsort(-x.var(axis=0), kind="stable")[:_AXES]]
    spread = np.cov(x.T).reshape(f, f) if len(x) > 1 else np.zeros((f, f))
    return np.linalg.eigh(spread)[1][:, ::-1][:, :_AXES] if np.isfinite(spread).all() else np.eye(f)[:, :_AXES]


def _tiles(at: np.ndarray, rows: int = _TILE) -> list[np.ndarray]:
    """Row numbers cut into tiles: halves, thirds and so on of equal size along one axis after the other."""
    out, cuts = [np.arange(len(at))], min(_CUTS, at.shape[1])
    for c in range(cuts):
        each = max(1, round((len(at) / rows) ** (1 / cuts))) if c < cuts - 1 else 0
        out = [part for tile in out for part in np.array_split(tile[np.argsort(at[tile, c], kind="stable")], each or max(1, -(-len(tile) // rows))) if len(part)]
    return out


def _search(own: _Block, other: _Block, heaps: _Heaps) -> None:
    """Put the rows of ``other`` that are near rows of ``own`` into their heaps."""
    qb, sb, nb, rb = other.codes
    tiny = 1e-12 * (own.size + other.size)
    for rows in _tiles(own.at):
        q, s, n, r = (c[rows] for c in own.codes)
        near = np.arange(len(other.ids))
        reach = heaps.limit()[rows].max() * (1 + 1e-9) + tiny
        if np.isfinite(reach):
            low, high = own.at[rows].min(axis=0), own.at[rows].max(axis=0)
            for a in range(own.at.shape[1]):  # the first axes leave few rows for the others
                x = other.at[near, a]
                near = near[(x >= low[a] - reach) & (x <= high[a] + reach)]
            gap = np.maximum(np.maximum(low - other.at[near], other.at[near] - high), 0.0)
            near = near[(gap * gap).sum(axis=1) <= reach * reach]
        for lo in range(0, len(near), _MEET):
            t = near[lo : lo + _MEET]
            prod = _product(q, qb[t])
            prod *= (-2.0 * s).astype(prod.dtype)[:, None]
            prod *= sb[t].astype(prod.dtype)[None, :]
            prod += n.astype(prod.dtype)[:, None]
            prod += nb[t].astype(prod.dtype)[None, :]
            # squared lower bound passes where distance of codes <= limit + residuals (+ rounding of float32)
            worst = float(n.max() + nb[t].max()) * 4e-6 if prod.dtype == np.float32 else 1e-9
            limit = heaps.limit()[rows]
            if np.isinf(limit).any() and heaps.radius == np.inf:
                upper = np.sqrt(np.maximum(prod, 0) + worst) + r[:, None] + rb[t].max()
                kth = min(heaps.k + 1, upper.shape[1]) - 1  # one more: the row itself may be among them
                if upper.shape[1] > heaps.k:
                    limit = np.minimum(limit, np.partition(upper, kth, axis=1)[:, kth])
            width = (limit + r)[:, None] + rb[t][None, :]
            i, j = np.divmod(np.flatnonzero(prod <= np.where(np.isfinite(width), width * width * (1 + 1e-6) + worst, np.inf)), len(t))
            i, j = rows[i], t[j]
            ok = own.ids[i] != other.ids[j]
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 200_000):
                p, m = i[at : at + 200_000], j[at : at + 200_000]
                heaps.push(p, other.ids[m], np.sqrt(((own.x[p] - other.x[m]) ** 2).sum(axis=1)))


def _nearest(spark, queries: list[tuple[str, int]], vectors: list[tuple[str, int]], k: int, radius: float, block_rows: int) -> DataFrame:
    """Each part of the queries' files against all files of the vectors. ``queries`` may be the same files; then its own
    block comes first."""
    schema = "id bigint, neighbour bigint, rank int, distance double"
    if not queries or not vectors:
        return spark.createDataFrame([], schema)

    tasks = parts(queries, block_rows, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for batch in batches for i in batch.column("id").to_pylist()):
            uri, lo, hi = tasks[number]
            first = read_part(uri, lo, lo + 1, ["v"])
            most = max(1, min(block_rows, _BLOCK_NUMBERS // max(1, len(first.column("v")[0]))))
            for start in range(lo, hi, most):
                own = _Block(read_part(uri, start, min(hi, start + most), ["id", "v"]))
                heaps = _Heaps(len(own.ids), k, radius)
                turn = next((i for i, f in enumerate(vectors) if f[0] == uri), number % len(vectors))
                for batch in read_blocks(vectors[turn:] + vectors[:turn], most, ["id", "v"]):
                    _search(own, _Block(batch, own.axes), heaps)
                r, c = np.nonzero(np.isfinite(heaps.d))
                columns = [pa.array(own.ids[r], pa.int64()), pa.array(heaps.i[r, c], pa.int64()), pa.array(c + 1, pa.int32()), pa.array(heaps.d[r, c], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "neighbour", "rank", "distance"])

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)


def all_neighbours(vectors: DataFrame, k: int = 5, radius: float = float("inf"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, rank, distance): for every vector its k nearest others within ``radius``.

    ``vectors`` has unique id and v. Euclidean distance in double precision; ties go to the smaller id; equal
    vectors are neighbours at distance 0. Fewer than k others give fewer rows; an empty table gives none. Each
    block is one task, which reads all vectors from the shared folder; on disk they stand there once, whatever their number.
    """
    files = block_files(stage(vectors))
    return _nearest(vectors.sparkSession, files, files, k, radius, block_rows)


def neighbours_of(queries: DataFrame, vectors: DataFrame, k: int = 5, radius: float = float("inf"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Like all_neighbours for the vectors of ``queries`` only, against all of ``vectors``, block by block."""
    return _nearest(vectors.sparkSession, block_files(stage(queries)), block_files(stage(vectors)), k, radius, block_rows)
