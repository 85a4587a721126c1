"""Blocks of rows read by tasks straight from a staged table, where every row must meet every other one.

A block that is sent to each of its partners costs disk in proportion to the number of partners; one that is read from the
shared folder costs none. The folder must be one that pyarrow opens (a mounted one, HDFS, S3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame


def _open(uri: str) -> pq.ParquetFile:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(system.open_input_file(path))


def block_files(staged: DataFrame) -> list[tuple[str, int]]:
    """The files of a staged table that hold rows, with their number; only the files' footers are read."""
    files = [(uri, _open(uri).metadata.num_rows) for uri in sorted(staged.inputFiles())]
    return [(uri, n) for uri, n in files if n]


def parts(files: list[tuple[str, int]], most: int, tasks: int) -> list[tuple[str, int, int]]:
    """(file, first row, row behind the last): parts of at most ``most`` rows, so small that there are ``tasks`` of them if rows suffice."""
    size = max(1, min(most, -(-sum(n for _, n in files) // max(1, tasks))))
    return [(uri, lo, min(n, lo + size)) for uri, n in files for lo in range(0, n, size)]


def read_part(uri: str, lo: int, hi: int, columns: list[str]) -> pa.Table:
    """Rows lo to hi of a file."""
    found, at = [], 0
    for batch in _open(uri).iter_batches(65_536, columns=columns):
        if at < hi and at + batch.num_rows > lo:
            found.append(batch.slice(max(0, lo - at), min(hi, at + batch.num_rows) - max(lo, at)))
        at += batch.num_rows
        if at >= hi:
            break
    return pa.Table.from_batches(found).combine_chunks()


def read_blocks(files: list[tuple[str, int]], rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """All rows of the files, at most ``rows`` at once."""
    for uri, _ in files:
        yield from _open(uri).iter_batches(rows, columns=columns)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix; nulls as NaN."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    return np.asarray(a.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))
