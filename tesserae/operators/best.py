"""The best items of many queries, kept in arrays while scores come in tiles; and tables as files that tasks read block by block."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.storage import drop, put_file, written

#: Bytes of one file of a table that every task reads.
BLOCK_BYTES = 32 << 20


def keep(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, places: int = 6) -> np.ndarray:
    """Rows that may be among the first k of their query by score, rounded to so many places, then id, in this order.

    Scores within a thousandth of the last place of a rounding edge may round either way, so they stay and push nothing out; of other equals, however
    many there are, k stay.
    """
    if not len(q):
        return np.zeros(0, np.int64)
    x = s * 10.0**places
    r = np.floor(x + 0.5)
    order = np.lexsort((ids, -r, q))
    by, r, unsure = q[order], r[order], (np.abs(x - np.floor(x) - 0.5) < 1e-3)[order]
    first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    count = np.diff(np.r_[first, len(by)])
    edge = np.repeat(r[first + np.minimum(count, k) - 1], count)
    near = r >= edge - 2
    unsure &= near
    most = k + np.repeat(np.add.reduceat(unsure.astype(np.int64), first), count)
    return order[near & (unsure | (np.arange(len(by)) - np.repeat(first, count) < most))]


class Best:
    """The best k of each of n queries; more than k where rounding leaves it open. Memory is that of n * k rows and a tile."""

    def __init__(self, n: int, k: int, places: int = 6):
        self.places, self.slack = places, 3 * 10.0**-places
        self.k, self.edge, self.parts, self.rows, self.most = k, np.full(n, -np.inf), [], 0, 4 * k * n + (1 << 20)

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray, *more: np.ndarray) -> None:
        """Scores s of queries `rows` (numbers, each once) and items ids; more: other values of the same shape. -inf is no result."""
        if not s.size:
            return
        least = np.maximum(self.edge[rows] - self.slack, np.finfo(float).min)
        found = s >= least[:, None]
        if s.shape[1] > self.k and np.count_nonzero(found) > 4 * self.k * len(rows):
            at = s.shape[1] - self.k
            self.edge[rows] = np.maximum(self.edge[rows], np.partition(s, at, axis=1)[:, at])
            found = s >= np.maximum(self.edge[rows] - self.slack, np.finfo(float).min)[:, None]
        row, col = np.nonzero(found)
        self.append(rows[row], ids[col], s[row, col], *(m[row, col] for m in more))

    def append(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray, *more: np.ndarray) -> None:
        self.parts.append((q, ids, s, *more))
        self.rows += len(q)
        if self.rows > self.most:
            self.result()

    def result(self) -> tuple[np.ndarray, ...] | None:
        """(query numbers, ids, scores, more): in order; None before anything was added."""
        if not self.parts:
            return None
        all_ = tuple(map(np.concatenate, zip(*self.parts)))
        kept = keep(*all_[:3], self.k, self.places)
        out = tuple(a[kept] for a in all_)
        q, s = out[0], out[2]
        if len(q):
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            full = first[np.diff(np.r_[first, len(q)]) >= self.k]
            self.edge[q[full]] = np.maximum(self.edge[q[full]], s[full + self.k - 1])
        self.parts, self.rows = [out], len(q)
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows, in the type that they have."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(rows):
        return np.zeros((0, 0))
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(rows) or not (np.diff(rows.offsets.to_numpy()) == len(flat) // len(rows)).all():
        raise ValueError("vectors differ in their number of components")
    return flat.reshape(len(rows), -1)


def held(rows: DataFrame, key: str, row_bytes: float, arrays: Callable[[pa.Table], dict[str, np.ndarray]]) -> list[str]:
    """rows as files in the shared folder, sent to every executor: arrays() of up to BLOCK_BYTES at a time, so that neither the
    driver nor a task holds more than one of them. loaded() reads one."""
    spark = rows.sparkSession
    blocks = max(1, -(-int(row_bytes) // BLOCK_BYTES))
    dealt = rows if blocks == 1 else written(rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks))), "blocks")
    names = []
    for k in range(blocks):
        out = io.BytesIO()
        np.savez(out, **arrays((rows if blocks == 1 else dealt.filter(F.col("__block") == k).drop("__block")).toArrow()))
        names.append(put_file(spark, "block", out.getvalue()))
    if blocks > 1:
        drop(dealt)
    return names


_last: dict[str, dict[str, np.ndarray]] = {}


def loaded(name: str) -> dict[str, np.ndarray]:
    """A file of held(), kept by the worker until it reads another."""
    if name not in _last:
        _last.clear()
        with np.load(SparkFiles.get(name)) as z:
            _last[name] = dict(z)
    return _last[name]


def tasks(df: DataFrame) -> int:
    """Parts for work in which every row costs much."""
    return 3 * df.sparkSession.sparkContext.defaultParallelism


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, most):
            yield b.slice(lo, most)
