"""Sparse rows inside Arrow batches, and a truncated SVD built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTS = pa.list_(pa.field("element", pa.int32()))
DOUBLES = pa.list_(pa.field("element", pa.float64()))


SUM_TASKS = 4            # partial sums for each core
BLOCK = 1024             # rows worked on together, so that their entries stay in the cache
SUM_COLS = 512           # columns of a sum that move together
FULL_ROWS = 256          # rows spread out at once when they hold many of the columns
FULL = 16                # rows that hold one column in this many are spread out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``BLOCK`` rows."""
    for rb in batches:
        for start in range(0, rb.num_rows, BLOCK):
            yield rb.slice(start, BLOCK)


def sparse(rb: pa.RecordBatch, ids: int, cnts: int):
    """Flat ids, flat counts, the row of each entry and the row lengths."""
    lists = rb.column(ids)
    off = lists.offsets.to_numpy()
    values = rb.column(cnts)
    voff = values.offsets.to_numpy()
    sizes = np.diff(off)
    return (lists.values.to_numpy()[off[0]:off[-1]], values.values.to_numpy()[voff[0]:voff[-1]],
            np.repeat(np.arange(len(sizes)), sizes), sizes)


def dense(column: pa.ListArray, k: int) -> np.ndarray:
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0]:off[-1]].reshape(-1, k)


def lists(matrix: np.ndarray) -> pa.ListArray:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)),
        pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()), type=DOUBLES)


def same(column: pa.ListArray, kind) -> pa.ListArray:
    """The list column under one fixed element type."""
    return pa.ListArray.from_arrays(column.offsets, column.values, type=kind)


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum the rows of ``values`` (nnz x K) by document."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


def stretch_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths; 0 for an empty one."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def full_rows(ids: np.ndarray, x: np.ndarray, sizes: np.ndarray, v: int) -> Iterator[np.ndarray]:
    """The rows as dense matrices of ``FULL_ROWS`` rows; repeated ids are added up."""
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), FULL_ROWS):
        own = sizes[lo:lo + FULL_ROWS]
        a, z = ends[lo] - sizes[lo], ends[lo + len(own) - 1]
        yield np.bincount(np.repeat(np.arange(len(own)) * v, own) + ids[a:z], x[a:z], len(own) * v).reshape(len(own), v)


def times(ids: np.ndarray, x: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows times ``matrix`` (columns x K), spread out or entry by entry, a few rows at a time."""
    v = len(matrix)
    if len(ids) * FULL > len(sizes) * v:
        return np.concatenate([full @ matrix for full in full_rows(ids, x, sizes, v)])
    return np.stack([stretch_sums(m * x, sizes) for m in at_entries(matrix, ids)], axis=1)


def at_entries(matrix: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Each column of ``matrix`` at the entries' ids, as an array of its own."""
    return [np.ascontiguousarray(matrix[:, t])[ids] for t in range(matrix.shape[1])]


def noise(k: int, first: int, n: int, seed: int) -> np.ndarray:
    """Rows ``first`` to ``first + n`` of a matrix of K draws a row, however many it has."""
    bits = np.random.default_rng(seed).bit_generator
    bits.advance(first * k)
    return np.random.Generator(bits).random((n, k))


def pieces(matrix: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """The columns of a sum as rows ``(i, y)``, ``SUM_COLS`` at a time from number ``first``; empty pieces stay out."""
    for at in range(0, matrix.shape[1], SUM_COLS):
        if (piece := matrix[:, at:at + SUM_COLS]).any():
            yield pa.RecordBatch.from_pydict({"i": pa.array([first + at], pa.int64()), "y": pa.array([piece.tobytes()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rb in batches:
        for i, y in zip(rb.column(0).to_pylist(), rb.column(1)):
            y = np.frombuffer(y.as_buffer())
            sums[i] = sums[i] + y if i in sums else y.copy()
    for i, y in sums.items():
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "y": pa.array([y.tobytes()], pa.binary())})


def summed(parts: DataFrame, here: bool = False) -> dict[int, np.ndarray]:
    """The :func:`pieces` of all tasks ``(i, y)``, added up by their number; ``here`` on the driver, without a shuffle."""
    found = (parts if here else parts.repartition("i").mapInArrow(_added, "i bigint, y binary")).toArrow()
    batches = _added(found.to_batches()) if here else found.to_batches()
    return {i: np.frombuffer(y.as_buffer()) for rb in batches for i, y in zip(rb.column(0).to_pylist(), rb.column(1))}


def gram_times(rows: DataFrame, qs: dict[int, np.ndarray], n_models: int) -> dict[int, np.ndarray]:
    """``X^T D (X q)`` of each model, D its weights, for rows ``(ids, cnts, dw)`` in one pass.

    One small matrix for each model and task, and a few tasks for each core, so what is shuffled
    does not grow with the rows. The matrices move and are added up in pieces of ``SUM_COLS`` columns.
    """
    v, r = next(iter(qs.values())).shape[0], max(q.shape[1] for q in qs.values())
    bc = rows.sparkSession.sparkContext.broadcast(qs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {b: np.zeros((r, v)) for b in bc.value}
        for rb in blocks(batches):
            ids, x, rows, sizes = sparse(rb, 0, 1)
            ids, dw = ids.astype(np.intp), dense(rb.column(2), n_models)
            if len(ids) * FULL > len(sizes) * v:
                done = 0
                for full in full_rows(ids, x, sizes, v):
                    for b, q in bc.value.items():
                        out[b][:q.shape[1]] += ((full @ q) * dw[done:done + len(full), b:b + 1]).T @ full
                    done += len(full)
                continue
            for b, q in bc.value.items():
                for t, qt in enumerate(at_entries(q, ids)):
                    xq = stretch_sums(qt * x, sizes) * dw[:, b]
                    out[b][t] += np.bincount(ids, xq[rows] * x, v)
        for b, y in out.items():
            yield from pieces(y, b * v)

    few = min(rows.rdd.getNumPartitions(), SUM_TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.select("ids", "cnts", "dw").coalesce(few).mapInArrow(run, "i bigint, y binary")
    y = np.zeros((n_models * v, r))
    for i, piece in summed(parts).items():
        piece = piece.reshape(r, -1)
        y[i:i + piece.shape[1]] = piece.T
    bc.unpersist()
    return {b: y[b * v:(b + 1) * v, :q.shape[1]] for b, q in qs.items()}


def truncated_svds(rows: DataFrame, n_cols: int, ranks: dict[int, tuple[int, int]], n_models: int, sweeps: int = 8,
                   tol: float = 1e-5) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Leading singular values and right vectors of each model, by subspace iteration.

    ``ranks`` maps a model to its rank and seed. Each sweep is one pass over the rows for all
    models that have not converged; only thin matrices (columns x rank) are on the driver.
    """
    qs = {b: np.linalg.qr(noise(min(n_cols, rank + 8), 0, n_cols, seed) - 0.5)[0] for b, (rank, seed) in ranks.items()}
    last: dict[int, np.ndarray] = {}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(sweeps):
        if not qs:
            break
        for b, y in gram_times(rows, qs, n_models).items():
            q, rank = qs[b], ranks[b][0]
            values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            order = np.argsort(-values)
            s = np.sqrt(np.maximum(values[order][:rank], 0.0))
            found[b] = s, (q @ vectors[:, order])[:, :rank]
            if b in last and np.all(np.abs(s - last[b]) <= tol * np.maximum(s, 1e-12)):
                del qs[b]
                continue
            last[b] = s
            qs[b] = np.linalg.qr(y)[0]
    out = {}
    for b, (s, right) in found.items():
        keep = s > 1e-9 * max(float(s[0]) if s.size else 0.0, 1e-300)
        out[b] = s[keep], right[:, keep]
    return out


def truncated_svd(rows: DataFrame, n_cols: int, rank: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The singular values and right vectors of one unweighted table ``(ids, cnts)``."""
    return truncated_svds(rows.withColumn("dw", F.array(F.lit(1.0))), n_cols, {0: (rank, seed)}, 1)[0]
