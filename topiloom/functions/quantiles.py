"""Exact quantiles of a column of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
SMALL = 100_000


def _order_stats(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """Values at the 0-based ranks, by narrowing each rank to one histogram bucket."""
    out: dict[int, float] = {}
    todo = [(None, None, 0, ranks)]          # (low, high, rows below, ranks)
    while todo:
        low, high, below, want = todo.pop()
        part = df
        if low is not None:
            part = df.where((F.col(col) >= low) & (F.col(col) <= high))
        n, lo, hi = part.agg(F.count(F.lit(1)), F.min(col), F.max(col)).first()
        if lo == hi:
            out.update({r: lo for r in want})
            continue
        if n <= SMALL:
            vals = sorted(r[0] for r in part.select(col).collect())
            out.update({r: vals[r - below] for r in want})
            continue
        width = (hi - lo) / BUCKETS
        b = F.least(F.floor((F.col(col) - lo) / width), F.lit(BUCKETS - 1))
        hist = sorted((r["b"], r["n"], r["lo"], r["hi"]) for r in part.groupBy(b.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect())
        seen = below
        for _, c, blo, bhi in hist:
            inside = [r for r in want if seen <= r < seen + c]
            if inside:
                todo.append((blo, bhi, seen, inside))
            seen += c
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles, as numpy's default.

    Each pass is a map-side histogram of at most 1024 buckets; values reach the driver
    only from a bucket of at most 100,000 rows.
    """
    src = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias(col))
    n = src.count()
    if n == 0:
        return [float("nan")] * len(probs)
    spots = [p * (n - 1) for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    at = _order_stats(src, col, ranks)
    return [at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots]
