"""Array-of-number expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(a) -> Column:
    return _c(a).cast("array<double>")


def let(value, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for a row, however often the body names it."""
    return F.transform(F.array(_c(value)), body)[0]


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def scale(a, s) -> Column:
    return F.transform(_c(a), lambda x: x * _c(s))


def unit(a, eps: float = 1e-12) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(eps)))))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def sum_arrays(col: str, dim: int, weight: Column | None = None) -> Column:
    """Element-wise sum of an array column over a group, with map-side combine."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(F.get(F.col(col), F.lit(i)) * w) for i in range(dim)])


def lit_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def argmax(a) -> Column:
    """Position of the largest element, the lowest one on ties."""
    return F.array_position(_c(a), F.array_max(_c(a))).cast("int") - 1


def fit_dim(df, col: str) -> int:
    """Length of the array column, read from one row."""
    row = df.where(F.col(col).isNotNull()).select(F.size(col)).first()
    return int(row[0]) if row else 0
