"""Seeded pseudo-random columns derived from keys.

A draw depends only on the seed and the row's key, so it is the same whatever the
partitioning, after a lost executor, and in any engine that has MD5.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(16 ** 12)
_LOW = np.uint64(0xFFFFFFFF)

# Cumulative Poisson(1) probabilities.
POISSON1_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336,
]


def uniform(seed, *keys) -> Column:
    """Uniform draw in [0, 1) keyed by ``seed`` and the key columns."""
    cols = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    cols += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(_SPAN)


def poisson1(u: Column) -> Column:
    """Poisson(1) count by inversion, the bootstrap weight of a row."""
    count = F.lit(0)
    for edge in POISSON1_CDF:
        count = count + F.when(u >= F.lit(edge), 1).otherwise(0)
    return count


def base32(seed, *keys) -> Column:
    """32 bits of the MD5 of seed and key, the start of a row's replicate draws."""
    cols = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def replicate_counts(base: np.ndarray, n: int) -> np.ndarray:
    """Poisson(1) counts of ``n`` replicates for rows with :func:`base32` values, rows x n.

    A replicate's draw mixes the base plus its number times a constant, modulo 2**32, so one
    digest a row serves all replicates.
    """
    x = (base.astype(np.uint64)[:, None] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B9)) & _LOW
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & _LOW
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & _LOW
    x = x ^ (x >> np.uint64(16))
    return np.searchsorted(np.array(POISSON1_CDF), x / 2.0 ** 32, "right").astype(np.float64)


def normal(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller) keyed like :func:`uniform`."""
    u1 = uniform(f"{seed}a", *keys)
    u2 = uniform(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
