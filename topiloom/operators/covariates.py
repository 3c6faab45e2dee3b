"""Covariate encoding and effects on topic prevalence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded
from . import stats


def encode_text(docs: DataFrame, col: str) -> DataFrame:
    """``(doc_id, level, pos)``: the one-hot position of each level in sorted order."""
    levels = sorted(r[0] for r in collect_bounded(docs.select(col).distinct()))
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)) - 1
    return docs.select("doc_id", F.col(col).alias("level"), pos.cast("int").alias("pos"))


def one_hot(encoded: DataFrame, n_levels: int) -> DataFrame:
    """``(doc_id, vec)`` with a 1 at the level's position."""
    return encoded.select("doc_id", F.transform(
        F.sequence(F.lit(0), F.lit(n_levels - 1)),
        lambda i: (i == F.col("pos")).cast("double")).alias("vec"))


def encode_number(docs: DataFrame, col: str) -> DataFrame:
    """``(doc_id, z)``: z-score with the population sd plus 1e-10."""
    mean, sd = docs.agg(F.avg(col), F.stddev_pop(col)).first()
    z = (F.col(col) - F.lit(float(mean or 0.0))) / F.lit(float(sd or 0.0) + 1e-10)
    return docs.select("doc_id", z.alias("z"))


def spread_to_segments(segments: DataFrame, encoded: DataFrame) -> DataFrame:
    """Each segment with its document's encoded covariate."""
    return segments.select("doc_id", "seg_id").join(encoded, "doc_id")


def effect_bootstrap(theta: DataFrame, covariates: DataFrame, names: Sequence[str], num_topics: int,
                     n_bootstrap: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``(topic, term, coef, ci_low, ci_high, p, n_bootstrap)`` of OLS on intercept + covariates.

    ``theta(doc_id, w)`` and ``covariates(doc_id, names...)``; documents without a covariate are
    left out. One pass adds up X'X and X'theta for the data and for every replicate, each
    document weighted by a Poisson(1) count of its id; only those small matrices are shuffled
    and solved on the driver.
    """
    names = list(names)
    terms = ["intercept"] + names
    p, k = len(terms), num_topics
    x = [F.lit(1.0)] + [F.col(n).cast("double") for n in names]
    cells = {f"g{i}_{j}": x[i] * x[j] for i in range(p) for j in range(i, p)}
    cells |= {f"y{i}_{t}": x[i] * F.col("w")[t] for i in range(p) for t in range(k)}
    rows = theta.join(covariates.dropna(subset=names), "doc_id").select("doc_id", *[c.alias(n) for n, c in cells.items()])
    # one row for each replicate
    sums = stats.replicate_sums(rows, "doc_id", [], list(cells), n_bootstrap, seed).collect()
    draws, point = [], None
    for r in sums:
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        y = np.array([[r[f"y{i}_{t}"] for t in range(k)] for i in range(p)])
        coef = np.linalg.lstsq(g, y, rcond=None)[0]
        if r["_b"] < 0:
            point = coef
        else:
            draws.append(coef)
    draws = np.array(draws)
    a = (1.0 - level) / 2.0
    low, high = np.quantile(draws, [a, 1.0 - a], axis=0)
    out = []
    for t in range(k):
        for j, term in enumerate(terms):
            s = draws[:, j, t]
            both = 2.0 * min(float((s <= 0).mean()), float((s >= 0).mean()))
            out.append((t + 1, term, float(point[j, t]), float(low[j, t]), float(high[j, t]),
                        min(both, 1.0), n_bootstrap))
    return theta.sparkSession.createDataFrame(
        out, "topic int, term string, coef double, ci_low double, ci_high double, p double, n_bootstrap int")


def _t_tail(t: float, df: float) -> float:
    """Two-sided Student t tail by the continued fraction of the incomplete beta."""
    if df <= 0 or not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    flip = x > (a + 1.0) / (a + b + 2.0)
    if flip:
        x, a, b = 1.0 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a if 0 < x < 1 else 0.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or 1e-300)
            c = 1.0 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return 1.0 - front * h if flip else front * h


def effect_ols(theta: DataFrame, covariate: DataFrame) -> DataFrame:
    """``(topic, coef, se, p, r2)`` of each topic on the z-scored covariate.

    ``theta(doc_id, topic, weight)``, ``covariate(doc_id, z)``. The regression is a set
    of built-in aggregates; only K rows reach the driver for the t tail.
    """
    rows = theta.join(covariate, "doc_id").groupBy("topic").agg(
        F.regr_slope("weight", "z").alias("coef"), F.coalesce(F.regr_r2("weight", "z"), F.lit(0.0)).alias("r2"),
        F.regr_sxx("weight", "z").alias("sxx"), F.regr_syy("weight", "z").alias("syy"),
        F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("se", F.sqrt(F.greatest(
        (F.col("syy") * (1.0 - F.col("r2"))) / ((F.col("n") - 2) * F.col("sxx")), F.lit(0.0))))
    out = []
    for r in collect_bounded(rows):
        t = r["coef"] / r["se"] if r["se"] else math.inf
        out.append((int(r["topic"]), float(r["coef"]), float(r["se"]), _t_tail(t, r["n"] - 2), float(r["r2"])))
    return theta.sparkSession.createDataFrame(
        sorted(out, key=lambda r: r[1]), "topic int, coef double, se double, p double, r2 double")
