"""Topic prevalence and drift over quantile slices of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..session import settle
from . import nmf, stats


def seconds(c) -> Column:
    """Timestamp as epoch seconds with fraction."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / 1e6


def slices(times: DataFrame, n_slices: int) -> DataFrame:
    """``(doc_id, ts, slice)`` from ``times(doc_id, ts)`` with ts in seconds.

    The slice is the number of interior quantile edges strictly below ts.
    """
    probs = [i / n_slices for i in range(1, n_slices)]
    label = F.lit(0)
    for edge in exact_quantiles(times, "ts", probs):
        label = label + F.when(F.col("ts") > F.lit(edge), 1).otherwise(0)
    return times.select("doc_id", "ts", label.alias("slice"))


def prevalence(theta: DataFrame, sliced: DataFrame, n_resamples: int = 200, level: float = 0.95,
               seed: int = 0) -> DataFrame:
    """``(slice, topic, n, mean, ci_low, ci_high)`` with 1-based topics; empty slices are absent."""
    rows = theta.join(sliced.select("doc_id", "slice"), "doc_id")
    ci = stats.bootstrap_poisson(rows, "weight", "doc_id", ["slice", "topic"], n_resamples, level, seed)
    return ci.select("slice", (F.col("topic") + 1).alias("topic"), "n", F.col("estimate").alias("mean"),
                     "ci_low", "ci_high")


def drift(docs: DataFrame, sliced: DataFrame, n_terms: int, num_topics: int, graphs=(),
          max_iter: int = 200, tol: float = 1e-4, seed: int = 42, init: str = "svd",
          chunked: bool = False) -> DataFrame:
    """Refit each slice on the shared vocabulary and graphs, align it to the first slice.

    All slices are fitted in the same passes, each by the weight of its documents.

    ``drift`` is one minus the mean matched cosine. Slices with fewer documents than
    topics are skipped.
    """
    if chunked:
        raise ValueError("drift needs one row per document; switch chunking off")
    labelled = settle(docs.join(sliced.select("doc_id", "slice"), "doc_id"))
    sizes = {r["slice"]: r["n"] for r in labelled.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [s for s in sorted(sizes) if sizes[s] >= num_topics]
    fits = nmf.fit_many(labelled, n_terms, [
        nmf.Job(num_topics, graphs=graphs, seed=seed, weight=(F.col("slice") == s).cast("double"), max_iter=max_iter, tol=tol, init=init)
        for s in kept])
    out = []
    for s, res in zip(kept, fits):
        same = res is fits[0]
        stability = 1.0 if same else float(nmf.match_topics(fits[0].phi, res.phi, num_topics)[1].mean())
        out.append((int(s), int(sizes[s]), res.n_iter, float(res.objective), stability, 1.0 - stability))
    return docs.sparkSession.createDataFrame(
        out, "slice int, n bigint, n_iter int, objective double, stability_vs_first double, drift double")
