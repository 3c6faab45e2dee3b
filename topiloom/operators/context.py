"""Contextual vectors, topic-word softmax, posterior draws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded, vec
from ..session import bounded, settle
from .sparse import dense, lists

STATE_CELLS = 8_000_000   # numbers of the states that a task holds
_CONTEXTS = 50_000        # contexts merged at once


def context_pairs(bow_df: DataFrame, embeddings: DataFrame, cap: int | None = 50, seed: int = 42) -> DataFrame:
    """``(term_id, doc_id)``: up to ``cap`` documents with a vector for each word, or all of them.

    A document counts once per word; the kept ones are the first in a seeded order. The rank is
    limited on the map side, so a frequent word sends ``cap`` rows per task.
    """
    met = bow_df.select("term_id", "doc_id").join(embeddings.select("doc_id"), "doc_id", "left_semi")
    if cap is None:
        return met.select("term_id", "doc_id")
    w = Window.partitionBy("term_id").orderBy(seeded.uniform(seed, "term_id", "doc_id"), "doc_id")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select("term_id", "doc_id")


def collect_contexts(bow_df: DataFrame, embeddings: DataFrame, cap: int | None = 50, seed: int = 42) -> DataFrame:
    """``(term_id, doc_id, vec)``: the contexts with their vectors."""
    return context_pairs(bow_df, embeddings, cap, seed).join(
        embeddings.select("doc_id", vec.doubles("vec").alias("vec")), "doc_id").select("term_id", "doc_id", "vec")


def coverage(contexts: DataFrame, n_terms: int) -> DataFrame:
    """Share of the vocabulary that has a context."""
    return contexts.agg(F.countDistinct("term_id").alias("n_words")).select(
        "n_words", (F.col("n_words") / F.lit(float(max(n_terms, 1)))).alias("share"))


def _softmax(rows: DataFrame, temperature: float) -> DataFrame:
    z = F.col("sim") / F.lit(temperature)
    peak = rows.groupBy("topic").agg(F.max(z).alias("m"))
    e = rows.join(peak, "topic").select("topic", "term_id", F.exp(z - F.col("m")).alias("e"))
    total = e.groupBy("topic").agg(F.sum("e").alias("t"))
    return e.join(total, "topic").select("topic", "term_id", (F.col("e") / F.col("t")).alias("weight"))


def _per_topic(rows: DataFrame, topics: list[tuple[int, list[float]]]) -> DataFrame:
    """Every row once per topic; the few topic vectors travel as literals."""
    table = F.array(*[
        F.struct(F.lit(int(t)).alias("topic"), vec.lit_array([float(x) for x in v]).alias("tv"))
        for t, v in topics])
    return rows.withColumn("_t", F.explode(table)).select("*", "_t.topic", "_t.tv").drop("_t")


def static_beta(topics: list[tuple[int, list[float]]], vectors: DataFrame,
                temperature: float = 0.1) -> DataFrame:
    """``(topic, term_id, weight)``: softmax over words of cosine(topic, word) / T."""
    sims = _per_topic(vectors.select("term_id", vec.doubles("vec").alias("vec")), topics).select(
        "topic", "term_id", vec.cosine("vec", "tv", 1e-8).alias("sim"))
    return _softmax(sims, temperature)


def attention_states(pairs: DataFrame, embeddings: DataFrame, topics: list[tuple[int, list[float]]], dim: int) -> DataFrame:
    """``(term_id, topic, m, s, v)``: softmax-weighted sums of the contexts of each word.

    ``pairs`` are ``(term_id, doc_id)``. A document's vector is read once for all its words. The
    state of a word and a topic is the largest logit so far, the sum of exp(logit - largest)
    and the vectors summed with those weights; a new largest logit rescales both sums. States
    of different tasks merge in the same way, so neither a second reading of the contexts nor
    a cap on them is needed. A task sends its states on when they reach ``STATE_CELLS``.
    """
    order = [int(t) for t, _ in topics]
    tv = np.array([v for _, v in topics], dtype=float)
    k = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = np.zeros(0, np.int64), np.zeros((0, k))
        s, v = np.zeros((0, k)), np.zeros((0, k, dim))

        def sent():
            n = len(terms)
            flat = np.concatenate([m[:, :, None], s[:, :, None], v], axis=2).reshape(n * k, dim + 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(terms, k).astype(np.int32)), pa.array(np.tile(order, n).astype(np.int32)),
                 pa.array(flat[:, 0]), pa.array(flat[:, 1]), lists(flat[:, 2:])], names=["term_id", "topic", "m", "s", "v"])

        for rb in batches:
            off = rb.column(0).offsets.to_numpy()
            ids = rb.column(0).values.to_numpy()[off[0]:off[-1]].astype(np.int64)
            rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
            x = dense(rb.column(1), dim)
            z = x @ tv.T
            for lo in range(0, len(ids), _CONTEXTS):
                new, row = ids[lo:lo + _CONTEXTS], rows[lo:lo + _CONTEXTS]
                sort = np.argsort(new, kind="stable")
                new, row = new[sort], row[sort]
                fresh, first = np.unique(new, return_index=True)
                both = np.union1d(terms, fresh)
                old, at = np.searchsorted(both, terms), np.searchsorted(both, fresh)
                top = np.full((len(both), k), -np.inf)
                top[old] = m
                top[at] = np.maximum(top[at], np.maximum.reduceat(z[row], first))
                keep = np.zeros((len(both), k)), np.zeros((len(both), k, dim))
                down = np.exp(m - top[old])
                keep[0][old], keep[1][old] = s * down, v * down[:, :, None]
                a = np.exp(z[row] - top[np.searchsorted(both, new)])
                keep[0][at] += np.add.reduceat(a, first)
                for t in range(k):
                    keep[1][at, t] += np.add.reduceat(x[row] * a[:, t:t + 1], first)
                terms, m, s, v = both, top, *keep
                if len(terms) * k * dim > STATE_CELLS:
                    yield sent()
                    terms, m, s, v = terms[:0], m[:0], s[:0], v[:0]
        if len(terms):
            yield sent()

    docs = pairs.groupBy("doc_id").agg(F.collect_set("term_id").alias("ids")).join(
        embeddings.select("doc_id", vec.doubles("vec").alias("vec")), "doc_id")
    parts = settle(docs.select(F.col("ids").cast("array<int>").alias("ids"), "vec").mapInArrow(
        run, "term_id int, topic int, m double, s double, v array<double>"), "attention")
    top = parts.groupBy("term_id", "topic").agg(F.max("m").alias("top"))
    down = F.exp(F.col("m") - F.col("top"))
    return parts.join(top, ["term_id", "topic"]).groupBy("term_id", "topic").agg(
        F.max("m").alias("m"), F.sum(F.col("s") * down).alias("s"), vec.sum_arrays("v", dim, down).alias("v"))


def contextual_similarity(topics: list[tuple[int, list[float]]], pairs: DataFrame, embeddings: DataFrame,
                          vectors: DataFrame, dim: int) -> DataFrame:
    """``(topic, term_id, sim)``: cosine of topic and attention-pooled contexts.

    Words without a context use their static vector.
    """
    table = F.array(*[F.struct(F.lit(int(t)).alias("topic"), vec.lit_array([float(x) for x in v]).alias("tv")) for t, v in topics])
    states = attention_states(pairs, embeddings, topics, dim)
    own = F.element_at(F.filter(table, lambda t: t["topic"] == F.col("topic")), 1)["tv"]
    with_ctx = settle(states.select("topic", "term_id", vec.cosine("v", own, 1e-8).alias("sim")), "similarity")
    bare = vectors.join(with_ctx.select("term_id").distinct(), "term_id", "left_anti")
    without = _per_topic(bare.select("term_id", vec.doubles("vec").alias("vec")), topics).select(
        "topic", "term_id", vec.cosine("vec", "tv", 1e-8).alias("sim"))
    return with_ctx.unionByName(without)


def contextual_beta(topics, pairs: DataFrame, embeddings: DataFrame, vectors: DataFrame, dim: int,
                    temperature: float = 0.1) -> DataFrame:
    """``(topic, term_id, weight)``: softmax over words of the contextual similarity."""
    return _softmax(contextual_similarity(topics, pairs, embeddings, vectors, dim), temperature)


def expected_at(cells: DataFrame, theta: DataFrame, phi: DataFrame, num_topics: int,
                bound: int | None) -> DataFrame:
    """``(doc_id, term_id, p)``: theta times beta at the wanted ``(doc_id, term_id)`` cells.

    Both factors are joined as one array of K numbers per document and per term. The cells of a
    document meet its topics as one row, so no array is shuffled for each cell. Cells may come as
    rows ``(doc_id, ids, cnts)``; then the result also has ``cnt``.
    """
    wide = bounded(wide_rows(phi, "term_id", num_topics, "b"), bound)
    docs = wide_rows(theta, "doc_id", num_topics, "w")
    if "ids" in cells.columns:
        met = cells.select("doc_id", F.arrays_zip("ids", "cnts").alias("c")).join(docs, "doc_id").select(
            "doc_id", "w", F.inline("c").alias("term_id", "cnt"))
    else:
        met = cells.groupBy("doc_id").agg(F.collect_list("term_id").alias("c")).join(docs, "doc_id").select(
            "doc_id", "w", F.explode("c").alias("term_id"))
    p = F.col("w")[0] * F.col("b")[0]
    for t in range(1, num_topics):
        p = p + F.col("w")[t] * F.col("b")[t]
    return met.join(wide, "term_id").select("doc_id", *met.columns[2:], p.alias("p"))


def wide_rows(rows: DataFrame, key: str, num_topics: int, name: str) -> DataFrame:
    """Long ``(key, topic, weight)`` as one array of K numbers per key."""
    return rows.groupBy(key).agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("topic") == t, F.col("weight"))), F.lit(0.0))
        for t in range(num_topics)]).alias(name))


def expected_words(theta: DataFrame, beta: np.ndarray, top_k: int) -> DataFrame:
    """``(doc_id, rank, term_id, p)``: the likeliest words of ``theta(doc_id, w)``.

    The K x V matrix is broadcast and each batch keeps its ``top_k``; ties go to the
    lower id.
    """
    k = beta.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            w = dense(rb.column(1), k)
            for s in range(0, len(w), 256):
                p = w[s:s + 256] @ beta
                best = np.argsort(-p, axis=1, kind="stable")[:, :top_k]
                n, m = best.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rb.column(0).to_numpy()[s:s + 256], m)),
                     pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                     pa.array(best.ravel().astype(np.int32)),
                     pa.array(np.take_along_axis(p, best, axis=1).ravel())],
                    names=["doc_id", "rank", "term_id", "p"])

    return theta.select("doc_id", "w").mapInArrow(
        run, "doc_id bigint, rank int, term_id int, p double")


def refine(embeddings: DataFrame, dominant: DataFrame, topics: DataFrame, num_topics: int,
           blend: float) -> DataFrame:
    """``(doc_id, vec)``: document vectors pulled towards their dominant topic centroid."""
    centre = bounded(topics.select("topic", vec.unit(vec.doubles("vec")).alias("c")), num_topics)
    return (
        embeddings.join(dominant.select("doc_id", "topic"), "doc_id").join(centre, "topic")
        .select("doc_id", vec.unit(F.zip_with(
            vec.doubles("vec"), "c", lambda a, b: a * (1.0 - blend) + b * blend)).alias("vec"))
    )


def kmeans_centres(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 300, n_init: int = 5) -> DataFrame:
    """``(topic, vec)``: unit-length k-means centres of the word vectors.

    The fit is repeated from ``n_init`` seeded starts, side by side; the one with the smallest
    sum of squared distances is kept, the first on ties.
    """
    feats = vectors.select(array_to_vector(vec.doubles("vec")).alias("features")).persist()
    feats.count()                       # read once, before the starts
    with ThreadPool(n_init) as pool:
        models = pool.map(lambda s: KMeans(k=k, seed=s, maxIter=max_iter).fit(feats), range(seed, seed + n_init))
    model = min(models, key=lambda m: m.summary.trainingCost)
    feats.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "topic int, vec array<double>").select(
        "topic", vec.unit("vec").alias("vec"))


def mean_best_similarity(vectors: DataFrame, topics: list[tuple[int, list[float]]]) -> DataFrame:
    """Mean over words of the largest cosine with any topic."""
    best = _per_topic(vectors.select("term_id", vec.doubles("vec").alias("vec")), topics).groupBy(
        "term_id").agg(F.max(vec.cosine("vec", "tv")).alias("s"))
    return best.agg(F.avg("s").alias("mean_best_similarity"))


def posterior_draws(posterior: DataFrame, n_samples: int, num_topics: int, seed: int = 0) -> DataFrame:
    """``(doc_id, topic, mean, sd)`` of softmax draws from ``posterior(doc_id, mu, logvar)``.

    Draws are summed over the sample index inside each row, so nothing is exploded or
    shuffled.
    """
    ks = range(num_topics)
    zero = vec.zeros(2 * num_topics)

    def draw(acc, s):
        z = [F.col("mu")[k] + F.exp(F.col("logvar")[k] * 0.5)
             * seeded.normal(seed, F.col("doc_id"), s, F.lit(k)) for k in ks]
        e = vec.let(F.array(*z), lambda zs: vec.let(F.array_max(zs), lambda m: F.transform(zs, lambda x: F.exp(x - m))))
        p = vec.let(e, lambda es: vec.let(vec.total(es), lambda t: F.transform(es, lambda x: x / t)))
        squares = vec.let(p, lambda ps: F.concat(ps, F.transform(ps, lambda x: x * x)))
        return F.zip_with(acc, squares, lambda a, b: a + b)

    sums = F.aggregate(F.sequence(F.lit(1), F.lit(n_samples)), zero, draw)
    n = float(n_samples)
    return (
        posterior.select("doc_id", sums.alias("s"))
        .select("doc_id", F.explode(F.array(*[
            F.struct(F.lit(k).alias("topic"), F.col("s")[k].alias("s1"),
                     F.col("s")[num_topics + k].alias("s2")) for k in ks])).alias("r"))
        .select("doc_id", "r.topic", (F.col("r.s1") / n).alias("mean"),
                F.sqrt(F.greatest(F.col("r.s2") - F.col("r.s1") * F.col("r.s1") / n, F.lit(0.0))
                       / (n - 1.0)).alias("sd"))
    )


def uncertainty_regimes(draws: DataFrame, num_topics: int, high: float = 0.08,
                        low: float = 0.02) -> DataFrame:
    """One row per document: regime, mean sd, entropy and dominant topic (1-based)."""
    e = F.col("entropy")
    cut = 0.6 * math.log(num_topics)
    best = F.max(F.struct("mean", (-F.col("topic")).alias("n")))
    stats = draws.groupBy("doc_id").agg(
        F.avg("sd").alias("std"),
        (-F.sum(F.col("mean") * F.log(F.col("mean") + 1e-10))).alias("entropy"),
        best.alias("b"))
    regime = (
        F.when(F.col("std") < low, "CERTAIN")
        .when((F.col("std") > high) & (e > cut), "AMBIGUOUS")
        .when(F.col("std") > high, "POORLY_ENCODED").otherwise("MODERATE"))
    return stats.select(
        "doc_id", regime.alias("regime"), F.round("std", 4).alias("mean_std_mc"),
        F.round("entropy", 4).alias("entropy_theta"), (1 - F.col("b.n")).cast("int").alias("dominant_topic"),
        F.round("b.mean", 3).alias("dominant_prob"))


def regime_counts(regimes: DataFrame) -> DataFrame:
    """Documents and share per regime."""
    counts = regimes.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"))   # four rows
