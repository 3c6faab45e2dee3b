import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.functions.wordlists import STOP_WORDS
from topiloom.operators import corpus, nmf, temporal
from topiloom.plans import flagship, grid
from topiloom.config import TopicConfig
from topiloom.streaming import foldin


def sparse_docs(spark, x):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id bigint, ids array<int>, cnts array<double>")


@pytest.fixture(scope="module")
def blocks():
    rng = np.random.default_rng(0)
    x = rng.random((30, 12)) * 0.3
    for k in range(3):
        x[k * 10:(k + 1) * 10, k * 4:(k + 1) * 4] += 3
    return np.round(x * 10)


def theta_of(fit, n):
    out = np.zeros((n, fit.num_topics))
    for r in fit.theta.collect():
        out[r["doc_id"]] = r["w"]
    return out


@pytest.mark.parametrize("divergence", ["kl", "frobenius"])
def test_blocks_are_recovered(spark, blocks, divergence):
    fit = nmf.fit(sparse_docs(spark, blocks), 12, 3, divergence=divergence, max_iter=60)
    dom = theta_of(fit, 30).argmax(axis=1).reshape(3, 10)
    assert all(len(set(row)) == 1 for row in dom) and len({row[0] for row in dom}) == 3
    assert np.allclose(fit.matrix().sum(axis=1), 1) and np.allclose(theta_of(fit, 30).sum(axis=1), 1)
    drops = np.diff(fit.history)
    assert (drops <= 1e-6 * np.abs(fit.history[:-1])).all()


def test_kl_matches_dense_updates(spark, blocks):
    docs = sparse_docs(spark, blocks)
    n_iter, k = 7, 3
    start, ht = nmf.init_factors(docs.withColumn("dw", F.lit(1.0)), k, 12, seed=42)
    w = np.array([r["w"] for r in start.orderBy("doc_id").collect()])
    h = ht.T
    w = w * blocks.sum() / (w.sum(axis=0) @ h.sum(axis=1))
    for _ in range(n_iter):
        r = np.where(blocks > 0, blocks / np.maximum(w @ h, 1e-10), 0)
        h = h * (w.T @ r) / (w.sum(axis=0)[:, None] + 1e-10)
        r = np.where(blocks > 0, blocks / np.maximum(w @ h, 1e-10), 0)
        w = w * (r @ h.T) / (h.sum(axis=1)[None, :] + 1e-10)
    pos = blocks > 0
    obj = np.sum(blocks[pos] * np.log(blocks[pos] / (w @ h)[pos])) - blocks.sum() + (w @ h).sum()
    fit = nmf.fit(docs, 12, k, max_iter=n_iter, tol=0)
    assert fit.history[-1] == pytest.approx(obj, rel=1e-9)
    assert np.allclose(fit.matrix(), h / h.sum(axis=1, keepdims=True), atol=1e-9)


def test_repeatable_and_independent_of_partitions(spark, blocks):
    a = nmf.fit(sparse_docs(spark, blocks), 12, 3, max_iter=6, tol=0)
    b = nmf.fit(sparse_docs(spark, blocks).repartition(5), 12, 3, max_iter=6, tol=0)
    assert np.allclose(a.matrix(), b.matrix(), atol=1e-9)


def test_graph_pulls_neighbours_together(spark, blocks):
    edge = (np.array([0, 11]), np.array([11, 0]), np.array([1.0, 1.0]))
    plain = nmf.fit(sparse_docs(spark, blocks), 12, 3, max_iter=15, tol=0)
    pulled = nmf.fit(sparse_docs(spark, blocks), 12, 3, max_iter=15, tol=0, graphs=[(edge, 500.0)])

    def gap(f):
        h = f.matrix()
        return np.abs(h[:, 0] - h[:, 11]).sum()

    assert gap(pulled) < gap(plain)


def test_joined_solver_lowers_the_same_objective(spark, blocks):
    rows = [(i, int(j), float(blocks[i, j])) for i in range(30) for j in range(12) if blocks[i, j] > 0]
    bow = spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt double")
    vocab = spark.range(12).select(F.col("id").cast("int").alias("term_id"))
    fit = nmf.fit_joined(bow, vocab, 3, max_iter=4, tol=0, h_rows=12)
    assert all(a >= b for a, b in itertools.pairwise(fit.history))
    assert np.allclose(fit.matrix().sum(axis=1), 1)


def test_empty_document_folds_to_zero(spark, blocks):
    fit = nmf.fit(sparse_docs(spark, blocks), 12, 3, max_iter=20)
    x = np.vstack([blocks[:3], np.zeros((1, 12))])
    got = {r["doc_id"]: r["w"] for r in nmf.fold_in(sparse_docs(spark, x), fit.matrix()).collect()}
    assert got[3] == [0.0, 0.0, 0.0]
    assert np.argmax(got[0]) == theta_of(fit, 30)[0].argmax()


def test_perplexity_below_uniform(spark, blocks):
    docs = sparse_docs(spark, blocks)
    fit = nmf.fit(docs, 12, 3, max_iter=20)
    h = fit.matrix()
    assert nmf.perplexity(docs, nmf.fold_in(docs, h), h) < 12
    empty = sparse_docs(spark, np.zeros((2, 12)))
    with pytest.raises(ValueError):
        nmf.perplexity(empty, nmf.fold_in(empty, h), h)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        for _ in range(10):
            s = rng.normal(size=(n, n))
            best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            cols = nmf.assign(s)
            assert sorted(cols) == list(range(n)) and s[np.arange(n), cols].sum() == pytest.approx(best)


def test_bootstrap_and_drift(spark, blocks):
    docs = sparse_docs(spark, blocks)
    ref = nmf.fit(docs, 12, 3, max_iter=10)
    boot = nmf.bootstrap(docs, ref, n_resamples=2, max_iter=5).collect()
    assert len(boot) == 3 and all(0 <= r["stability"] <= 1 + 1e-9 for r in boot)
    order = spark.createDataFrame([(i, float(i % 10)) for i in range(30)], "doc_id bigint, ts double")
    out = temporal.drift(docs, temporal.slices(order, 2), 12, 3, max_iter=5).orderBy("slice").collect()
    assert out[0]["drift"] == 0.0 and sum(r["n"] for r in out) == 30
    with pytest.raises(ValueError):
        temporal.drift(docs, temporal.slices(order, 2), 12, 3, chunked=True)


POOLS = [["alpha", "beta", "gamma", "delta"], ["rosso", "verde", "giallo", "nero"]]


@pytest.fixture(scope="module")
def pool_docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(POOLS[i % 2], size=12))) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_end_to_end_report_and_stream(spark, pool_docs, tmp_path):
    cfg = TopicConfig(num_topics=2, min_df=2, max_iter=20, lambda_syntax=0.0, lambda_embed=0.0, vector_backend="none")
    model = flagship.fit_documents(pool_docs, cfg)
    info = model.topic_info(4).collect()
    assert sum(r["size"] for r in info) == 24
    assert {frozenset(r["top_words"].split(", ")) for r in info} == {frozenset(p) for p in POOLS}
    hidden = {r["term"] for r in model.top_words(4, hide=["alpha"]).collect()}
    assert "alpha" not in hidden and len(hidden) == 7
    scores = model.evaluate(4)
    assert scores["redundancy"] == 0.0 and scores["npmi"] > 0.5

    src = str(tmp_path / "in")
    pool_docs.write.parquet(src)
    stream = spark.readStream.schema(pool_docs.schema).parquet(src)
    h = model.result.matrix()
    q = foldin.score_stream(stream, model.parsed.vocab, h, STOP_WORDS["eng"]).writeStream.format("memory") \
        .queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {r["doc_id"]: r["w"] for r in spark.table("scored").collect()}
    lists = corpus.word_lists(pool_docs, F.split("text", " "))
    batch = {r["doc_id"]: r["w"] for r in model.transform(pool_docs, lists).collect()}
    assert live.keys() == batch.keys() and all(np.allclose(live[i], batch[i], atol=1e-9) for i in batch)


def test_search_k_ignores_undefined_scores():
    nan = float("nan")
    for order in ((2, 4, 6), (6, 4, 2)):
        best, out = grid.search_k(lambda k: ({2: nan, 4: 0.42, 6: 0.1}.get(k, 0.2), 1.0), order, finetune=False)
        assert best == 4 and len(out) == 3
    best, out = grid.search_k(lambda k: (1.0 / k, 1.0), (5, 10), finetune=True)
    assert set(out) > {5, 10} and best == min(out)
    with pytest.raises(RuntimeError):
        grid.search_k(lambda k: (nan, 1.0), (2, 3))
    with pytest.raises(ValueError):
        grid.search_k(lambda k: (1.0, 1.0), (1, 3))


def test_grid_is_validated_and_resumes(spark, pool_docs, tmp_path):
    with pytest.raises(ValueError):
        grid.expand(spark, ["a"], ["m", "m"], [0], [2])
    with pytest.raises(ValueError):
        grid.expand(spark, ["a"], [], [0], [2])
    cfg = TopicConfig(num_topics=2, min_df=2, max_iter=3, lambda_syntax=0.0, lambda_embed=0.0, vector_backend="none")
    lists = corpus.word_lists(pool_docs, F.split("text", " "))
    corpora = {"pools": (pool_docs.select("doc_id"), None, lists)}
    path = str(tmp_path / "runs")
    assert grid.run(spark, corpora, [grid.ModelSpec("a", cfg)], (0,), (2,), path).count() == 1
    assert grid.run(spark, corpora, [grid.ModelSpec("a", cfg)], (0, 1), (2,), path).count() == 2
