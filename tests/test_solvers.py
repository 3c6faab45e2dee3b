"""Batched and blocked factorisations beside single bounded fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.config import TopicConfig
from topiloom.functions import seeded
from topiloom.operators import blocked, corpus, nmf, sparse, temporal
from topiloom.plans import fit as fits
from topiloom.plans import grid

SRC, DST, VAL = np.array([0, 24, 1, 9]), np.array([24, 0, 9, 1]), np.array([1.0, 1.0, 0.5, 0.5])


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(0)
    x = rng.random((60, 25)) * 0.3
    for k in range(3):
        x[k * 20:(k + 1) * 20, k * 8:(k + 1) * 8] += 3
    return np.round(x * 10) * (rng.random((60, 25)) < 0.8)


@pytest.fixture(scope="module")
def docs(spark, counts):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id bigint, ids array<int>, cnts array<double>")


def theta_of(fit):
    return {r["doc_id"]: np.array(r["w"]) for r in fit.theta.collect()}


def assert_same(a, b):
    assert a.n_iter == b.n_iter and np.allclose(a.history, b.history, rtol=1e-9)
    assert np.allclose(a.matrix(), b.matrix(), atol=1e-9)
    ta, tb = theta_of(a), theta_of(b)
    assert ta.keys() == tb.keys() and all(np.allclose(ta[i], tb[i], atol=1e-9) for i in ta)


def test_batch_equals_single_fits(docs):
    jobs = [nmf.Job(3, max_iter=8, tol=1e-3, seed=5 + b, weight=seeded.poisson1(seeded.uniform(f"0:{b}", "doc_id"))) for b in range(3)]
    jobs += [nmf.Job(2, "frobenius", max_iter=4, init="random"), nmf.Job(4, max_iter=7, graphs=[((SRC, DST, VAL), 0.5)])]
    for job, got in zip(jobs, nmf.fit_many(docs, 25, jobs)):
        assert_same(got, nmf.fit_many(docs, 25, [job])[0])


def test_small_batches_equal_one_batch(docs, monkeypatch):
    jobs = [nmf.Job(k, max_iter=3, tol=0) for k in (2, 3, 4)]
    together = nmf.fit_many(docs, 25, jobs)
    monkeypatch.setattr(nmf, "BATCH_CELLS", 1)
    monkeypatch.setattr(nmf, "DIRECT_CELLS", 0)
    for a, b in zip(together, nmf.fit_many(docs, 25, jobs)):
        assert_same(a, b)


def test_weight_repeats_documents(spark, docs, counts):
    """A weight of two is the document twice."""
    twice = np.vstack([counts, counts[::3]])
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(twice)]
    plain = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, cnts array<double>")
    weight = F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0)
    a, _ = sparse.truncated_svd(plain, 25, 3)
    b = sparse.truncated_svds(docs.withColumn("dw", F.array(weight)), 25, {0: (3, 0)}, 1)[0][0]
    assert np.allclose(a, b, rtol=1e-4)
    one, two = (nmf.fit(d, 25, 3, max_iter=30, tol=0, weight=w) for d, w in ((plain, None), (docs, weight)))
    assert one.history[-1] == pytest.approx(two.history[-1], rel=0.02)


def test_given_factors_follow_the_dense_updates(spark, docs, counts):
    rng = np.random.default_rng(3)
    w, h = rng.random((60, 2)) + 0.1, rng.random((2, 25)) + 0.1
    start = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(w)], "doc_id bigint, w array<double>")
    fit = nmf.fit(docs, 25, 2, max_iter=3, tol=0, start=(start, h))
    for _ in range(3):
        r = np.where(counts > 0, counts / np.maximum(w @ h, 1e-10), 0)
        h = h * (w.T @ r) / (w.sum(axis=0)[:, None] + 1e-10)
        r = np.where(counts > 0, counts / np.maximum(w @ h, 1e-10), 0)
        w = w * (r @ h.T) / (h.sum(axis=1)[None, :] + 1e-10)
    assert np.allclose(fit.matrix(), h / h.sum(axis=1, keepdims=True), atol=1e-9)


@pytest.mark.parametrize("divergence,weighted", [("kl", True), ("frobenius", False)])
def test_blocked_equals_bounded(spark, docs, divergence, weighted):
    edges = spark.createDataFrame(list(zip(SRC.tolist(), DST.tolist(), VAL.tolist())), "src int, dst int, weight double")
    weight = F.col("doc_id") % 3 if weighted else None
    a = nmf.fit(docs, 25, 3, divergence=divergence, max_iter=3, tol=0, graphs=[((SRC, DST, VAL), 0.5)], weight=weight)
    b = blocked.fit(docs, 25, 3, divergence=divergence, max_iter=3, tol=0, edges=[(edges, 0.5)], weight=weight, block_entries=200)
    assert_same(a, b)
    h = a.matrix()
    one, two = nmf.fold_in(docs, h, n_iter=5, divergence=divergence), blocked.fold_in(docs, b.phi, 25, 3, n_iter=5, divergence=divergence, block_entries=300)
    left, right = ({r["doc_id"]: r["w"] for r in x.collect()} for x in (one, two))
    assert left.keys() == right.keys() and all(np.allclose(left[i], right[i], atol=1e-9) for i in left)
    assert nmf.perplexity(docs, one, h) == pytest.approx(blocked.perplexity(docs, two, b.phi, 25, 3, block_entries=300))


def test_counts_stay_where_they_are(spark, docs):
    """Only factors are exchanged in a pass; the counts are read bucket by bucket."""
    blocks = blocked.Blocks(docs, 25, block_entries=100)
    h = blocked._noise_rows(spark, 25, 2, 0)
    plan = blocks.apply(h, lambda *a: (None, None, None))._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index("Bucketed: true")].rsplit("\n:", 1)[-1] if "Bucketed: true" in plan else ""
    blocks.close()
    assert scan and "Exchange" not in scan


def test_unbounded_fit_equals_bounded_fit(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pools = [["alpha", "beta", "gamma", "delta"], ["rosso", "verde", "giallo", "nero"]]
    rows = [(i, [str(x) for x in rng.choice(pools[i % 2], size=12)]) for i in range(24)]
    lists = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    cfg = {"num_topics": 2, "min_df": 2, "max_iter": 3, "tol": 0.0, "lambda_syntax": 0.0, "lambda_embed": 0.0, "vector_backend": "none"}
    a = fits.fit(lists.select("doc_id"), None, TopicConfig(**cfg), lists=lists)
    monkeypatch.setattr(fits, "DRIVER_CELLS", 0)
    b = fits.fit(lists.select("doc_id"), None, TopicConfig(max_features=None, **cfg), lists=lists)
    assert_same(a.result, b.result)
    assert b.evaluate(4)["diversity"] == a.evaluate(4)["diversity"]


def test_grid_points_are_fitted_together(spark, docs, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    lists = spark.createDataFrame([(i, [f"w{x}" for x in rng.integers(0, 12, 15)]) for i in range(20)], "doc_id bigint, tokens array<string>")
    cfg = TopicConfig(num_topics=2, min_df=1, max_iter=3, lambda_syntax=0.0, lambda_embed=0.0, vector_backend="none")
    calls = []
    many = nmf.fit_many
    monkeypatch.setattr(nmf, "fit_many", lambda d, v, jobs: calls.append(len(jobs)) or many(d, v, jobs))
    corpora = {"c": (lists.select("doc_id"), None, lists)}
    out = grid.run(spark, corpora, [grid.ModelSpec("a", cfg), grid.ModelSpec("b", cfg, "permute")], (0, 1), (2, 3), str(tmp_path / "runs"))
    assert out.count() == 8 and calls == [8]
    again = grid.run(spark, corpora, [grid.ModelSpec("a", cfg)], (0, 1), (2, 3), str(tmp_path / "runs"))
    assert again.count() == 8 and calls == [8]


def test_search_fits_a_round_together():
    asked = []
    best, out = grid.search_k(lambda k: (1.0 / k, 1.0), (5, 10), prepare=asked.append)
    assert asked[0] == [5, 10] and len(asked) == 2 and best == min(out)


def test_slices_are_weights(spark, docs):
    order = spark.createDataFrame([(i, float(i % 10)) for i in range(60)], "doc_id bigint, ts double")
    cut = temporal.slices(order, 2)
    out = temporal.drift(docs, cut, 25, 3, max_iter=4, tol=0).orderBy("slice").collect()
    part = docs.join(cut.where("slice = 1").select("doc_id"), "doc_id")
    assert out[1]["objective"] == pytest.approx(nmf.fit(part, 25, 3, max_iter=4, tol=0).objective)


def test_stored_parse_serves_the_same_corpus_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta gamma w{i % 3}") for i in range(12)], "doc_id bigint, text string")
    lists = docs.select("doc_id", F.split("text", " ").alias("tokens"))
    cfg = TopicConfig(num_topics=2, min_df=2, max_iter=3, lambda_syntax=0.0, lambda_embed=0.0, vector_backend="none")
    path = str(tmp_path / "parse")
    first, why = fits.stored_parse(docs, None, cfg, path, lists)
    assert why and first.n_docs == 12
    again, why = fits.stored_parse(docs, None, cfg, path, lists.where("false"))
    assert not why and {r["term"] for r in again.vocab.collect()} == {r["term"] for r in first.vocab.collect()}
    one, two = (fits.fit(None, None, cfg, parsed=p) for p in (first, again))
    assert_same(one.result, two.result)
    other = docs.withColumn("text", F.concat("text", F.lit("!")))
    assert any("corpus_hash" in x for x in fits.stored_parse(other, None, cfg, path, lists)[1])


def test_terms_are_the_words_of_lemmas(spark):
    lists = spark.createDataFrame([(1, ["l'acqua", "Fiume", "e-mail", "x2y"]), (2, [])], "doc_id bigint, tokens array<string>")
    got = {r["doc_id"]: r["tokens"] for r in corpus.term_lists(lists).collect()}
    assert got == {1: ["acqua", "fiume", "mail"], 2: []}
