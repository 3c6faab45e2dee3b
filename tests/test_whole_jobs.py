"""Queries that once did less than their whole job."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.operators import context


def word_vectors(spark, x):
    return spark.createDataFrame([(i, f"w{i}", [float(a) for a in r]) for i, r in enumerate(x)], "term_id int, term string, vec array<double>")


def test_kmeans_keeps_the_best_of_its_starts(spark, monkeypatch):
    """The costs of single starts differ; the kept one is the least of them and not the first."""
    class Fake:
        def __init__(self, k, seed, maxIter):
            self.seed, self.maxIter = seed, maxIter

        def fit(self, feats):
            seen.append((self.seed, self.maxIter))
            cost = {42: 5.0, 43: 3.0, 44: 1.0, 45: 1.0, 46: 4.0}[self.seed]
            return SimpleNamespace(summary=SimpleNamespace(trainingCost=cost), clusterCenters=lambda: [[self.seed, 0.0], [0.0, 2.0]])

    seen = []
    vectors = word_vectors(spark, [[1, 0], [0, 1]])
    monkeypatch.setattr(context, "KMeans", Fake)
    monkeypatch.setattr(context.vec, "unit", lambda c: F.col(c))
    got = context.kmeans_centres(vectors, 2).orderBy("topic").collect()
    assert sorted(seen) == [(s, 300) for s in range(42, 47)] and got[0]["vec"] == [44.0, 0.0]


def test_kmeans_query_gives_the_mean_best_similarity(spark):
    from topiloom.catalog import models

    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(models.K, 6) * 5, 15, axis=0) + rng.normal(0, 0.3, (15 * models.K, 6))
    out = models.kmeans_init(SimpleNamespace(word_vectors=word_vectors(spark, x))).collect()
    c = np.zeros((models.K, 6))
    for r in out:
        c[r["topic"], r["i"]] = r["x"]
    assert len(out) == models.K * 6 and np.allclose(np.linalg.norm(c, axis=1), 1.0)
    want = (x / np.linalg.norm(x, axis=1, keepdims=True) @ c.T).max(axis=1).mean()
    assert want > 0.9 and all(r["mean_best_similarity"] == pytest.approx(want) for r in out)


def test_tfidf_baseline_has_words_and_pairs(spark):
    """Beside a plain count: sublinear, smoothed, unit length; documents without a label stay out, empty ones stay in."""
    from math import log

    from topiloom.operators import classify

    texts = {1: "The cat sat, the cat ran", 2: "the cat sat", 3: "the dog sat. a cat", 4: None, 5: "zz", 6: "the cat the cat", 7: "the cat sat"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id bigint, label int")
    out = {r["doc_id"]: r for r in classify.tfidf_features(labelled, docs).collect()}

    def terms(text):
        w = [x for x in (text or "").lower().replace(",", "").replace(".", "").split() if len(x) > 1]
        return w + [" ".join(p) for p in zip(w, w[1:])]

    every = {i: terms(t) for i, t in texts.items() if i < 7}
    df = {t: sum(t in x for x in every.values()) for x in every.values() for t in x}
    known = sorted(t for t in df if df[t] >= 3)
    assert known == ["cat", "sat", "the", "the cat"] and out.keys() == every.keys()
    for i, x in every.items():
        raw = np.array([(1 + log(x.count(t))) * (log(7 / (1 + df[t])) + 1) if t in x else 0.0 for t in known])
        want = raw / (np.linalg.norm(raw) or 1.0)
        assert np.allclose(out[i]["features"].toArray(), want) and out[i]["label"] == i % 2
    assert classify.tfidf_features(labelled, docs, min_df=9) is None


def test_downstream_query_scores_the_baseline(spark, monkeypatch):
    from topiloom.catalog import scores
    from topiloom.operators import classify

    n = 40
    docs = spark.createDataFrame([(i, f"common {'good fine' if i % 2 else 'bad poor'} words", "en") for i in range(n)], "doc_id bigint, text string, lang string")
    table = {"labels": spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id bigint, quality int")}
    rng = np.random.default_rng(0)
    emb = spark.createDataFrame([(i, [float(a) for a in rng.random(3)]) for i in range(n)], "doc_id bigint, vec array<double>")
    theta = docs.select("doc_id", F.array(F.rand(1), F.rand(2)).alias("w"))
    d = SimpleNamespace(table=table.get, documents=docs, theta_rows=theta, embeddings=emb, mwes=spark.createDataFrame([("good fine",)], "phrase string"))
    got = {r["features"]: r for r in scores.m_downstream(d).collect()}
    assert set(got) == {"tfidf", "theta", "mwe", "theta+mwe", "embedding"}
    assert got["tfidf"]["f1_macro"] == 1.0 and got["tfidf"]["auc"] == 1.0
    none = classify.downstream({"tfidf": None, "one": scores._features(d)}, k=2).collect()
    assert none[0]["f1_macro"] is None and none[1]["f1_macro"] is not None


def test_skipgram_reads_words_outside_the_vocabulary(spark, monkeypatch):
    """As neighbours in documents and as ends of pairs, in the query and in a fit."""
    from topiloom.catalog import graphs as queries
    from topiloom.operators import vectors
    from topiloom.plans import fit as fits

    lists = spark.createDataFrame([(i, ["left", f"u{i % 3}", "right"] if i % 2 else ["other", f"o{i % 3}", "last"]) for i in range(20)] + [(98, None), (99, [])], "doc_id bigint, tokens array<string>")
    triples = spark.createDataFrame([("left", "amod", "rare", 1), ("rare", "obj", "rare", 2)], "head string, relation string, dependent string, cnt bigint")
    vocab = spark.createDataFrame([("left", 0), ("right", 1), ("other", 2), ("absent", 3)], "term string, term_id int")
    seen, train = [], vectors.skipgram_vectors
    monkeypatch.setattr(vectors, "skipgram_vectors", lambda a, b, c, *rest: seen.append((a, b)) or train(a, b, c, *rest))
    d = SimpleNamespace(lists=lists, triples=triples, vocab=vocab)
    out = {r["term"]: r for r in queries.vec_skipgram(d).collect()}
    assert {t: r["missing"] for t, r in out.items()} == {"left": False, "right": False, "other": False, "absent": True}
    cfg = SimpleNamespace(vector_backend="skipgram", max_features=10, vector_dim=8, vector_window=2, vector_epochs=1, seed=1)
    assert fits.word_vectors(SimpleNamespace(lists=lists, triples=triples, vocab=vocab), cfg).count() == 4
    for words, pairs in seen:
        assert {w for r in words.collect() for w in r["tokens"] or ()} == {"left", "right", "other", "last", *(f"{c}{i}" for c in "uo" for i in range(3))}
        assert pairs.count() == 2
    assert len(seen) == 2
