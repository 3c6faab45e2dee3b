import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.functions import seeded
from topiloom.operators import classify, context, covariates, metrics, reports, stats
from topiloom.operators import vocab as V

A = [0.351, 0.362, 0.349, 0.371, 0.355, 0.360]
B = [0.301, 0.315, 0.298, 0.322, 0.309, 0.311]


def words(spark, *topics):
    return spark.createDataFrame([(t, r + 1, w, 1.0) for t, ws in enumerate(topics) for r, w in enumerate(ws)],
                                 "topic int, rank int, term string, weight double")


def pairs(spark, a, b):
    return spark.createDataFrame([("c", float(x), float(y)) for x, y in zip(a, b)], "g string, a double, b double")


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(d, t, 1) for d, ts in enumerate([("alpha", "beta")] * 2 + [("gamma", "delta")] * 2) for t in ts]
    counts = spark.createDataFrame(rows, "doc_id bigint, term string, cnt int")
    vocab = V.build_vocab(counts, 1, 10)
    return vocab, V.doc_rows(V.bow(counts, vocab, 10))


def test_coherent_topics_beat_mixed_ones(spark, toy):
    vocab, docs = toy
    good, mixed = words(spark, ["alpha", "beta"], ["gamma", "delta"]), words(spark, ["alpha", "gamma"], ["beta", "delta"])

    def npmi(tw):
        return metrics.npmi(metrics.scored_pairs(tw, docs, vocab, 10, 10), 4).first()[0]

    assert npmi(good) == pytest.approx(1.0) and npmi(mixed) == -1.0
    # Each word has one partner here, so two words share half a direction either way.
    assert metrics.c_v_documents(good, docs, vocab).first()[0] == pytest.approx(0.5 ** 0.5)


def test_undefined_is_null(spark, toy):
    vocab, docs = toy
    lone = words(spark, ["alpha", "unknown"])
    assert metrics.npmi(metrics.scored_pairs(lone, docs, vocab, 10, 10), 4).first()[0] is None
    assert metrics.npmi_smoothed(metrics.scored_pairs(lone, docs, vocab, 10, 10), 4).first()[0] == 0.0
    empty = lone.where("1 = 0")
    assert metrics.diversity(empty).first()[0] is None and metrics.diversity(empty, 0.0).first()[0] == 0.0


def test_diversity_and_redundancy(spark):
    v = [f"w{i:02d}" for i in range(20)]
    tw = words(spark, v[0:5], v[5:10], v[10:15], v[0:3] + v[15:17])
    assert metrics.diversity(tw).first()[0] == pytest.approx(17 / 20)
    assert metrics.redundancy(tw).first()[0] == pytest.approx(3 / 7 / 6)
    assert metrics.redundancy(words(spark, v[:3])).first()[0] == 0.0


def test_exclusivity(spark):
    phi = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.1), (1, "a", 0.1), (1, "b", 0.9)], "topic int, term string, weight double")
    assert metrics.exclusivity(phi, words(spark, ["a"], ["b"]), 2).first()[0] == pytest.approx(0.9)


def test_window_coherence_uses_real_positions(spark):
    lists = spark.createDataFrame([(["a", "b", "x", "x"],), (["a", "x", "x", "b"],)], "tokens array<string>")
    from topiloom.operators import cooc

    n, windows = cooc.window_counts(lists, ["a", "b"], 2)
    assert windows == 6 and n.tolist() == [[2.0, 1.0], [1.0, 3.0]]
    assert metrics.window_coherence(words(spark, ["a_b"]), lists, 2)["c_npmi"] == pytest.approx(
        math.log((1 / 6 + 1e-12) / (2 / 6 * 3 / 6)) / -math.log(1 / 6 + 1e-12))


def test_mwes_prefer_on_topic(spark):
    triples = spark.createDataFrame([("spirito", "amod", "santo", 30), ("spirito", "amod", "santo2", 5), ("cane", "amod", "gatto", 40),
                                     ("chiesa", "nsubj", "pregare", 9)], "head string, relation string, dependent string, cnt bigint")
    tw = words(spark, ["spirito", "santo", "chiesa"])
    got = reports.mwes(tw, triples, 3).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == ["spirito santo", "spirito santo2"]
    assert (got[0]["score"], got[0]["in_topic"], got[1]["score"], got[1]["in_topic"]) == (30.0, 2, 2.5, 1)
    assert "spirito santo" in reports.labels(tw, reports.mwes(tw, triples, 3)).first()["label"]


def test_paired_statistics(spark):
    p = pairs(spark, A, B)
    assert stats.cliffs_delta(p, ["g"]).first()["cliffs_delta"] == 1.0
    d = np.array(A) - np.array(B)
    assert stats.cohens_dz(p, ["g"]).first()["cohens_dz"] == pytest.approx(d.mean() / d.std(ddof=1))
    w = stats.wilcoxon(p, ["g"]).first()
    assert w["statistic"] == 0.0 and 0.02 < w["p_value"] < 0.04 and w["note"] == ""
    exact = stats.wilcoxon(pairs(spark, [1, 2, 3, 4, 5, 6], [0.5, 1, 1.2, 1.9, 2.1, 2.3]), ["g"]).first()
    assert exact["p_value"] == pytest.approx(2 / 64)
    few = stats.wilcoxon(pairs(spark, A[:3], B[:3]), ["g"]).first()
    assert few["note"].startswith("n=3")
    flat = stats.wilcoxon(pairs(spark, A, A), ["g"]).first()
    assert flat["p_value"] == 1.0
    assert stats.cohens_dz(pairs(spark, A, A), ["g"]).first()["cohens_dz"] == 0.0


def test_cliffs_counts_ties(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 40), rng.integers(1, 6, 40)
    want = (sum(x > y for x in a for y in b) - sum(x < y for x in a for y in b)) / 1600
    assert stats.cliffs_delta(pairs(spark, a, b), ["g"]).first()[1] == pytest.approx(want)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p_raw double")
    assert {r["n"]: round(r["p_holm"], 10) for r in stats.holm(df).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_bootstrap_uses_numpy_draws(spark):
    df = spark.createDataFrame([("g", v) for v in A] + [("g", float("nan")), ("h", 1.0)], "g string, v double")
    got = {r["g"]: r for r in stats.bootstrap_draws(df, "v", ["g"], 500, seed=3).collect()}
    draws = np.random.default_rng(3).choice(np.sort(A), size=(500, 6)).mean(axis=1)
    assert (got["g"]["ci_low"], got["g"]["ci_high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])))
    assert got["h"]["ci_low"] is None and got["h"]["estimate"] == 1.0 and got["g"]["n"] == 6


def test_poisson_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("v"), F.lit("g").alias("g"))
    r = stats.bootstrap_poisson(df, "v", "id", ["g"], 100).first()
    assert r["ci_low"] < r["estimate"] < r["ci_high"] and r["ci_high"] - r["ci_low"] == pytest.approx(2 * 1.96 * 2 / 2000 ** 0.5, rel=0.3)


def test_seeded_columns_are_well_spread(spark):
    df = spark.range(5000).select(seeded.uniform(1, "id").alias("u"), seeded.poisson1(seeded.uniform(2, "id")).alias("p"),
                                  seeded.normal(3, "id").alias("z"))
    m = df.agg(F.avg("u"), F.avg("p"), F.variance("p"), F.avg("z"), F.stddev("z")).first()
    assert list(m) == pytest.approx([0.5, 1, 1, 0, 1], abs=0.06)


def test_ols_matches_closed_form(spark):
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=50), 50
    y = 0.3 * x + rng.normal(size=50) * 0.1
    theta = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(y)], "doc_id bigint, topic int, weight double")
    z = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "doc_id bigint, z double")
    r = covariates.effect_ols(theta, z).first()
    slope, icept = np.polyfit(x, y, 1)
    se = math.sqrt(((y - slope * x - icept) ** 2).sum() / (n - 2) / ((x - x.mean()) ** 2).sum())
    assert (r["coef"], r["se"]) == pytest.approx((slope, se)) and r["p"] < 1e-6
    assert covariates._t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert covariates._t_tail(0.5, 3) == pytest.approx(0.6514, abs=1e-4)


def test_effect_bootstrap_orders_interval(spark):
    theta = spark.range(200).select(F.col("id").alias("doc_id"), F.array((F.col("id") / 200.0), 1 - F.col("id") / 200.0).alias("w"))
    z = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") / 200.0).alias("x"))
    rows = covariates.effect_bootstrap(theta, z, ["x"], 2, 40).collect()
    slope = [r for r in rows if r["term"] == "x" and r["topic"] == 1][0]
    assert slope["coef"] == pytest.approx(1.0) and slope["ci_low"] <= slope["ci_high"] and slope["p"] == 0.0


def test_classifier_separates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(i % 2 + rng.normal() * 0.1), float(rng.normal())]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, vec array<double>")
    assert classify.holdout_f1(df) > 0.9
    assert classify.auc(spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, s double")) == pytest.approx(0.875)
    f = classify.folds(df, 5).groupBy("fold", "label").count().collect()
    assert len(f) == 10


def test_draws_are_made_once_a_sample(spark):
    post = spark.createDataFrame([(i, [0.1 * i, 1.0, -0.5], [-1.0, 0.5, -2.0]) for i in range(6)], "doc_id bigint, mu array<double>, logvar array<double>")
    draws = context.posterior_draws(post, 4, 3)
    assert draws._jdf.queryExecution().analyzed().toString().count("md5(") <= 6      # two a topic
    z = post.select("doc_id", *[F.array(*[F.col("mu")[k] + F.exp(F.col("logvar")[k] * 0.5) * seeded.normal(0, F.col("doc_id"), F.lit(s), F.lit(k)) for k in range(3)]).alias(f"z{s}") for s in range(1, 5)])
    want = {}
    for r in z.collect():
        p = np.array([np.exp(np.array(r[f"z{s}"]) - max(r[f"z{s}"])) for s in range(1, 5)])
        p /= p.sum(axis=1, keepdims=True)
        want |= {(r["doc_id"], k): (p[:, k].mean(), p[:, k].std(ddof=1)) for k in range(3)}
    got = {(r["doc_id"], r["topic"]): (r["mean"], r["sd"]) for r in draws.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    counts = context.regime_counts(context.uncertainty_regimes(draws, 3)).collect()
    assert sum(r["n"] for r in counts) == 6 and sum(r["share"] for r in counts) == pytest.approx(1.0)
