"""Ranks over range partitions, replicate sums, and the stream that is scored in batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.config import TopicConfig
from topiloom.functions import rank, seeded
from topiloom.functions.wordlists import STOP_WORDS
from topiloom.operators import classify, cooc, covariates, stats
from topiloom.plans import flagship
from topiloom.streaming import foldin


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else f"g{g}", int(v), float(x)) for g, v, x in zip(rng.choice([0, 0, 0, 0, 1, 2, 3], 4000), rng.permutation(4000), rng.normal(size=4000))]
    return rows, spark.createDataFrame(rows, "g string, o int, x double").repartition(7)


@pytest.mark.parametrize("how,inclusive", [("sum", False), ("max", True), ("max", False)])
def test_running_over_groups(grouped, how, inclusive):
    rows, df = grouped
    got = {(r["g"], r["o"]): r["run"] for r in rank.running(df, ["o"], F.col("x"), "run", how, ["g"], inclusive).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((o, x) for h, o, x in rows if h == g)
        x = np.array([v for _, v in own])
        if how == "sum":
            want = np.cumsum(x) - x
        else:
            top = np.maximum.accumulate(x)
            want = top if inclusive else [None, *top[:-1]]
        for (o, _), w in zip(own, want):
            assert got[g, o] == (None if w is None else pytest.approx(w, abs=1e-9))


def test_no_rank_sorts_all_rows_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.rand(1).alias("p"), "id")
    plan = rank.running(df, ["p", "id"], F.lit(1), "r")._jdf.queryExecution().executedPlan().toString()
    heavy = [line for line in plan.split("\n") if "SinglePartition" in line]
    # what passes through one task is a row for each partition
    assert all("_part" in line or "Exchange SinglePartition" in line for line in heavy)


def test_holm_and_ranks_of_one_hot_family(spark):
    rng = np.random.default_rng(2)
    p = rng.random(500) ** 3
    rows = [("a" if i % 5 else None, i, float(v)) for i, v in enumerate(p)]
    out = stats.holm(spark.createDataFrame(rows, "f string, id int, p_raw double"), family=["f"], tie=["id"]).collect()
    for f in ("a", None):
        own = sorted((v, i) for g, i, v in rows if g == f)
        run, want = 0.0, {}
        for k, (v, i) in enumerate(own):
            run = max(run, (len(own) - k) * v)
            want[i] = min(run, 1.0)
        assert {r["id"]: r["p_holm"] for r in out if r["f"] == f} == pytest.approx(want)


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert classify.auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")) == pytest.approx(want)


def test_replicate_counts_are_poisson():
    w = seeded.replicate_counts(np.random.default_rng(4).integers(0, 2**32, 4000), 200)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_replicate_sums_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(stats, "_DRAWN", 7)
    rng = np.random.default_rng(5)
    rows = [(["x", "y", None][i % 3], i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(100, 2)))]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double").repartition(4)
    base = {r["k"]: r["b32"] for r in df.select("k", seeded.base32(9, "k").alias("b32")).collect()}
    w = seeded.replicate_counts(np.array([base[i] for i in range(100)]), 12)
    got = {(r["g"], r["_b"]): r for r in stats.replicate_sums(df, "k", ["g"], ["a", "b"], 12, 9).collect()}
    assert len(got) == 3 * 13
    for g in ("x", "y", None):
        own = [r for r in rows if r[0] == g]
        for b in range(-1, 12):
            c = np.array([1.0 if b < 0 else w[r[1], b] for r in own])
            r = got[g, b]
            assert (r["_w"], r["a"], r["b"]) == pytest.approx((c.sum(), c @ [r[2] for r in own], c @ [r[3] for r in own]))


def test_large_groups_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(stats, "SMALL_GROUP", 50)
    rng = np.random.default_rng(6)
    rows = [("big", float(v)) for v in rng.normal(3, 1, 400)] + [("small", float(v)) for v in rng.normal(0, 1, 20)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in stats.bootstrap_draws(df, "v", ["g"], 300).collect()}
    x = np.array([v for g, v in rows if g == "big"])
    assert got["big"]["n"] == 400 and got["big"]["estimate"] == pytest.approx(x.mean())
    assert got["big"]["ci_high"] - got["big"]["ci_low"] == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.2)
    draws = np.random.default_rng(0).choice(np.sort([v for g, v in rows if g == "small"]), size=(300, 20), replace=True).mean(axis=1)
    assert (got["small"]["ci_low"], got["small"]["ci_high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])))
    assert got[None]["n"] == 1 and got[None]["ci_low"] is None
    with pytest.raises(ValueError):
        stats.bootstrap_draws(df, "v", ["g"], 300, statistic=np.median)


def test_effects_equal_least_squares(spark):
    rng = np.random.default_rng(7)
    z, w = rng.normal(size=60), rng.dirichlet([1, 1], 60)
    theta = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(w)], "doc_id long, w array<double>")
    cov = spark.createDataFrame([(i, float(v) if i else None) for i, v in enumerate(z)], "doc_id long, z double")
    out = {(r["topic"], r["term"]): r for r in covariates.effect_bootstrap(theta, cov, ["z"], 2).collect()}
    x = np.column_stack([np.ones(59), z[1:]])
    coef = np.linalg.lstsq(x, w[1:], rcond=None)[0]
    for t in range(2):
        r = out[t + 1, "z"]
        assert r["coef"] == pytest.approx(coef[1, t]) and r["ci_low"] < r["coef"] < r["ci_high"] and r["n_bootstrap"] == 200


def test_sparse_vectors_hold_the_counts(spark):
    docs = spark.createDataFrame([(1, [0, 3], [2.0, 5.0]), (2, [4], [1.0])], "doc_id long, ids array<int>, cnts array<double>")
    got = {r["doc_id"]: r["features"] for r in classify.sparse_vectors(docs, 5).collect()}
    assert got[1].toArray().tolist() == [2, 0, 0, 5, 0] and got[2].size == 5 and got[2][4] == 1


def test_window_counts_equal_a_loop(spark):
    rng = np.random.default_rng(8)
    lists = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in (0, 1, 3, 20, 45)]
    terms, width = ["w3", "w1", "w7", "nowhere"], 5
    want, windows = np.zeros((4, 4)), 0
    for t in lists:
        for s in range(max(1, len(t) - width + 1) if t else 0):
            windows += 1
            inside = [w in t[s:s + width] for w in terms]
            want += np.outer(inside, inside)
    got, n = cooc.window_counts(spark.createDataFrame([(t,) for t in lists], "tokens array<string>"), terms, width)
    assert n == windows and (got == want).all()


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(9)
    pools = [["alpha", "beta", "gamma", "delta"], ["rosso", "verde", "giallo", "nero"]]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(pools[i % 2], size=12)) if i else None) for i in range(24)], "doc_id bigint, text string")
    cfg = TopicConfig(num_topics=2, min_df=2, max_iter=8, lambda_syntax=0.0, lambda_embed=0.0, vector_backend="none")
    model = flagship.fit_documents(docs.where("text IS NOT NULL"), cfg)
    path, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    docs.where("doc_id < 20").repartition(4).write.parquet(path)
    how = (spark, path, model.parsed.vocab, model.result.matrix(), STOP_WORDS["eng"], out, 1)
    first = foldin.fold_in_stream(*how)
    assert first.count() == 20 and first.select("batch").distinct().count() >= 4
    # an interrupted attempt at the next batch leaves rows behind; the batch replaces them
    last = first.agg(F.max("batch")).first()[0]
    docs.limit(3).select("doc_id", F.array(F.lit(9.0), F.lit(9.0)).alias("w")).write.parquet(f"{out}/rows/batch={last + 1}")
    docs.where("doc_id >= 20").coalesce(1).write.mode("append").parquet(path)
    got = {r["doc_id"]: r["w"] for r in foldin.fold_in_stream(*how).collect()}
    want = {r["doc_id"]: r["w"] for r in foldin.score_stream(docs, model.parsed.vocab, model.result.matrix(), STOP_WORDS["eng"]).collect()}
    assert got.keys() == want.keys() == set(range(24)) and all(np.allclose(got[i], want[i], atol=1e-9) for i in got)
    assert got[0] == [0.0, 0.0] and foldin.fold_in_stream(*how).count() == 24
