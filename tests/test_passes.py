"""The passes of a batched fit beside plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.operators import nmf


def counts(spark, n=60, v=40, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.4, (n, v)).astype(float)
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "doc_id bigint, ids array<int>, cnts array<double>").repartition(3)


def plain(x, w, h, kind, steps):
    mask = x > 0
    for _ in range(steps):
        if kind == "kl":
            h = h * (w.T @ (x / np.maximum(w @ h, nmf.EPS) * mask)) / (w.sum(axis=0)[:, None] + nmf.EPS)
            w = w * ((x / np.maximum(w @ h, nmf.EPS) * mask) @ h.T) / (h.sum(axis=1)[None, :] + nmf.EPS)
        else:
            h = h * (w.T @ x) / (w.T @ w @ h + nmf.EPS)
            w = w * (x @ h.T) / (w @ (h @ h.T) + nmf.EPS)
    return w, h


@pytest.mark.parametrize("here", [5_000_000, 0])
def test_models_of_a_batch_follow_plain_updates(spark, monkeypatch, here):
    """More steps than lie between two written states; models that end early keep their W; weights of 0 leave documents out."""
    monkeypatch.setattr(nmf, "DIRECT_CELLS", here)
    x, docs = counts(spark)
    rng, (n, v) = np.random.default_rng(1), x.shape
    jobs, want = [], []
    for b, (kind, steps, weight) in enumerate((("kl", 13, 1), ("frobenius", 3, 1), ("kl", 7, 0))):
        k = 2 + b
        w, h = rng.random((n, k)) + 0.1, rng.random((k, v)) + 0.1
        own = np.arange(n) if weight else np.flatnonzero(np.arange(n) % 3)
        start = spark.createDataFrame([(i, w[i].tolist()) for i in range(n)], "doc_id bigint, w array<double>")
        jobs.append(nmf.Job(k, kind, weight=None if weight else (F.col("doc_id") % 3 > 0).cast("int"), max_iter=steps, tol=0.0, start=(start, h)))
        want.append((own, *plain(x[own], w[own], h, kind, steps)))
    for fit, (own, w, h) in zip(nmf.fit_many(docs, v, jobs), want):
        scale = h.sum(axis=1)
        theta = w * scale
        got = {r["doc_id"]: r["w"] for r in fit.theta.collect()}
        assert sorted(got) == own.tolist()
        assert np.allclose([got[i] for i in own], theta / theta.sum(axis=1, keepdims=True), rtol=1e-9)
        assert np.allclose(fit.matrix(), h / scale[:, None], rtol=1e-9)


def test_a_pass_steps_once_and_sums_move_in_pieces(spark, monkeypatch):
    """No earlier step is done again: one step for each model and batch of a pass, whatever the iteration."""
    x, docs = counts(spark)
    calls = spark.sparkContext.accumulator(0)
    step = nmf._step_w

    def counted(*args):
        calls.add(1)
        return step(*args)

    monkeypatch.setattr(nmf, "_step_w", counted)
    for its in (1, 4):
        before = calls.value
        fit = nmf.fit(docs.coalesce(1), x.shape[1], 3, max_iter=its, tol=0.0)
        assert fit.n_iter == its and 0 < calls.value - before <= 2 * its


@pytest.mark.parametrize("directed", [True, False])
def test_rewiring_follows_plain_rounds(spark, directed):
    """The same swaps as a loop over the pairs of each bucket; loops, parallel edges and weights included."""
    from topiloom.functions import seeded
    from topiloom.operators import graphs

    rng = np.random.default_rng(8)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (120, 2)) if a < b or directed})
    rows = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    rows += [(rows[0][0], rows[0][1], 500)] if directed else [(b, a, i) for a, b, i in rows]
    edges = spark.createDataFrame(rows, "src int, dst int, mult int").repartition(4)
    n, rounds = len(pairs) + directed, 5
    half = edges if directed else edges.where("src < dst")
    order = graphs.Window.partitionBy("src", "dst").orderBy("mult")
    named = half.withColumn("eid", F.xxhash64("src", "dst", F.row_number().over(order)))
    drawn = named.select("eid", "src", "dst", "mult", *[F.floor(seeded.uniform(f"7:{r}", "eid") * (n // 2)).alias(f"b{r}") for r in range(rounds)]).collect()
    state = {r["eid"]: (r["src"], r["dst"]) for r in drawn}
    moved = 0
    for r in range(rounds):
        buckets, wants = {}, {}
        for x in sorted(drawn, key=lambda x: x["eid"]):
            if state[x["eid"]][0] != state[x["eid"]][1]:
                buckets.setdefault(x[f"b{r}"], []).append(x["eid"])
        there = {tuple(sorted(e)) for e in state.values()}
        for ids in buckets.values():
            for p, q in zip(ids[::2], ids[1::2]):
                (u, v), (x, y) = state[p], state[q]
                if not {u, v} & {x, y}:
                    wants[p, q] = (u, y), (x, v)
        claims = [tuple(sorted(e)) for w in wants.values() for e in w]
        for (p, q), new in wants.items():
            if all(claims.count(k) == 1 and k not in there for k in (tuple(sorted(e)) for e in new)):
                state[p], state[q] = new
                moved += 1
    want = sorted((*state[r["eid"]], r["mult"]) for r in drawn)
    got = sorted(tuple(r) for r in graphs.rewire(edges, seed=7, rounds=rounds, directed=directed).collect())
    assert got == (want if directed else sorted(want + [(b, a, m) for a, b, m in want])) and moved > 20


@pytest.mark.parametrize("bound", [10, None])
def test_directed_edges_of_a_packed_parse(spark, bound):
    """Filtered in the row, as the rows of the resolved parse; only what the rule reads leaves the parse."""
    from test_parses import bag, parses

    from topiloom.operators import deps

    packed = parses(spark)
    vocab = spark.createDataFrame([("word0", 0), ("word2", 1), ("word3", 2), ("head", 3), ("nil", 4)], "term string, term_id int")
    cols = ("src", "dst", "relation", "head", "dependent", "mult")
    for mode in deps.MODE_RELATIONS:
        got, want = deps.directed_edges(packed, vocab, bound, mode), deps.directed_edges(deps.resolve_heads(packed), vocab, bound, mode)
        assert got.columns == want.columns and bag(got, *cols) == bag(want, *cols)
    plan = deps.directed_edges(packed.dropDuplicates(["doc_id"]), vocab, bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "head_stop" not in plan
