import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.functions.quantiles import exact_quantiles
from topiloom.functions import quantiles
from topiloom.operators import context, cooc, graphs, vectors
from topiloom.operators import vocab as V


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src int, dst int, weight double")


def as_dict(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


def test_syntax_graph_literal(spark):
    g = as_dict(graphs.syntax_graph(edges(spark, [(0, 1, 5), (0, 2, 3), (0, 3, 1), (1, 2, 2), (2, 3, 1)]), 2))
    assert all(g[(b, a)] == w and a != b for (a, b), w in g.items())
    deg = {}
    for a, _ in g:
        deg[a] = deg.get(a, 0) + 1
    assert max(deg.values()) <= 2
    assert g[(0, 1)] == 1.0 and g[(0, 2)] == pytest.approx(0.6)


def test_knn_literal_and_duplicates(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "term_id int, vec array<double>")
    assert set(as_dict(graphs.knn_graph(v, 1))) == {(0, 1), (1, 0)}
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "term_id int, vec array<double>")
    assert all(a != b for a, b in as_dict(graphs.knn_graph(same, 2)))


def test_knn_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)], "term_id int, vec array<double>")
    a, b = as_dict(graphs.knn_graph(v, 4)), as_dict(graphs.knn_graph(v, 4, block=13))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = np.random.default_rng(1)
    raw = edges(spark, [(a, b, 1 + rng.random()) for a, b in rng.integers(0, 200, size=(800, 2)) if a != b])
    return graphs.syntax_graph(raw, 8)


def test_rewired_graph_keeps_degrees(spark, random_graph):
    before, after = as_dict(random_graph), as_dict(graphs.rewire(random_graph, seed=3, rounds=6))

    def degrees(g):
        d = {}
        for a, _ in g:
            d[a] = d.get(a, 0) + 1
        return d

    assert len(after) == len(before) and degrees(after) == degrees(before)
    assert sorted(after.values()) == pytest.approx(sorted(before.values()))
    assert all((b, a) in after and a != b for a, b in after)
    assert len(set(before) & set(after)) / len(before) < 0.3


def test_permuted_graph_is_relabelled(spark, random_graph):
    vocab = spark.range(200).select(F.col("id").cast("int").alias("term_id"))
    out = as_dict(graphs.permuted_graph(random_graph, vocab, 1))
    assert sorted(out.values()) == sorted(as_dict(random_graph).values()) and out.keys() != as_dict(random_graph).keys()


def test_directed_rewire_leaves_loops(spark):
    e = spark.createDataFrame([(0, 0, 2), (1, 2, 1), (3, 4, 1), (5, 6, 1), (7, 8, 1)], "src int, dst int, mult int")
    out = graphs.rewire(e, seed=2, rounds=4, directed=True).collect()
    assert (0, 0, 2) in {tuple(r) for r in out}
    assert sorted(r["src"] for r in out) == [0, 1, 3, 5, 7] and sorted(r["dst"] for r in out) == [0, 2, 4, 6, 8]


def test_pair_counts_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(sorted(set(rng.integers(0, 30, size=rng.integers(1, 20)).tolist())),) for _ in range(40)]
    docs = spark.createDataFrame(rows, "ids array<int>")
    want = {}
    for (ids,) in rows:
        for i in ids:
            for j in ids:
                if i < j:
                    want[(i, j)] = want.get((i, j), 0) + 1
    assert {(r["src"], r["dst"]): r["cnt"] for r in cooc.pair_counts(docs).collect()} == want
    monkeypatch.setattr(cooc, "_CELLS", 7)
    monkeypatch.setattr(cooc, "_HELD", 11)
    left = {(r["src"], r["dst"]): r["cnt"] for r in cooc.pair_counts(docs, [3, 4]).collect()}
    assert left == {(a, b): want[(min(a, b), max(a, b))] for a in (3, 4) for b in range(30)
                    if a != b and (min(a, b), max(a, b)) in want}


def test_pair_table_counts_by_blocks_and_shares(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 5, sorted(set(rng.integers(0, 30, size=rng.integers(1, 20)).tolist()))) for i in range(40)] + [(None, [3, 4]), (7, [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    want = {(i, j): sum(i in ids and j in ids for _, ids in rows) for i in range(30) for j in range(i + 1, 30)}
    want = {k: n for k, n in want.items() if n}

    def found(df):
        got = [(r["src"], r["dst"], r["cnt"]) for r in df.collect()]
        assert len(got) == len(want)
        return {(a, b): n for a, b, n in got}

    assert found(cooc.pair_table(docs)) == want                  # one block
    monkeypatch.setattr(cooc, "_TILE", 100)                      # ten blocks of three terms
    monkeypatch.setattr(cooc, "_CELLS", 7)
    assert found(cooc.pair_table(docs)) == want
    plan = cooc.documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan                        # ids move, cells do not
    monkeypatch.setattr(cooc, "_SHARE", 50)
    assert found(cooc.pair_table(docs)) == want
    monkeypatch.setattr(cooc, "_TERMS", 10)
    assert found(cooc.pair_table(docs)) == want
    assert cooc.pair_table(docs.where("doc_id = 7")).count() == 0


def test_cells_of_npmi_and_ppmi(spark):
    rng = np.random.default_rng(12)
    sets = [sorted(set(rng.integers(0, 12, size=rng.integers(2, 8)).tolist())) for _ in range(30)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "doc_id long, ids array<int>")
    co = np.zeros((12, 12))
    for s in sets:
        co[np.ix_(s, s)] += 1
    df = co.diagonal().copy()
    np.fill_diagonal(co, 0)
    total, row = co.sum(), co.sum(axis=1)
    cells = {(r["src"], r["dst"]): r["npmi"] for r in cooc.npmi_cells(cooc.documents(docs), None).collect()}
    assert set(cells) == set(zip(*map(list, np.nonzero(co))))
    assert all(v == pytest.approx(np.log(co[k] * total / (row[k[0]] * row[k[1]])) / -np.log(co[k] / total)) for k, v in cells.items())
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(df)], "term_id int, df long")
    got = {(r["src"], r["dst"]): r["ppmi"] for r in cooc.ppmi_documents(docs, table, 30, None).collect()}
    want = {(i, j): np.log(co[i, j] / 30 / (df[i] / 30 * df[j] / 30 + 1e-10) + 1e-10) for i in range(12) for j in range(i + 1, 12) if co[i, j]}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 0}


def test_window_skips_same_word(spark):
    seqs = spark.createDataFrame([(0, [0, 1, 0, 2])], "doc_id bigint, seq array<int>")
    got = {(r["src"], r["dst"]): r["cnt"] for r in cooc.window(seqs, 2).collect()}
    assert got == {(0, 1): 2, (1, 0): 2, (0, 2): 1, (2, 0): 1, (1, 2): 1, (2, 1): 1}


def test_phrases_join_left_to_right(spark):
    lists = spark.createDataFrame([(0, ["a", "b", "c", "d", "a", "b"])], "doc_id bigint, tokens array<string>")
    ph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "w1 string, w2 string")
    assert cooc.join_phrases(lists, ph).first()["tokens"] == ["a_b", "c_d", "a_b"]


def test_unbounded_vocabulary_has_the_same_ids(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, size=rng.integers(1, 6))) for _ in range(300)]
    counts = spark.createDataFrame([(i % 20, w, 1) for i, w in enumerate(words)], "doc_id bigint, term string, cnt int") \
        .groupBy("doc_id", "term").agg(F.sum("cnt").alias("cnt"))
    a = {r["term"]: r["term_id"] for r in V.build_vocab(counts, 1, 10_000).collect()}
    b = {r["term"]: r["term_id"] for r in V.build_vocab(counts, 1, None).collect()}
    assert a == b == {w: i for i, w in enumerate(sorted(set(words)))}


def test_svd_vectors_rebuild_the_matrix(spark):
    rng = np.random.default_rng(4)
    m = np.abs(rng.normal(size=(12, 12)))
    m = m + m.T
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "src int, dst int, value double")
    out = {r["term_id"]: r["vec"] for r in vectors.svd_vectors(cells, 12, 14).collect()}
    x = np.array([out[i] for i in range(12)])
    s = np.linalg.svd(m, compute_uv=False)
    assert x.shape == (12, 14) and np.allclose(np.sort((x ** 2).sum(axis=0))[::-1][:4], s[:4], rtol=1e-3)


def test_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 10)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(300, 7.0), rng.normal(size=400), [1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    assert exact_quantiles(df, "v", probs) == pytest.approx(list(np.quantile(x, probs)))


def test_contextual_beta_matches_per_word_loop(spark):
    rng = np.random.default_rng(6)
    topics = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(3)]
    sizes = [4, 0, 1, 7, 0, 1, 5]
    stat = rng.normal(size=(7, 8))
    ctx = {w: rng.normal(size=(n, 8)) for w, n in enumerate(sizes)}
    want = np.zeros((3, 7))
    for w in range(7):
        for k, t in topics:
            t = np.array(t)
            v = stat[w]
            if sizes[w]:
                a = np.exp(ctx[w] @ t - (ctx[w] @ t).max())
                v = (a / a.sum()) @ ctx[w]
            want[k, w] = v @ t / np.linalg.norm(v) / np.linalg.norm(t)
    want = np.exp(want / 0.1 - (want / 0.1).max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    rows = [(w, 100 * w + i, [float(x) for x in v]) for w, m in ctx.items() for i, v in enumerate(m)]
    pairs = spark.createDataFrame([r[:2] for r in rows], "term_id int, doc_id bigint")
    e = spark.createDataFrame([r[1:] for r in rows], "doc_id bigint, vec array<double>")
    s = spark.createDataFrame([(w, [float(x) for x in stat[w]]) for w in range(7)], "term_id int, vec array<double>")
    got = {(r["topic"], r["term_id"]): r["weight"] for r in context.contextual_beta(topics, pairs, e, s, 8).collect()}
    assert len(got) == 21 and all(got[(k, w)] == pytest.approx(want[k, w], abs=1e-9) for k in range(3) for w in range(7))


def test_expected_words_top_k(spark):
    beta = np.array([[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]])
    theta = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_id bigint, w array<double>")
    got = {(r["doc_id"], r["rank"]): r["term_id"] for r in context.expected_words(theta, beta, 2).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (1, 1): 2, (1, 2): 1}
