"""Work done inside the row: phrase marking, automaton, candidate counts, attention states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.operators import context, cooc, graphs, metrics, reports
from topiloom.operators import vocab as V


def joined(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_phrases_are_marked_like_a_loop(spark, monkeypatch, wide):
    rng = np.random.default_rng(1)
    lists = [[f"w{x}" for x in rng.integers(0, 6, n)] for n in [*rng.integers(1, 30, 200), 1, 2, 400]]
    pairs = {("w0", "w1"), ("w1", "w1"), ("w1", "w2"), ("w4", "w0"), ("w9", "w9")}
    if wide:
        monkeypatch.setattr(cooc, "SEND_BYTES", 0)
    docs = spark.createDataFrame(list(enumerate(lists)) + [(10_000, [])], "doc_id bigint, tokens array<string>").repartition(5)
    got = {r["doc_id"]: r["tokens"] for r in cooc.join_phrases(docs, spark.createDataFrame(sorted(pairs) * 2, "w1 string, w2 string")).collect()}
    assert got == {i: joined(t, pairs) for i, t in enumerate(lists)}


def test_shared_hashes_are_told_apart():
    """Two phrases under one hash: the words decide."""
    import pyarrow as pa

    table = pa.table({"h": pa.array([5, 5], pa.int64()), "w1": ["a", "c"], "w2": ["b", "d"]})
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([["a", "b", "c", "d"], ["a", "d", "x"]]), pa.array([[5, 5, 5], [5, 5]], pa.list_(pa.int64()))],
                                      names=["doc_id", "tokens", "h"])
    (out,) = cooc._marked(iter([rows]), table)
    assert out.column(1).to_pylist() == [["a_b", "c_d"], ["a", "d", "x"]]


def test_no_token_rows_move(spark):
    lists = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, tokens array<string>")
    plan = cooc.join_phrases(lists, spark.createDataFrame([("a", "b")], "w1 string, w2 string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_words_and_pairs_in_one_pass(spark):
    lists = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, [])], "doc_id bigint, tokens array<string>")
    uni, bi = cooc.word_and_pair_counts(lists)
    assert {tuple(r) for r in uni.collect()} == {("a", 3), ("b", 2)}
    assert {tuple(r) for r in bi.collect()} == {("a", "b", 2), ("b", "a", 1)}


def test_phrase_features_equal_contains(spark, monkeypatch):
    rng = np.random.default_rng(2)
    letters = list("abc ")
    texts = ["".join(rng.choice(letters, size=n)) for n in rng.integers(0, 300, 60)] + [None, "", "ÄB c"]
    phrases = sorted({"".join(rng.choice(letters, size=n)).strip() for n in rng.integers(2, 9, 50_000)} - {""})
    phrases += [f"x{i} y" for i in range(50_000 - len(phrases))] + ["AB", "äb C", " a ", "", None]
    assert len(phrases) >= 50_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    low = {p.lower().strip() for p in phrases if p} - {""}
    want = sorted((i, p) for i, t in enumerate(texts) if t for p in low if p in t.lower())
    assert sorted(tuple(r) for r in reports.phrase_features(docs, table).collect()) == want
    monkeypatch.setattr(reports, "AUTOMATON_CHARS", 200_000)
    assert sorted(tuple(r) for r in reports.phrase_features(docs, table).collect()) == want
    assert reports.phrase_features(docs, table.where("false")).count() == 0


@pytest.fixture(scope="module")
def id_sets():
    rng = np.random.default_rng(3)
    return [sorted(set(rng.integers(0, 40, size=n).tolist())) for n in rng.integers(0, 25, 120)]


@pytest.mark.parametrize("edge_rows,heads", [(2_000_000, 50_000), (20, 3)])
def test_edge_counts_equal_pair_counts(spark, monkeypatch, id_sets, edge_rows, heads):
    monkeypatch.setattr(cooc, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(cooc, "_HEADS", heads)
    docs = spark.createDataFrame([(r,) for r in id_sets], "ids array<int>")
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 45, (150, 2)) if a != b}
    want = {(a, b): n for a, b in edges if (n := sum(a in r and b in r for r in id_sets))}
    got = cooc.edge_counts(docs, spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert {(r["src"], r["dst"]): r["cnt"] for r in got.collect()} == want


def test_pmi_cut_equals_brute_force(spark, id_sets):
    docs = spark.createDataFrame([(r,) for r in id_sets], "ids array<int>")
    edges = [(1, 2, 3), (2, 1, 1), (1, 2, 2), (5, 9, 1), (7, 7, 4), (3, 30, 1)]
    got = {(r["src"], r["dst"]): (r["mult"], r["ppmi"]) for r in graphs.pmi_sparsify(
        spark.createDataFrame(edges, "src int, dst int, mult bigint"), docs, len(id_sets), 0).collect()}
    want = {}
    for a, b in {e[:2] for e in edges if e[0] != e[1]}:
        co, na, nb = (sum(set(x) <= set(r) for r in id_sets) for x in ((a, b), (a,), (b,)))
        if co and (v := np.log(co * len(id_sets) / (na * nb))) > 0:
            want[a, b] = (sum(m for x, y, m in edges if (x, y) == (a, b)), pytest.approx(v))
    assert got == want and want


@pytest.mark.parametrize("width", [1, 3, 10])
def test_window_cells_equal_the_whole_table(spark, monkeypatch, width):
    monkeypatch.setattr(cooc, "_HELD", 10)
    rng = np.random.default_rng(5)
    seqs = spark.createDataFrame([(i, rng.integers(0, 12, n).tolist()) for i, n in enumerate([*rng.integers(0, 40, 60), 0, 1, 2])], "doc_id bigint, seq array<int>")
    whole = {(r["src"], r["dst"]): r["cnt"] for r in cooc.window(seqs, width).collect()}
    cells, sums = cooc.window_cells(seqs, width, [2, 5, 11])
    assert {(r["src"], r["dst"]): r["cnt"] for r in cells.collect()} == {k: n for k, n in whole.items() if k[0] in (2, 5, 11)}
    rows = {}
    for (a, _), n in whole.items():
        rows[a] = rows.get(a, 0) + n
    assert {r["term_id"]: r["c"] for r in sums.collect() if r["c"]} == rows


def test_window_c_v_equals_the_table_form(spark):
    rng = np.random.default_rng(6)
    seqs = spark.createDataFrame([(i, rng.integers(0, 15, 30).tolist()) for i in range(20)], "doc_id bigint, seq array<int>")
    vocab = spark.createDataFrame([(f"t{i}", i, 1) for i in range(15)], "term string, term_id int, df bigint")
    words = spark.createDataFrame([(k, r + 1, f"t{5 * k + r}") for k in range(3) for r in range(4)], "topic int, rank int, term string")
    co = cooc.window(seqs, 5)
    marg = co.groupBy(F.col("src").alias("term_id")).agg(F.sum("cnt").cast("double").alias("c"))
    known = metrics.known_words(words, vocab, 10, None)
    want = metrics.c_v(known, marg, co.join(known.select(F.col("term_id").alias("src")).distinct(), "src", "left_semi"), float(marg.agg(F.sum("c")).first()[0]))
    assert metrics.c_v_window(words, seqs, vocab, 10, 5).first()["c_v"] == pytest.approx(want.first()["c_v"])


@pytest.mark.parametrize("cells,chunk", [(8_000_000, 50_000), (40, 7)])
def test_attention_states_merge(spark, monkeypatch, cells, chunk):
    monkeypatch.setattr(context, "STATE_CELLS", cells)
    monkeypatch.setattr(context, "_CONTEXTS", chunk)
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 6, (40, 4))
    topics = [(3, rng.normal(0, 5, 4).tolist()), (8, rng.normal(0, 5, 4).tolist())]
    pairs = sorted({(int(t), int(d)) for t, d in zip(rng.integers(0, 9, 200), rng.integers(0, 40, 200))})
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "doc_id bigint, vec array<double>")
    p = spark.createDataFrame(pairs * 2, "term_id int, doc_id bigint").repartition(6)
    got = {(r["term_id"], r["topic"]): r for r in context.attention_states(p, e, topics, 4).collect()}
    assert len(got) == 2 * len({t for t, _ in pairs})
    for (term, topic), r in got.items():
        x = vectors[[d for t, d in pairs if t == term]]
        z = x @ np.array(dict(topics)[topic])
        a = np.exp(z - z.max())
        assert r["m"] == pytest.approx(z.max()) and r["s"] == pytest.approx(a.sum()) and r["v"] == pytest.approx((a @ x).tolist())


def test_contexts_without_a_cap(spark):
    bow = spark.createDataFrame([(t, d) for t in range(3) for d in range(30)], "term_id int, doc_id bigint")
    e = spark.createDataFrame([(d, [1.0]) for d in range(25)], "doc_id bigint, vec array<double>")
    assert context.context_pairs(bow, e, None).count() == 75 and context.context_pairs(bow, e, 10).count() == 30


def test_edges_of_high_degree_are_read_from_the_pair_table(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sets = [sorted(set(rng.integers(0, 14, size=rng.integers(1, 8)).tolist())) for _ in range(50)]
    docs = spark.createDataFrame([(i, s + s[:1]) for i, s in enumerate(sets)], "doc_id bigint, ids array<int>")
    edges = [(a, b) for a in range(14) for b in range(14)]
    want = {(a, b): n for a, b in edges if (n := sum(a in s and b in s for s in sets))}
    looked = []
    monkeypatch.setattr(cooc, "_count_edges", lambda *a: looked.append(1))
    got = cooc.edge_counts(docs, spark.createDataFrame(edges, "src int, dst int"))
    assert not looked and {(r["src"], r["dst"]): r["cnt"] for r in got.collect()} == want


def test_words_are_counted_inside_the_row(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["a", None, None]), (None, ["c"])]
    lists = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    want = {(1, "a", 1), (1, "b", 2), (2, "a", 1), (5, "a", 1), (5, None, 2), (None, "c", 1)}
    counts = V.token_counts(lists)
    assert sorted(map(str, (tuple(r) for r in counts.collect()))) == sorted(map(str, want))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    twice = lists.union(spark.createDataFrame([(1, ["a"]), (None, ["c", "d"])], lists.schema))
    want = want - {(1, "a", 1), (None, "c", 1)} | {(1, "a", 2), (None, "c", 2), (None, "d", 1)}
    assert sorted(map(str, (tuple(r) for r in V.token_counts(twice).collect()))) == sorted(map(str, want))
