"""Near pairs, sequences and dense rows that are built inside the task."""

from collections import Counter

import numpy as np
import pytest

from topiloom.operators import cooc, sparse, vectors


def pairs_of(rows):
    return {(r["src"], r["dst"]): r["cnt"] for r in rows}


@pytest.mark.parametrize("tile,near,words,codes", [(1 << 24, 1 << 32, 500_000, 2048), (50, 100, 30, 3)])
def test_window_counts_in_blocks_and_shares(spark, monkeypatch, tile, near, words, codes):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 17, n).tolist() for n in [*rng.integers(0, 40, 40), 0, 1]] + [[3, None, 4, 3], None]
    seqs = spark.createDataFrame([(i, s) for i, s in enumerate(docs)], "doc_id bigint, seq array<int>").repartition(3)
    want = Counter()
    for s in docs:
        for p, a in enumerate(s or []):
            for b in s[p + 1:p + 5]:
                if a is not None and b is not None and a != b:
                    want[a, b] += 1
                    want[b, a] += 1
    for name, value in (("_TILE", tile), ("_NEAR", near), ("_WORDS", words), ("_CODES", codes)):
        monkeypatch.setattr(cooc, name, value)
    out = cooc.window(seqs, 4)
    assert pairs_of(out.collect()) == want and out.dtypes == [("src", "int"), ("dst", "int"), ("cnt", "bigint")]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()    # counted once, then read
    monkeypatch.setattr(cooc, "_TERMS", 3)
    assert pairs_of(cooc.window(seqs, 4).collect()) == want


def test_window_without_pairs(spark):
    for rows in ([], [(0, [])], [(0, [5, 5])], [(0, None)]):
        assert cooc.window(spark.createDataFrame(rows, "doc_id bigint, seq array<int>"), 3).count() == 0


def test_sequences_are_looked_up_in_the_row(spark):
    rows = [(1, ["b", "x", "a", "b"]), (2, ["x"]), (3, ["a", None]), (4, None), (5, ["a", "b"]), (5, ["b", "x"]), (None, ["a"]), (None, ["b", "b"]), (6, [])]
    lists = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 7)], "term string, term_id int")

    def bag(df):
        return sorted(((r["doc_id"], r["seq"]) for r in df.collect()), key=str)

    got = cooc.id_lists(lists, vocab, 10)
    assert bag(got) == bag(cooc.id_lists(lists, vocab, None)) and got.dtypes == [("doc_id", "bigint"), ("seq", "array<int>")]
    plan = cooc.id_lists(lists.where("doc_id < 4"), vocab, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


@pytest.mark.parametrize("density", [0.01, 0.5])
def test_rows_times_matrix(spark, density):
    rng = np.random.default_rng(9)
    m = np.where(rng.random((700, 90)) < density, rng.random((700, 90)), 0.0)
    sizes = (m != 0).sum(axis=1)
    ids, x = np.nonzero(m)[1], m[m != 0]
    q = rng.random((90, 5))
    assert np.allclose(sparse.times(ids, x, sizes, q), m @ q, rtol=1e-12)
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist(), [0.5, 2.0]) for r in m], "ids array<int>, cnts array<double>, dw array<double>")
    got = sparse.gram_times(rows, {0: q, 1: q[:, :3]}, 2)
    assert np.allclose(got[0], 0.5 * m.T @ (m @ q)) and np.allclose(got[1], 2 * m.T @ (m @ q[:, :3]))


def test_vectors_of_many_full_rows(spark, monkeypatch):
    """A block of rows is multiplied a few rows at a time."""
    monkeypatch.setattr(sparse, "FULL_ROWS", 3)
    rng = np.random.default_rng(4)
    m = np.abs(rng.normal(size=(20, 20)))
    m = m + m.T
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(20) for j in range(20)], "src int, dst int, value double")
    x = np.array([r["vec"] for r in vectors.svd_vectors(cells, 20, 6).orderBy("term_id").collect()])
    assert np.allclose(np.sort((x ** 2).sum(axis=0))[::-1][:3], np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-3)
