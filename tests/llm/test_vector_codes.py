"""Codebooks and codes beside a search through all entries, and the SQL twin."""

import duckdb
import numpy as np
import pytest

from topiloom.llm import vector_codes as vc

from .support import BASE


def all_entries(query, book):
    far = ((query[:, None] - book) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize("entries,width,span", [(64, 4, 300), (64, 4, 3), (1, 4, 10), (2, 1, 2), (17, 3, 40)])
def test_search_equals_all_entries(entries, width, span):
    rng = np.random.default_rng(entries + span)
    book = rng.integers(-span, span + 1, (entries, width))
    query = np.concatenate([rng.integers(-2 * span, 2 * span + 1, (2000, width)), book])
    at, far = vc.Orchard(book).nearest(query)
    want_at, want_far = all_entries(query, book)
    assert (at == want_at).all() and (far == want_far).all()


def plain(vectors, parts, entries, rounds):
    x = np.clip(np.floor(np.array(vectors, np.float64) * 256), -vc.MOST, vc.MOST).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        at = np.stack([all_entries(x[:, p], books[p])[0] for p in range(parts)], 1)
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[at[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    error = sum(all_entries(x[:, p], books[p])[1] for p in range(parts))
    return books, at, error


def test_training_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 8)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    vectors = [[float(np.float32(v)) for v in r[1]] for r in rows]
    books, at, error = plain(vectors, 4, 10, 2)
    got = vc.train(df, parts=4, entries=10)
    assert (got == books).all()
    out = {r["vec_id"]: r for r in vc.encode(df, got).collect()}
    assert all(out[i]["code"] == bytes(at[i].tolist()).hex() and out[i]["error"] == error[i] for i in range(300))


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{BASE}/embeddings.parquet'")
    cur = con.execute(vc.SQL)
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in vc.op12_vector_codes(spark, BASE).select(cols).collect())
    assert got == want and len(got) == 500


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 16
    rows = [(1, good, 1), (1, good, 1), (2, [-x for x in good], None), (3, None, 1), (4, [None] + good[1:], 1), (5, [nan] + good[1:], 1),
            (6, [inf] + good[1:], None), (7, [0.0] * 16, None), (None, [1e30] * 16, 2), (8, good[:8], 2), (9, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "'x' AS code", "'y' AS error", "1 AS label_error", "2 AS n")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vc.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted([r["vec_id"] for r in out if r["vec_id"]]) == [1, 1, 2, 7] and len(out) == 5
    assert all(len(r["code"]) == 32 and r["error"] == 0 for r in out)
    assert len({r["codebooks_sha256"] for r in out}) == 1
    df.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vc.op12_vector_codes(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vc.train(spark.createDataFrame([(1, [1.0] * 10)], "vec_id long, embedding array<double>"))


def test_labels_share_their_error(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 32)], [None, 1, 2][i % 3]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["vec_id"]: r for r in vc.op12_vector_codes(spark, str(tmp_path)).collect()}
    for rest in range(3):
        ids = [i for i in range(200) if i % 3 == rest]
        assert {out[i]["label_error"] for i in ids} == {sum(out[i]["error"] for i in ids)}
