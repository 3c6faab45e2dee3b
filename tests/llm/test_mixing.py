"""Targets beside resharing by hand, draws and copies, and the SQL twin."""

import duckdb
import pytest
from pyspark.sql import functions as F

from topiloom.functions.rank import numbered
from topiloom.llm import mixing, tables

from .support import BASE, empty_docs, odd_docs


def reshared(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Give out by weight, cap, and give out again what could not be taken."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in open_:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def docs_of(spark, sizes: dict, piece=5):
    rows = [(s, i, "w " * piece) for s, n in sizes.items() for i in range(n // piece)]
    return spark.createDataFrame([(1000 * k + i, s, t) for k, (s, i, t) in enumerate(rows)], "doc_id long, source string, text string")


@pytest.mark.parametrize("sizes", [
    {"a": 2000, "b": 100, "c": 50}, {"a": 10, "b": 2000, "c": 3000, None: 500}, {f"s{i:02d}": 5 * (i + 1) ** 2 for i in range(20)},
    {"é": 100, "z": 100, "Z": 100, "𐀀": 100, "￮": 100}, {"only": 100}])
def test_targets(spark, sizes):
    got = {r["source"]: r for r in mixing.source_rates(docs_of(spark, sizes)).collect()}
    want = reshared(sizes)
    for s, n in sizes.items():
        assert got[s]["source_size"] == n and got[s]["target"] == pytest.approx(want[s], rel=1e-9)
        assert got[s]["target"] <= 2 * n
    assert sum(r["target"] for r in got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_copies(spark):
    docs = docs_of(spark, {"a": 20000, "b": 30000, "c": 5000})
    planned = mixing.plan(docs)
    rows = planned.collect()
    for r in rows:
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 and r["copies"] <= 2
    for s in "abc":
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.05)
    again = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.repartition(13)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    mix = mixing.emit(planned).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert {r["doc_id"]: r["n"] for r in mix} == {d: n for d, n in again.items() if n}
    assert all(r["n"] == r["last"] for r in mix)


def test_many_sources_join_in_salted_copies(spark, monkeypatch):
    docs = docs_of(spark, {"a": 2000, None: 500, "c": 500})
    plain = sorted(map(tuple, mixing.plan(docs).collect()), key=repr)
    monkeypatch.setattr(tables, "SEND_BYTES", 0)
    assert sorted(map(tuple, mixing.plan(docs).collect()), key=repr) == plain


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.plan(docs.withColumn("source", F.when(F.col("doc_id") > 6, F.col("source"))))
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    assert all(r["size"] == len((r["text"] or "").encode().split()) for r in rows)
    assert all(r["copies"] is not None and r["source_size"] is not None for r in rows)
    assert mixing.plan(empty_docs(spark)).count() == 0 and mixing.emit(mixing.plan(empty_docs(spark))).count() == 0
    silent = mixing.plan(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r["target"], r["rate"], r["copies"]) for r in silent] == [(0.0, 0.0, 0)] * 2


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{BASE}/documents.parquet'")
    cur = con.execute(mixing.SQL)
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in mixing.op13_mixing(spark, BASE).select(cols).collect()) == want


def test_no_python_on_the_main_path(spark):
    plan = mixing.op13_mixing(spark, BASE)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbered(spark):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(97)).alias("x"), "id")
    got = numbered(df, ["x", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000))
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)
