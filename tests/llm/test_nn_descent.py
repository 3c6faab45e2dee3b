import numpy as np
import pytest

from topiloom.llm import nn_descent as nd

from .support import BASE, rows_of, table


def plain(rows):
    """Links of all pairs in double precision, and their components."""
    ok, unit = [], []
    for i, (_, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(0)
        if rows[i][0] is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            ok.append(i)
            unit.append(x / np.sqrt(x @ x))
    links = {i: [j for b, j in enumerate(ok) if i != j and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9] for a, i in enumerate(ok)}
    label = {i: rows[i][0] for i in ok}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in ok}
        if new == label:
            break
        label = new
    return sorted(((d, len(links.get(i, [])), label.get(i, d), d is None or label.get(i, d) == d) for i, (d, _) in enumerate(rows)), key=repr)


def made_rows(seed, crowd, dims=24):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dims) for _ in range(60)]
    centre = rng.standard_normal(dims)
    out += [centre + 0.22 * rng.standard_normal(dims) for _ in range(crowd)]
    for _ in range(25):
        a = rng.standard_normal(dims)
        out += [a, a + 0.1 * rng.standard_normal(dims)]
    out += [centre] * 7
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(out) * 2), out)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = made_rows(1, 90)
    got = nd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert rows_of(got) == plain(rows)
    assert max(r[1] for r in plain(rows)) > nd.K  # saturated lists were enlarged


def tight_groups(seed, size, dims=32):
    """Two groups of near-copies linked across, a third that only some pairs link to the second, and one that touches none."""
    rng = np.random.default_rng(seed)
    a, u, v, w = np.linalg.qr(rng.standard_normal((dims, 4)))[0].T
    away = lambda x, y, deg: np.cos(np.radians(deg)) * x + np.sin(np.radians(deg)) * y
    second = away(a, u, 21)
    centres = [a, second, away(second, v, 27.5), w]
    out = [c + 0.012 * rng.standard_normal(dims) for c in centres for _ in range(size)]
    out += [rng.standard_normal(dims) for _ in range(100)]
    return [(int(i), [float(c) for c in x]) for i, x in zip(rng.permutation(len(out) * 2), out)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_between_saturated_groups(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = tight_groups(5, 30)
    want = plain(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert rows_of(got) == want
    assert sum(59 <= r[1] < 89 for r in want) >= 30 and sum(r[1] == 29 for r in want) >= 30


def lone_pairs(seed, pairs, single, dims=32):
    """Pairs of cosine just over the limit, among vectors without links."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dims) for _ in range(single)]
    for _ in range(pairs):
        a, b = np.linalg.qr(rng.standard_normal((dims, 2)))[0].T
        out += [a, np.cos(np.radians(25)) * a + np.sin(np.radians(25)) * b]
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(out) * 2), out)]


@pytest.mark.parametrize("pairs,single,most", [(700, 100, 1), (5, 3000, 6)])
def test_lone_pairs_that_one_table_misses(spark, monkeypatch, pairs, single, most):
    monkeypatch.setattr(nd, "TABLES", 1)
    monkeypatch.setattr(nd, "MOST_BATCHES", most)
    monkeypatch.setattr(nd, "AUDIT", 256)  # rare links: no node of the first sample has one
    rows = lone_pairs(9, pairs, single)
    got = nd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert rows_of(got) == plain(rows)


def test_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1e-300, 0.0]), (11, [1e300, 0.0]), (None, [1.0, 0.0]), (12, [-1.0, 0.0]), (2, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df.selectExpr("*", "'x' AS node", "'x' AS dim", "'x' AS n_links", "'x' AS kept", "'x' AS component_id", "1 AS label")
    assert rows_of(nd.near_duplicates(wide)) == plain(rows)
    assert nd.near_duplicates(wide.where("false")).count() == 0


def test_query_like_brute_force(spark):
    rows = [(int(i), [float(c) for c in v]) for i, v in table("embeddings")[["vec_id", "embedding"]].itertuples(index=False)]
    assert rows_of(nd.op10_nn_descent(spark, BASE)) == plain(rows)
