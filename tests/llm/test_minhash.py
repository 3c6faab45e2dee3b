import random
import re

import duckdb
import numpy as np
import pytest

from topiloom.llm import minhash

from .support import BASE, ODD, empty_docs, odd_docs, rows_of


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    """Components of all pairs by exact similarity; rows of one id are one document."""
    sets = [shingles(t) for _, t in rows]
    label = [d for d, _ in rows]
    live = [i for i in range(len(rows)) if label[i] is not None and sets[i]]
    root = {d: d for d in label if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(live):
        for j in live[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(label[i]), find(label[j])))
                root[b] = a
    out = []
    for (d, _), s in zip(rows, sets):
        c = None if d is None else find(d) if s else d
        out.append((d, len(s), c, c is None or c == d))
    return sorted(out, key=repr)


def family(rng, n, edits, words=160):
    """Copies of a text, each with some words replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_components_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    texts = family(rng, 40, 14) + family(rng, 25, 5) + [t for _ in range(12) for t in family(rng, 2, 10)] + family(rng, 15, 3, 7)
    texts += [f"{' '.join(texts[0].split()[:60])} {t}" for t in family(rng, 20, 60)] + texts[:9]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == plain(rows)
    assert any(not r[3] for r in plain(rows)) and any(r[3] for r in plain(rows))


def test_odd_cases(spark):
    rows = [*ODD, (30, "Licensed under the Apache License, Version 2.0."), (31, "another text")]
    assert rows_of(minhash.near_duplicates(odd_docs(spark, rows))) == plain(rows)
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = minhash.keep_first(odd_docs(spark, rows))
    assert kept.columns == odd_docs(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in plain(rows) if r[3]}


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b same words here now", 2), (1, "b same words here now", 1), (1, "a other text", 3), (2, None, 1), (2, None, 2), (None, "x", 1), (None, "x", 1), (3, "alone", 5)]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert rows_of(kept) == sorted([(1, "a other text", 3), (2, None, 1), (None, "x", 1), (None, "x", 1), (3, "alone", 5)], key=repr)


def test_common_counts_like_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 12000, n).astype(np.uint64)) for n in (0, 1, 40, 9000, 9000, 300)]
    assert (minhash._common(sets, sets[::-1]) == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]).all()


def test_pairs_within_the_threshold_share_a_key():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    for _ in range(60):
        a = rng.integers(0, 2**16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.THRESHOLD, replace=False)
        b[at] ^= rng.integers(1, 2**16, len(at)).astype(np.uint16)
        batch = pa.RecordBatch.from_pydict({"node": [1, 2], "sig": [a.tobytes(), b.tobytes()]})
        (out,) = minhash._keys(iter([batch]))
        keys, node = out.column("key").to_numpy(), out.column("node").to_numpy()
        common = np.intersect1d(keys[node == 1], keys[node == 2])
        assert len(common)
        # and it is taken at exactly one of them
        variant = out.column("variant").to_numpy()
        taken = 0
        for k in common:
            v = variant[(keys == k) & (node == 1)][0]
            group = pa.table({"x": [0, 0], "y": [0, 0], "side": [0, 0], "node": [1, 2], "component": [1, 2], "n_shingles": [100, 100], "sig": [a.tobytes(), b.tobytes()], "variant": [int(v)] * 2})
            taken += minhash._near(group, 75) is not None
        assert taken == 1


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(5)
    far = 0
    for _ in range(150):
        pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = np.unique(pool[:600]), np.unique(pool[100:])  # 500 of 700: a little under 0.75
        far = max(far, int((minhash.signature(a) != minhash.signature(b)).sum()))
    assert far <= minhash.THRESHOLD


def test_query_beside_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{BASE}/documents.parquet'")
    want = sorted(con.execute(minhash.SQL).fetchall(), key=repr)
    assert rows_of(minhash.op6_minhash(spark, BASE)) == want
