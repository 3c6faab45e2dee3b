"""Periodic runs beside a brute-force search, and the awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from topiloom.llm import runs

from .support import BASE, empty_docs, odd_docs


def lyndon_words(c):
    out = []
    for i in range(len(c)):
        j = i + 1
        while j < len(c) and c[i:] < c[j:]:
            j += 1
        out.append(j - i)
    return out


def brute(words, least=24, times=3):
    """Every maximal stretch for every period; the smallest period of a stretch counts."""
    n = len(words)
    found = {}
    for q in range(1, n // times + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            j = i
            while same[j]:
                j += 1
            if j - i + q >= max(least, times * q):
                # a multiple of a smaller period spans the same stretch
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_row(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 6])
        c = [rng.randrange(kinds) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.5:
            c = (c[:rng.randint(1, 5)] * 20)[:len(c)]
        assert runs.lyndon_array(c, kinds) == lyndon_words(c)


def _found(texts, least, times):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    lists, found = runs.slice_runs(runs.Slice(0, len(texts), data, offsets), least, times)
    return [sorted(found.get(i, [])) for i in range(len(texts))]


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for least, times in ((24, 3), (6, 2), (9, 3), (12, 5)):
        texts = []
        for _ in range(250):
            words = []
            for _ in range(rng.randint(0, 6)):
                root = [rng.choice("abc") + rng.choice("xy") for _ in range(rng.randint(1, 9))]
                words += (root * 40)[:rng.randint(1, 60)]
                words += [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
            texts.append(" ".join(words))
        assert _found(texts, least, times) == [brute(t.split(), least, times) for t in texts]


def test_runs_inside_runs():
    inner = "a b " * 15
    text = (inner + "c ") * 4
    assert _found([text], 24, 3) == [brute(text.split())]
    assert len(_found([text], 24, 3)[0]) == 5


def test_a_wrong_hash_is_put_right(monkeypatch):
    """With a hash that calls everything equal, runs are still those of the words."""
    monkeypatch.setattr(runs, "mix", lambda x: x * np.uint64(0))
    words = ["x"] * 3 + ["p", "q"] * 15 + ["z"] + ["p", "q"] * 14
    assert _found([" ".join(words)], 24, 3) == [brute(words)]


def test_query_equals_brute_force(spark):
    rows = pq.read_table(f"{BASE}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted(digest_row(r["doc_id"], r["text"]) for r in rows if len((r["text"] or "").split()) <= 3000)
    ids = {w[0] for w in want}
    assert len(want) > 150 and sum(w[1] > 0 for w in want) > 10
    got = sorted(tuple(r) for r in runs.op11_runs(spark, BASE).collect() if r["doc_id"] in ids)
    assert got == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert out.count() == docs.count()
    for doc_id in (1, 2, 3, None):
        assert got[(doc_id, 0)]["runs"] == [] and got[(doc_id, 0)]["collapsed"] == ""
    long = got[(5, 39000)]
    assert [tuple(x) for x in long["runs"]] == [(0, 39000, 13)] and len(long["collapsed"].split()) == 13
    assert runs.periodic_runs(empty_docs(spark)).count() == 0
    kept = docs.select(runs.looped(F.col("doc_id"), F.col("text")).alias("t"), "text", "doc_id").where("doc_id IS NULL").collect()
    assert all(r["t"] == r["text"] for r in kept)
