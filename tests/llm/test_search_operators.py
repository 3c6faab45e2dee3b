import random
import re

import numpy as np
import pytest

from topiloom.llm import decontaminate as dc
from topiloom.llm import licences as lc
from topiloom.llm.flat import Slice

from .support import BASE, ODD, empty_docs, odd_docs, table


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_answer(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for p, label in lc.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences_like_brute_force_on_odd_cases(spark):
    rows = [*ODD, (20, "Apache-License MIT\nlicense CC-BY cc  by, ccby"), (21, "gnu general public"), (22, "license"), (23, "été MIT License été" * 3)]
    got = lc.scan(odd_docs(spark, rows))
    have = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got.collect()), key=repr)
    assert have == sorted(((d, *base_answer(t)) for d, t in rows), key=repr)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert lc.scan(empty_docs(spark)).count() == 0


def test_templates_are_found_whole_changed_and_not_in_pieces(spark):
    rows, want = [], {}
    for i, (label, notice, _) in enumerate(lc.TEMPLATES):
        rows.append((i, f"some words before, {notice.upper()}; and after"))
        want[i] = label
    words = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    rows += [(100, " ".join(w if i % 9 else "foo" for i, w in enumerate(words, 1))), (101, " ".join(words[:6])), (102, " ".join(reversed(words))), (103, " x ".join(words))]
    got = {r["doc_id"]: r["labels"].split(",") for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in want.items())
    assert "bsd-2-clause" in got[100] and not any("bsd-2-clause" in got[i] for i in (101, 102, 103))


def test_licence_query_like_brute_force(spark):
    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False))
    for r in lc.op7_licences(spark, BASE).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_answer(texts[r["doc_id"]])


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def contained(docs, items, share=0.6):
    """Ids of the items of which a document has most 5-word shingles."""
    grams = {i: {tuple(tokens(x)[j:j + 5]) for j in range(max(1, len(tokens(x)) - 4))} for i, x in items if tokens(x)}
    out = {}
    for d, text in docs:
        w = tokens(text)
        mine = {tuple(w[j:j + n]) for n in range(1, 6) for j in range(max(0, len(w) - n + 1))}
        out[d] = sorted(i for i, g in grams.items() if len(g & mine) >= share * len(g))
    return out


def test_index_retrieves_all_passages_above_the_threshold():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = dc.Items([(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 180)))) for i in range(60)])
    df = np.array([rng.randrange(1, 900) for _ in items.terms], float)
    index = dc.Index(items, df, 1000)
    text = " ".join(rng.choice(vocab + ["other"] * 200) for _ in range(2500))
    raw = np.frombuffer(text.encode(), np.uint8)
    h, rows = dc.word_hashes(Slice(0, 1, raw, np.array([0, len(raw)])))
    got = {(s, lo // dc.SEGMENT) for s, lo, _ in index.hits(h, rows)}
    at, t = index.lookup(h)
    want = set()
    for p in range(len(h) // dc.SEGMENT + 1):
        mine = np.unique(t[(at // dc.SEGMENT == p) | (at // dc.SEGMENT == p + 1)])
        if not (at // dc.SEGMENT == p).any():
            continue
        for terms, impact, base in index.blocks:
            score = impact[np.isin(terms, mine)].sum(0)
            want |= {(base + j, p) for j in np.flatnonzero(score >= 1).tolist()}
    assert want and want <= got


def test_decontamination_on_planted_items(spark):
    bench = table("benchmark")
    items = list(bench[["item_id", "text"]].itertuples(index=False, name=None))
    rng = random.Random(4)
    filler = [w for t in table("documents")["text"].dropna()[:40] for w in t.split()]
    rows = []
    for i, (_, text) in enumerate(items[:20]):
        w = text.split()
        pad = lambda n: " ".join(rng.choice(filler) for _ in range(n))
        rows += [(i * 4, f"{pad(300)} {text.upper() if i % 2 else text} {pad(90)}"), (i * 4 + 1, f"{pad(100)} {' '.join(w[:len(w) // 3])} {pad(50)}"), (i * 4 + 2, pad(400)), (i * 4 + 3, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["items"]) for r in dc.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == contained(rows, items)


@pytest.mark.parametrize("words", [dc.SHARD_WORDS, 150])
def test_decontamination_query_like_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(dc, "SHARD_WORDS", words)
    docs = list(table("documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    items = list(table("benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    got = {r["doc_id"]: list(r["items"]) for r in dc.op3_decontamination(spark, BASE).collect()}
    assert got == contained(docs, items)


def test_decontamination_odd_cases(spark):
    bench = spark.createDataFrame([(1, "another text"), (2, None), (3, ""), (None, "one"), (4, "a b c d e f g h i j"), (4, "one"), (5, "x " * 200)], "item_id long, text string")
    out = dc.matches(odd_docs(spark), bench).collect()
    assert len(out) == len(ODD)
    found = {(r["doc_id"], r["text"]): list(r["items"]) for r in out}
    assert found[4, "another text"] == [1] and found[8, "a b c d e f g h i j"] == [4] and found[6, "one"] == [4] and found[1, None] == []
    assert dc.matches(empty_docs(spark), bench).count() == 0
    assert all(not r["items"] for r in dc.matches(odd_docs(spark), bench.where("false")).collect())
