import hashlib
import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from topiloom.llm import bpe, line_dedup

from .support import BASE, ODD, empty_docs, odd_docs, rows_of


def plain_dedup(rows, min_docs, min_chars=1, keep="none"):
    """Line dedup by counting every line of every document."""
    seen, first = {}, {}
    for i, (doc, text) in enumerate(rows):
        for n, line in enumerate((text or "").encode().split(b"\n")):
            k = line.strip(b" \t\n\x0b\x0c\r").lower()
            if len(k.decode()) >= min_chars:
                seen.setdefault(k, set()).add(i)
                place = (2**63 if doc is None else doc, n)
                first[k] = min(first.get(k, place), place)
    out = []
    for doc, text in rows:
        lines = (text or "").encode().split(b"\n")
        left = []
        for n, line in enumerate(lines):
            k = line.strip(b" \t\n\x0b\x0c\r").lower()
            common = len(seen.get(k, ())) >= min_docs
            if not common or (keep == "first" and first[k] == (doc, n)):
                left.append(line)
        out.append((doc, b"\n".join(left).decode(), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def made_rows():
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(40)] + ["  Line 1\t", "É", "", " \r"]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]


@pytest.mark.parametrize("send", [0, 1 << 20])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_like_brute_force(spark, send, keep):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.drop_common_lines(df, min_docs=4, keep=keep, send_bytes=send)
    assert rows_of(got.select("doc_id", "text", "n_lines", "n_dropped")) == plain_dedup(rows, 4, keep=keep)


def test_lines_odd_cases(spark):
    docs = odd_docs(spark)
    got = line_dedup.drop_common_lines(docs, min_docs=2)
    assert set(got.columns) == set(docs.columns)
    want = plain_dedup(ODD, 2)
    assert sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == want
    assert got.where("doc_id = 1").first()["text"] is None
    assert line_dedup.drop_common_lines(empty_docs(spark)).count() == 0


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60_000, dtype=np.uint64)
    parts = []
    for lo, hi in ((0, 30_000), (20_000, 50_000), (50_000, 60_000)):
        f = line_dedup.Filters(1 << 20)
        f.add(h[lo:lo + 7_000])
        f.add(h[lo + 7_000:hi])
        parts.append(f)
    once, twice = parts[0].once.copy(), parts[0].twice.copy()
    for f in parts[1:]:
        twice |= f.twice | (once & f.once)
        once |= f.once
    a, b = line_dedup._places(h, 1 << 20)
    hit = line_dedup._get(twice, a) & line_dedup._get(twice, b)
    assert hit[20_000:30_000].all() and hit[50_000:].mean() < 0.2


def test_min_chars_counts_code_points(spark):
    rows = [(i, "éé\nabc") for i in range(3)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, min_chars=3)
    assert {r["text"] for r in got.collect()} == {"éé"}


def test_line_query_beside_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{BASE}/documents.parquet'")
    cur = con.execute(line_dedup.SQL)
    cols = [c[0] for c in cur.description]
    got = line_dedup.op8_line_dedup(spark, BASE)
    assert rows_of(got.select(cols)) == sorted(cur.fetchall(), key=repr)


TRICKY = [
    "", " ", "a", "don't we'll  I'M\n\n\tx", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "é" * 5000, "x" * 9000, " " * 3000, "ab " * 4000,
    "数字 ١٢٣ 🙂🙃   x \u0085y", "\x00\x01 a", "a​b ẞ ༺ ꙮ", "<|endof text|>", "1234567 89 0.5% $x_y", " leading and trailing  ",
]


def tokenizer():
    return Tokenizer.from_file(bpe.default_files()[0])


def test_pieces_give_the_encoding_of_the_whole():
    t, enc = tokenizer(), bpe.Encoder(bpe.codec(*bpe.default_files()))
    rng = random.Random(5)
    words = ["the", "of", "thnt", "éçè", "don't", "  ", "\n", "12", "x.", "🙂", "Straße", "<|endoftext|>"]
    texts = TRICKY + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3000))) for _ in range(12)]
    for text in texts * 2:
        raw = text.encode()
        parts = list(bpe.pieces(raw))
        assert b"".join(p for _, p in parts) == raw
        got = enc.text(raw)
        want = t.encode(text, add_special_tokens=False).ids
        assert b",".join(g[1] for g in got) == ",".join(map(str, want)).encode()
        assert b"".join(g[3] for g in got).decode() == t.decode(want, skip_special_tokens=False)
    assert enc.reused > enc.fresh  # the second time everything is known


def test_cuts_depend_on_content_alone():
    rng = random.Random(1)
    body = bytes(rng.randrange(97, 123) for _ in range(40_000))
    a, b = bpe.cuts(np.frombuffer(body, np.uint8)), bpe.cuts(np.frombuffer(b"shifted by this" + body, np.uint8)) - 15
    assert len(a) > 10 and set(a[a > 64]) <= set(b)


def test_bpe_odd_cases_and_round_trip(spark):
    docs = odd_docs(spark)
    got = bpe.encode(docs, with_ids=True)
    t = tokenizer()
    for r in got.select("n_tokens", "ids_sha256", "decoded_sha256", "input_ids").collect():
        assert r["n_tokens"] == len(r["input_ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["input_ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(r["input_ids"], skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(got.select("doc_id", "input_ids"))
    assert rows_of(back.select("doc_id", "text")) == sorted(((d, x or "") for d, x in ODD), key=repr)
    assert bpe.encode(empty_docs(spark)).count() == 0


def test_bpe_query_like_the_library(spark):
    from .support import table

    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False))
    t = tokenizer()
    rows = bpe.op5_bpe(spark, BASE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_wide_path_tells_null_texts_apart(spark):
    rows = [(7, None), (None, "7")] + [(i, "7\nown " + str(i)) for i in range(20, 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fast, wide = (rows_of(line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1, send_bytes=b).select("doc_id", "text", "n_dropped")) for b in (1 << 20, 0))
    assert fast == wide and (7, None, 0) in fast and (None, "", 1) in fast
