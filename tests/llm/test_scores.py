import numpy as np
import pytest

from topiloom.llm import language_id as li
from topiloom.llm import toxicity as tx
from topiloom.llm.flat import hash_one

from .support import BASE, ODD, empty_docs, odd_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return tx.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_disguises_are_decoded(model):
    for shown, meant in {"you m0r0n": "you moron", "p@thetic": "pathetic", "l o s e r": "loser", "d.i.s.g.u.s.t.i.n.g": "disgusting",
                         "cloooown": "clown", "tra5h": "trash", "$cum": "scum", "W O R T H L E S S": "worthless"}.items():
        assert tx.restore(shown, model).strip() == meant
    for shown, meant in {"dumba$$": "dumbas", "you stuupid": "you stupid", "l  o  s  e  r": "loser", "l - o - s - e - r": "loser",
                         "d é b i l e s": "débiles", "débiiile": "débile", "débéébile": "débébile", "m0r0n!": "moron"}.items():
        got = tx.restore(shown, model).strip()
        assert got.replace(" ", "") == meant.replace(" ", "")
    for plain in ("the price is 100", "an ordinary line, with 3 parts", "mail me at 12:30, please"):
        assert tx.restore(plain, model).split()[:2] == plain.split()[:2]


def test_viterbi_is_the_best_of_all_readings():
    rng = np.random.default_rng(2)
    lm = rng.random((tx.CLASSES,) * 3).astype(np.float32) * 4
    d = tx.Decoder(lm)
    for raw in (b"1a3", b"a.b", b"aa0", b"*x1"):
        best, todo = None, [((), 0.0)]
        for i in range(len(raw)):
            todo = [(p + ((b,) if b >= 0 else ()), c + x) for p, c in todo for b, x in d.options(raw, i, False)]
        for p, c in todo:
            z = [0, 0, *(int(tx._CLASS[b]) for b in p), 0]
            c += sum(float(lm[z[i], z[i + 1], z[i + 2]]) for i in range(len(z) - 2))
            if best is None or c < best[0]:
                best = c, bytes(p)
        assert d(raw) == best[1]


def flat_words(text):
    data = tx.LOWER[np.frombuffer(text.encode(), np.uint8)]
    return data, *tx.words(data, np.array([0, len(data)]), tx.ALNUM)


def readings(of, text, lm):
    flat, edge, rows = of(*flat_words(text), lm)
    assert len(edge) == len(rows) + 1
    return [flat[a:b].tobytes().decode() for a, b in zip(edge, edge[1:])]


def test_pairs_of_letters_read_as_in_the_lattice():
    rng = np.random.default_rng(5)
    lm = rng.random((tx.CLASSES,) * 3).astype(np.float32) * 2
    d = tx.Decoder(lm)
    for _ in range(300):
        letters = rng.choice(list("abcd"), rng.integers(1, 7))
        text = " ".join("".join(c * int(n) for c, n in zip(letters, rng.integers(1, 3, len(letters)))) for _ in range(2))
        want = [w for w in text.split() if "ccc" not in w and not any(c * 3 in w for c in "abcd")]
        want = [r for w in want if (r := d(w.encode()).decode()) != w]
        got = [r for r in readings(tx.thinned, " ".join(w for w in text.split() if not any(c * 3 in w for c in "abcd")), lm)]
        assert got == want


def test_split_words_join_where_the_lattice_says(model):
    for shown, meant in {"you stu pid man": "stupid", "stu.pid": "stupid", "you idi-ot": "idiot", "tra.sh": "trash", "st.up.id": "stupid", "s tupid": "stupid"}.items():
        assert meant in readings(tx.joined, shown, model.lm)
    assert readings(tx.joined, "stu\npid", model.lm) == readings(tx.joined, "", model.lm) == readings(tx.joined, "a", model.lm) == []
    rng = np.random.default_rng(6)
    lm = rng.random((tx.CLASSES,) * 3).astype(np.float32) * 4
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcde"), rng.integers(1, 4))) for _ in range(2))

        def cost(text):
            z = [0, 0, *(int(tx._CLASS[ord(c)]) for c in text), 0]
            return sum(float(lm[z[i], z[i + 1], z[i + 2]]) for i in range(len(z) - 2))

        assert readings(tx.joined, f"{a}.{b}", lm) == ([a + b] if cost(a + b) + tx.SPLIT_DOT < cost(f"{a} {b}") else [])


def test_disguised_words_score_like_plain_ones():
    """A lexicon of one word, and every form it may take."""
    rng = np.random.default_rng(7)
    lm = np.full((tx.CLASSES,) * 3, 6.0, np.float32)
    word = [0, 0, *(int(tx._CLASS[ord(c)]) for c in "moronic"), 0]
    for x, y, z in zip(word, word[1:], word[2:]):
        lm[x, y, z] = 0.1
    m = tx.Model(lm, np.array([hash_one("moronic")], np.uint64), np.array([0.9]), 0.0)
    forms = ["moronic", "MORONIC", "m0r0nic", "moroni(", "mooronic", "morrronic", "m o r o n i c", "m  o  r  o  n  i  c", "mor onic", "mor.onic", "mo-ro-nic", "m.o.r.o.n.i.c"]
    texts = [f"{'zq ' * int(rng.integers(0, 4))}{f} xv" for f in forms] + ["mor\nonic", "maronic", "", "mor xv onic"]
    batch = tx.pa.RecordBatch.from_pydict({"text": texts})
    got = next(tx._score(iter([batch]), m)).column(1).to_pylist()
    assert got[:len(forms)] == [pytest.approx(0.9)] * len(forms) and got[len(forms):] == [0.0] * 4


def test_language_model_counts_every_text(spark):
    docs = spark.createDataFrame([(1, "abc abc"), (2, "ABC"), (3, None)], "doc_id long, text string")
    lm = np.exp(-tx.language_model(docs))
    assert np.allclose(lm.sum(2), 1, atol=1e-3) and lm[1, 2, 3] == lm[1, 2].max()


def test_held_out_documents(spark):
    got = tx.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = held[held.toxic == 1].score.to_numpy()[:, None] > held[held.toxic == 0].score.to_numpy()
    tie = held[held.toxic == 1].score.to_numpy()[:, None] == held[held.toxic == 0].score.to_numpy()
    assert (hit + tie / 2).mean() > 0.75  # six toxic documents; a larger table gives 0.99
    assert ((held.toxic == 0) & (held.predicted == 1)).sum() <= 1
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_odd_cases(spark, model):
    docs = odd_docs(spark)
    got = tx.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    rows = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert got.count() == len(ODD) and all(0 <= s <= 1 for s in rows.values())
    assert rows[1, None] == rows[2, ""] == pytest.approx(model.rest)
    assert rows[5, dict(ODD)[5]] >= 0  # a long text is read whole
    assert tx.score(empty_docs(spark), model).count() == 0
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    nothing = tx.fit(docs, labels.where("false"))
    assert {r["score"] for r in tx.score(docs, nothing).collect()} == {0.0}
    assert tx.fit(empty_docs(spark), labels).rest == 0.0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = tx.fit(docs, labels), tx.fit(docs, turned)
    assert (a.keys == b.keys).all() and (a.precision == b.precision).all() and a.rest == b.rest


def chain_by_hand(emit, begins, start, step):
    out = []
    edges = [*np.flatnonzero(begins), len(emit)]
    pairs = np.zeros((emit.shape[1],) * 2)
    for lo, hi in zip(edges, edges[1:]):
        e = np.exp(emit[lo:hi])
        a, b = np.zeros_like(e), np.ones_like(e)
        a[0] = np.exp(start) * e[0]
        for t in range(1, len(e)):
            a[t] = a[t - 1] @ np.exp(step) * e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = np.exp(step) @ (e[t + 1] * b[t + 1])
        out.append(a * b / (a[-1].sum()))
        for t in range(len(e) - 1):
            p = a[t][:, None] * np.exp(step) * (e[t + 1] * b[t + 1])
            pairs += p / p.sum()
    return np.concatenate(out), pairs


def test_forward_backward_like_by_hand():
    rng = np.random.default_rng(8)
    for n in (1, 5, 511, 512, 513, 1700):
        emit = rng.normal(size=(n, 3))
        begins = rng.random(n) < 0.05
        begins[0] = True
        start, step = np.log(rng.dirichlet(np.ones(3))), np.log(rng.dirichlet(np.ones(3), 3))
        got, pairs = li.forward_backward(emit, begins, start, step)
        want, counted = chain_by_hand(emit, begins, start, step)
        assert np.allclose(got, want) and np.allclose(pairs, counted)


def test_languages_of_held_out_documents(spark):
    got = li.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_odd_cases_and_code_switching(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text", "lang")
    model = li.fit(docs)
    out = li.predict(odd_docs(spark), model)
    got = {(r["doc_id"], r["n_chars"]): r for r in out.collect()}
    assert out.count() == len(ODD) and "lang" in out.columns
    assert [got[i, 7]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4
    assert got[10, 7]["lang_pred"] != "und" and got[6, 7]["score"] > 0
    text = {r["lang"]: r["text"] for r in docs.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").collect()}
    mixed = text["en"] + "\n" + text["fr"]
    raw = np.frombuffer(mixed.encode(), np.uint8)
    _, marginal, _ = li._decoded(li.Slice(0, 1, raw, np.array([0, len(raw)])), model)
    first = len(text["en"].split())
    said = np.array(model.langs)[marginal.argmax(1)]
    assert (said[5:first - 20] == "en").mean() > 0.9 and (said[first + 20:] == "fr").mean() > 0.9
    none = li.fit(docs.where("false"))
    assert {r["lang_pred"] for r in li.predict(odd_docs(spark), none).collect()} == {"und"}
    assert li.predict(empty_docs(spark), model).count() == 0


def test_every_language_is_learned(spark):
    """More languages than any cap, and a rare one beside a frequent one."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    lexicon = {f"x{i:02d}": ["".join(rng.choice(letters, 6)) for _ in range(12)] for i in range(66)}
    rows = []
    for i, (lang, words) in enumerate(lexicon.items()):
        for _ in range(60 if i == 0 else 4):
            rows.append((len(rows), " ".join(rng.choice(words, 15)), lang))
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(lexicon)
    probe = [(k, " ".join(rng.choice(w, 12)), lang) for k, (lang, w) in enumerate(lexicon.items())]
    got = li.predict(spark.createDataFrame(probe, "doc_id long, text string, lang string"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 65


def test_language_gradient_returns_touched_features_only():
    import pyarrow as pa

    size = 1 << li.TABLE_BITS
    w = np.random.default_rng(1).normal(size=(size, 3)).astype(np.float32)
    batch = pa.RecordBatch.from_pydict({"word": pa.array([b"house", b"maison", b"a"], pa.binary()), "lang": pa.array([0, 2, 1], pa.int32()), "n": pa.array([4.0, 1.0, 2.0])})
    (row,) = (r for b in li._gradient(iter([batch]), w, 3.0) for r in b.to_pylist())
    at = np.frombuffer(row["at"], np.int32)
    g = np.frombuffer(row["g"], np.float32).reshape(3, len(at))
    assert 0 < len(at) < 40 and (np.diff(at) > 0).all() and np.abs(g).sum() > 0 and np.allclose(g.sum(0), 0, atol=1e-6)
