import pytest
from pyspark.sql import functions as F

from topiloom.config import TopicConfig
from topiloom.functions import text as T
from topiloom.operators import corpus, deps
from topiloom.sources import conllu, readers, store


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("bad", [
    {"num_topics": 1}, {"max_chunk_chars": 49}, {"min_df": 0}, {"graph_top_k": 0}, {"lambda_syntax": -0.1},
    {"lambda_embed": -1}, {"max_iter": 0}, {"divergence": "l1"}, {"vector_backend": "x"}, {"max_features": 0}])
def test_config_rejects(bad):
    with pytest.raises(ValueError):
        TopicConfig(**bad)


def test_chunks_keep_everything(spark):
    long = "Prima parte molto lunga. " * 4 + "Coda breve."
    segs = [r["text"] for r in corpus.segments(docs(spark, "Breve.", long, "  "), 60).orderBy("doc_id", "seg_id").collect()]
    assert segs[0] == "Breve." and segs[-1].endswith("Coda breve.")
    assert all(len(s) <= 60 for s in segs) and ".." not in " ".join(segs)
    assert " ".join(segs[1:]) == " ".join(long.split())


def test_short_documents_are_dropped_with_back_pointers(spark):
    rows = corpus.segments(docs(spark, "corta.", "una frase abbastanza lunga", "un'altra frase lunga"), 800, True).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2]


def test_sentences(spark):
    got = docs(spark, "Ciao! Come stai? Bene. Ok").select(T.sentences("text").alias("s")).first()["s"]
    assert got == ["Ciao!", "Come stai?", "Bene.", "Ok"]


def test_words_are_unicode_without_digits(spark):
    got = docs(spark, "città però più covid19 123 a x4 _privato machine").select(T.words("text").alias("w")).first()["w"]
    assert got == ["città", "però", "più", "machine"]


def test_odd_white_space_is_collapsed(spark):
    assert docs(spark, " a  b\x1fc\n").select(T.normalise_ws("text")).first()[0] == "a b c"


def test_ngrams_and_preview(spark):
    row = docs(spark, "a b c").select(T.ngrams(F.split("text", " "), 2), T.ngrams(F.split("text", " "), 4),
                                      T.preview("text", 3), T.preview("text", 5)).first()
    assert list(row) == [["a b", "b c"], [], "a b...", "a b c"]


def test_conllu_rules(spark, tmp_path):
    text = ("# newdoc\n# sent_id = 7-0\n1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tIl\til\tDET\t_\t_\t2\tdet\t_\t_\n"
            "2\tCane\t_\tNOUN\t_\t_\t0\troot\t_\t_\n2.1\tx\tx\t_\t_\t_\t_\t_\t_\t_\nshort\trow\n"
            "3\tdorme\tdormire\tVERB\t_\t_\tx\t_\t_\t_\n\n# sent_id = 7-1\n1\tAbbaia\tabbaiare\tVERB\t_\t_\t0\troot\t_\t_\n")
    (tmp_path / "a.conllu").write_text(text)
    rows = conllu.read_conllu(spark, str(tmp_path), {"il"}).orderBy("sent_id", "tok_id").collect()
    assert [(r["sent_id"], r["tok_id"], r["lemma"], r["dep"], r["head_id"], r["is_stop"]) for r in rows] == [
        (0, 1, "il", "det", 2, True), (0, 2, "cane", "root", 0, False), (0, 3, "dormire", "", 0, False),
        (1, 1, "abbaiare", "root", 0, False)]
    heads = {(r["sent_id"], r["tok_id"]): r["head_lemma"] for r in deps.resolve_heads(
        conllu.read_conllu(spark, str(tmp_path))).collect()}
    assert heads == {(0, 1): "cane", (0, 2): None, (0, 3): None, (1, 1): None}


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("uno\n\n  due \ntre")
    assert [r["text"] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).orderBy("doc_id").collect()] == ["uno", "due", "tre"]
    (tmp_path / "b.txt").write_text("a\nb\n\n\n\n c \n\nd")
    assert sorted(r["text"] for r in readers.read_blocks(spark, str(tmp_path / "b.txt")).collect()) == ["a\nb", "c", "d"]
    with pytest.raises(ValueError):
        readers.from_table(docs(spark, "x"), "body")
    with pytest.raises(ValueError):
        readers.any_case_text(spark.createDataFrame([(1,)], "zeta int"))


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('session,text\n1,"' + "a ""b"" c\nd " * 1 + " ".join(["w"] * 30) + '"\n2,"too short"\n')
    got = readers.speeches(readers.read_csv(spark, str(tmp_path / "s.csv"))).collect()
    assert len(got) == 1 and "\n" in got[0]["text"]


def test_annotations_priority(spark):
    text = " ".join(["w"] * 30)
    zero = {f"target_{t}": 0.0 for t in readers.TARGETS}
    rows = [dict(zero, comment_id=1, text=text, hate_speech_score=1.0, target_gender=1.0, target_race=0.4),
            dict(zero, comment_id=1, text=text, hate_speech_score=1.0, target_gender=0.0, target_race=0.4),
            dict(zero, comment_id=2, text=text, hate_speech_score=0.5),
            dict(zero, comment_id=3, text=text, hate_speech_score=-1.0),
            dict(zero, comment_id=4, text=text, hate_speech_score=-1.0, target_age=1.0),
            dict(zero, comment_id=5, text="short", hate_speech_score=-1.0)]
    got = {r["doc_id"]: r["label"] for r in readers.annotations(spark.createDataFrame(rows)).collect()}
    assert got == {1: 2, 2: 6, 3: 7, 4: 5}


def test_corpus_hash_sees_edits_and_order(spark):
    a, b, c = docs(spark, "x", "y", "z"), docs(spark, "x", "y", "Z"), docs(spark, "y", "x", "z")
    h = [store.corpus_hash(d).first()["digest"] for d in (a, b, c, a.repartition(3))]
    assert len(set(h[:3])) == 3 and h[0] == h[3]
    assert store.corpus_hash(a, bucket=2).first()["n_docs"] == 3


def test_parse_store_refuses_stale(spark, tmp_path):
    d = docs(spark, "x", "y")
    sig = store.signature(d, {"min_df": 5})
    path = str(tmp_path / "p")
    assert store.load_parse(spark, path, sig)[0] is None
    store.save_parse(path, {"vocab": d}, sig)
    assert store.load_parse(spark, path, sig)[0]["vocab"].count() == 2
    tables, why = store.load_parse(spark, path, store.signature(docs(spark, "x", "Y"), {"min_df": 5}))
    assert tables is None and len(why) == 1 and why[0].startswith("corpus_hash")
    with pytest.raises(ValueError):
        store.load_tables(spark, path, "model")


def test_model_store_checks_columns(spark, tmp_path):
    theta = spark.createDataFrame([(0, 0, 1.0)], "doc_id bigint, topic int, weight double")
    phi = spark.createDataFrame([(0, 5, "a", 1.0)], "topic int, term_id int, term string, weight double")
    vocab = spark.createDataFrame([("a", 0)], "term string, term_id int")
    store.save_model(str(tmp_path / "m"), theta, phi, vocab, {"k": 2})
    with pytest.raises(ValueError, match="phi has term 5"):
        store.load_model(spark, str(tmp_path / "m"))


def test_pending_runs(spark):
    grid = spark.createDataFrame([("c", "m", s, 4) for s in range(3)], "corpus string, model string, seed int, k int")
    runs = spark.createDataFrame([("c", "m", 0, 4, 0.1), ("c", "m", 1, 4, float("nan"))],
                                 "corpus string, model string, seed int, k int, npmi double")
    assert [r["seed"] for r in store.pending(grid, runs).collect()] == [2]
    assert sorted(r["seed"] for r in store.pending(grid, runs, "npmi").collect()) == [1, 2]
