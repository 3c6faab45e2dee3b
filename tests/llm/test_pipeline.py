import corpus_pipeline as cp
from topiloom.llm import bpe

from .support import BASE, odd_docs, table
from .test_line_dedup_and_bpe import plain_dedup
from .test_minhash import plain as plain_components
from .test_search_operators import contained


def test_stages_one_by_one_like_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns = docs.columns
    kept = cp.drop_toxic(spark, docs, BASE)
    assert kept.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    labels = table("labels").set_index("doc_id").toxic
    gone = set(table("documents").doc_id) - {d for d, _ in rows}
    assert all(labels.get(d, 1) == 1 for d in gone)

    lined = cp.drop_common_lines(spark, kept, BASE)
    assert lined.columns == columns
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == sorted((d, t) for d, t, _, _ in plain_dedup(rows, 10))
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect() if r["text"] != dict(rows)[r["doc_id"]])

    rows = [(r["doc_id"], r["text"]) for r in lined.collect()]
    first = cp.drop_near_duplicates(spark, lined, BASE)
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {r[0] for r in plain_components(rows) if r[3]}

    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    items = list(table("benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    clean = cp.drop_contaminated(spark, first, BASE)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {d for d, x in contained(rows, items).items() if not x}

    out = cp.tokenize(spark, clean, BASE)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out.select("doc_id", "input_ids")).collect()}
    assert back == {d: t or "" for d, t in texts.items()}


def test_stages_take_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, BASE)
        assert out.count() <= docs.count()
        assert stage(spark, docs.where("false"), BASE).count() == 0
        if stage is not cp.tokenize:
            assert out.columns == docs.columns
            assert out.where("doc_id = 8").count() == (1 if stage is not cp.drop_near_duplicates else 1)


def test_run_writes_every_stage(spark):
    out = cp.run(spark, BASE)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "input_ids"} <= set(out.columns)
    assert 0 < out.count() < len(table("documents")) and [n for n, _ in cp.STAGES][0] == "toxicity"
