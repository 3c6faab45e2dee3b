"""Registered queries beside their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_twins import TABLES, rows_of

BASE = "/root/testdata/sf0.001"
SOME = ["src_blocks", "src_conllu", "src_dedup_text", "snk_corpus_hash", "txt_chunk_bow", "txt_word_tokens", "txt_ngrams", "voc_build",
        "voc_tfidf", "voc_ctfidf", "dep_triples", "gr_syntax", "gr_pmi_sparsify", "co_window", "co_documents", "co_phrases", "vec_topic",
        "nmf_kl", "nmf_graph_term", "ctx_beta", "theta_mc", "time_slices", "rep_mwe", "rep_rake", "m_cv", "m_npmi", "m_cnpmi_window",
        "m_js", "m_intra_tfidf", "m_nmi", "st_wilcoxon", "st_compare_paired"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_TWINS") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and sum(r["size"] for r in rows) > 0
