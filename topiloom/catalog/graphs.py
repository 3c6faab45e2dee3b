"""Queries over vocabulary, dependency edges, graphs, co-occurrence and vectors (2.4 to 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import CONNECTOR_WORDS
from ..operators import cooc, corpus, deps, graphs, vectors
from ..operators import vocab as V
from ..session import cut_lineage, settle
from .base import (DIM, ENG, MAX_FEATURES, STOPS, TOPICS, query, sql, u01, wordlist)
from .texts import BIGRAMS, ascii_lists

# -- vocabulary and weights --------------------------------------------------------


@query("voc_build", sql("vocab", "SELECT term, df, tf, term_id FROM vocab"))
def voc_build(d):
    return d.vocab


@query("voc_bow", sql("bow", "SELECT doc_id, term_id, term, cnt FROM bow"))
def voc_bow(d):
    return d.bow


@query("voc_encode", sql("vocab", f"""SELECT item_id AS doc_id, term_id, term, coalesce(cnt, 0) AS cnt FROM benchmark LEFT JOIN (
  SELECT doc_id, v.term_id, v.term, count(*) AS cnt FROM (SELECT item_id AS doc_id, unnest(list_filter({wordlist('text', 3)},
    lambda z: NOT list_contains({STOPS}, z))) AS term FROM benchmark) t JOIN vocab v USING (term) GROUP BY 1, 2, 3) k ON item_id = k.doc_id"""))
def voc_encode(d):
    bench = d.table("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return V.encode(bench, corpus.word_lists(bench, T.kept_words("text", ENG)), d.vocab, MAX_FEATURES).select(
        "doc_id", "term_id", "term", "cnt")


@query("voc_doc_freq", sql("vocab", """SELECT term, df AS doc_freq, round(df / (SELECT count(*) FROM documents)::DOUBLE, 3) AS share
FROM vocab ORDER BY df DESC, term LIMIT 30""", "share"))
def voc_doc_freq(d):
    return V.common_words(d.vocab, d.n_docs, 30)


@query("voc_df_lookup", sql("counts", "SELECT term, count(*) AS df FROM counts GROUP BY 1"))
def voc_df_lookup(d):
    return V.doc_freq(d.counts)


@query("voc_norm", sql("bow", """SELECT doc_id, term_id, cnt / greatest(sum(cnt) OVER (PARTITION BY doc_id), 1)::DOUBLE AS tf,
  ln(1 + cnt::DOUBLE) AS log1p FROM bow""", "tf log1p"))
def voc_norm(d):
    tf = V.normalise(d.bow, "tf").withColumnRenamed("value", "tf")
    return V.normalise(tf, "log1p").select("doc_id", "term_id", "tf", F.col("value").alias("log1p"))


TFIDF = """tfidf AS (SELECT doc_id, term_id, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS weight FROM (
  SELECT doc_id, term_id, (ln(cnt::DOUBLE) + 1) * idf AS v FROM {bow} JOIN (SELECT term_id, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) /
    (1.0::DOUBLE + count(*))) + 1 AS idf FROM {bow} GROUP BY 1) USING (term_id)))"""


@query("voc_tfidf", sql("bow", "SELECT * FROM tfidf", "weight", extra=TFIDF.format(bow="bow")))
def voc_tfidf(d):
    return V.tfidf(d.bow, d.n_docs, MAX_FEATURES)


@query("voc_bow_doc_mask", sql("bow", "SELECT doc_id, doc_id IN (SELECT doc_id FROM bow) AS kept FROM documents"))
def voc_bow_doc_mask(d):
    return V.document_mask(d.documents, d.bow)


CTFIDF = """cls AS (SELECT topic, term, CAST(sum(cnt) AS BIGINT) AS n FROM bow JOIN dom USING (doc_id) GROUP BY 1, 2),
ctf AS (SELECT topic, term, n / greatest(sum(n) OVER (PARTITION BY topic), 1)::DOUBLE * ln(1 + 4 / (count(*) OVER (PARTITION BY term))::DOUBLE) AS weight FROM cls)"""


@query("voc_ctfidf", sql("bow dom", "SELECT topic, term, weight FROM ctf", "weight", extra=CTFIDF))
def voc_ctfidf(d):
    return V.ctfidf(d.bow, d.dominant, TOPICS)


@query("voc_pseudo_beta", sql("beta", "SELECT topic, term_id, term, weight FROM beta", "weight"))
def voc_pseudo_beta(d):
    return d.beta


# -- dependency edges --------------------------------------------------------------

@query("dep_resolve_heads", sql("res", "SELECT doc_id, sent_id, tok_id, lemma, dep, head_lemma FROM res"))
def dep_resolve_heads(d):
    return d.resolved.select("doc_id", "sent_id", "tok_id", "lemma", "dep", "head_lemma")


@query("dep_pairs", sql("pairs", "SELECT head, dependent, cnt FROM pairs"))
def dep_pairs(d):
    return deps.pairs(d.resolved)


@query("dep_triples", sql("triples", "SELECT head, relation, dependent, cnt FROM triples"))
def dep_triples(d):
    return d.triples


def _edges(mode: str, name: str) -> str:
    rels = {"filtered": "('compound','amod','nsubj','obj','nmod')",
            "full_dep": "('compound','amod','nsubj','obj','nmod','advmod')"}[mode]
    return f"""{name} AS (SELECT s.term_id AS src, t.term_id AS dst, dep AS relation, head_lemma AS head, lemma AS dependent, count(*) AS mult
  FROM res JOIN vocab s ON lemma = s.term JOIN vocab t ON head_lemma = t.term
  WHERE NOT is_stop AND is_alpha AND length(lemma) >= 3 AND NOT head_stop AND head_alpha AND head_lemma <> lemma AND dep IN {rels}
  GROUP BY 1, 2, 3, 4, 5)"""


def _directed(d, mode="filtered"):
    return deps.directed_edges(d.tokens, d.vocab, MAX_FEATURES, mode)


@query("dep_pairs_neural", sql("res vocab", "SELECT * FROM de", extra=_edges("filtered", "de")))
def dep_pairs_neural(d):
    return _directed(d)


@query("dep_relation_sets", sql("res vocab", """SELECT 'filtered' AS mode, count(*) AS n, CAST(sum(mult) AS BIGINT) AS n_edges FROM de
UNION ALL SELECT 'full_dep', count(*), CAST(sum(mult) AS BIGINT) FROM fe UNION ALL SELECT 'no_syntax', 0, 0 UNION ALL SELECT 'none', 0, 0""",
                                extra=_edges("filtered", "de") + ",\n" + _edges("full_dep", "fe")))
def dep_relation_sets(d):
    out = None
    for mode in ("none", "no_syntax", "full_dep", "filtered"):
        part = _directed(d, mode).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("mult"), F.lit(0)).alias("n_edges"))
        part = part.select(F.lit(mode).alias("mode"), "n", "n_edges")
        out = part if out is None else out.unionByName(part)
    return out


@query("dep_relation_dist", sql("res vocab", "SELECT relation, CAST(sum(mult) AS BIGINT) AS cnt FROM fe GROUP BY 1",
                                extra=_edges("full_dep", "fe")))
def dep_relation_dist(d):
    return deps.relation_counts(_directed(d, "full_dep")).orderBy(F.desc("cnt"))


@query("dep_map_vocab", sql("vpairs", "SELECT src, dst, weight FROM vpairs", "weight"))
def dep_map_vocab(d):
    return d.vpairs


@query("dep_doc_word", sql("stok vocab", """SELECT term_id, doc_id, count(*) AS n FROM stok JOIN vocab ON lemma = term
WHERE NOT is_stop AND is_alpha AND length(lemma) >= 3 GROUP BY 1, 2"""))
def dep_doc_word(d):
    edges = deps.doc_word_edges(d.tokens, d.vocab, MAX_FEATURES)
    return deps.reverse_edges(edges).groupBy("term_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


# -- graphs ------------------------------------------------------------------------

@query("gr_syntax", sql("syntax", "SELECT src, dst, weight FROM syntax", "weight"))
def gr_syntax(d):
    return d.syntax


@query("gr_degree", sql("syntax vocab", """SELECT v.term_id, coalesce(sum(weight), 0.0) AS degree FROM vocab v LEFT JOIN syntax
ON src = v.term_id GROUP BY 1""", "degree"))
def gr_degree(d):
    return graphs.degree(d.syntax, d.vocab, MAX_FEATURES)


KNN = """sims AS MATERIALIZED (SELECT a.term_id AS src, b.term_id AS dst, list_cosine_similarity(a.vec, b.vec) AS s FROM wv a JOIN wv b ON a.term_id <> b.term_id),
knn AS MATERIALIZED (SELECT src, dst, greatest(s, 0.0) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM sims) WHERE r <= 15)"""


@query("gr_knn", sql("wv", """SELECT a.src, a.dst, least(a.weight, b.weight) AS weight FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src
WHERE least(a.weight, b.weight) > 0""", "weight", extra=KNN))
def gr_knn(d):
    return graphs.knn_graph(d.word_vectors, 15)


@query("gr_pmi_sparsify", sql("res vocab bow", """SELECT src, dst, mult, ppmi FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(ppmi, 9) DESC, dst) AS r FROM (
  SELECT src, dst, mult, ln(co * (SELECT count(*) FROM documents)::DOUBLE / (ds.df * dd.df)) AS ppmi FROM (
    SELECT e.src, e.dst, mult, count(*) AS co FROM (SELECT src, dst, CAST(sum(mult) AS BIGINT) AS mult FROM de GROUP BY 1, 2) e
    JOIN bow a ON a.term_id = e.src JOIN bow b ON b.term_id = e.dst AND a.doc_id = b.doc_id GROUP BY 1, 2, 3)
  JOIN (SELECT term_id, count(*) AS df FROM bow GROUP BY 1) ds ON ds.term_id = src
  JOIN (SELECT term_id, count(*) AS df FROM bow GROUP BY 1) dd ON dd.term_id = dst) WHERE ppmi > 0) WHERE r <= 15""",
                              "ppmi", extra=_edges("filtered", "de")))
def gr_pmi_sparsify(d):
    scored = graphs.pmi_sparsify(_directed(d), d.rows, d.n_docs, 0, MAX_FEATURES)
    return graphs.top_k_edges(scored.withColumn("r9", F.round("ppmi", 9)), 15, by="r9").drop("r9")


@query("gr_control_swap", sql("syntax", """SELECT src AS term_id, count(*) AS n_edges FROM syntax GROUP BY 1"""))
def gr_control_swap(d):
    """Each word's edge count in the rewired graph, which must equal the original's."""
    control = graphs.rewire(d.syntax, seed=1)
    return control.distinct().groupBy(F.col("src").alias("term_id")).agg(F.count(F.lit(1)).alias("n_edges"))


@query("gr_control_permute", sql("syntax vocab", """SELECT a.n AS src, b.n AS dst, weight FROM syntax JOIN perm a ON src = a.term_id
JOIN perm b ON dst = b.term_id""", "weight", extra=f"""perm AS (SELECT term_id, CAST(row_number() OVER (ORDER BY {u01(1, 'term_id')}, term_id) - 1 AS INTEGER) AS n FROM vocab)"""))
def gr_control_permute(d):
    return graphs.permuted_graph(d.syntax, d.vocab, 1, MAX_FEATURES)


@query("gr_control_directed", sql("res vocab", """SELECT n.term_id, coalesce(o.n_out, 0) AS n_out, coalesce(i.n_in, 0) AS n_in FROM
  (SELECT src AS term_id FROM de UNION SELECT dst FROM de) n LEFT JOIN (SELECT src, count(*) AS n_out FROM me GROUP BY 1) o ON n.term_id = o.src
  LEFT JOIN (SELECT dst, count(*) AS n_in FROM me GROUP BY 1) i ON n.term_id = i.dst""",
                                  extra=_edges("filtered", "de") + ",\nme AS (SELECT src, dst FROM de GROUP BY 1, 2)"))
def gr_control_directed(d):
    edges = _directed(d).groupBy("src", "dst").agg(F.sum("mult").alias("mult"))
    out = cut_lineage(graphs.rewire(edges, seed=1, directed=True))
    a = out.groupBy(F.col("src").alias("term_id")).agg(F.count(F.lit(1)).alias("n_out"))
    b = out.groupBy(F.col("dst").alias("term_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return a.join(b, "term_id", "full").select("term_id", F.coalesce("n_out", F.lit(0)).alias("n_out"),
                                               F.coalesce("n_in", F.lit(0)).alias("n_in"))


@query("gr_stats", sql("res vocab syntax", f"""SELECT (SELECT count(*) FROM vocab) AS n_nodes, (SELECT count(*) // 2 FROM syntax) AS n_edges,
  n_dw, n_ww, 2 * n_dw + n_ww AS effective_edges FROM (SELECT count(*) AS n_dw FROM stok JOIN vocab ON lemma = term
  WHERE NOT is_stop AND is_alpha AND length(lemma) >= 3), (SELECT CAST(sum(mult) AS BIGINT) AS n_ww FROM de)""", extra=_edges("filtered", "de")))
def gr_stats(d):
    return graphs.graph_stats(d.vocab, d.syntax, deps.doc_word_edges(d.tokens, d.vocab, MAX_FEATURES), _directed(d))


# -- co-occurrence -----------------------------------------------------------------

SEQ = """seq AS (SELECT doc_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok JOIN vocab USING (term))"""


def _window_sql(name: str, w: int) -> str:
    return f"""{name}h AS (SELECT a.term_id AS src, b.term_id AS dst, count(*) AS n FROM seq a JOIN (SELECT unnest(range(1, {w + 1})) AS o) ON TRUE
  JOIN seq b ON a.doc_id = b.doc_id AND b.p = a.p + o WHERE a.term_id <> b.term_id GROUP BY 1, 2),
{name} AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT src, dst, n FROM {name}h UNION ALL SELECT dst, src, n FROM {name}h) GROUP BY 1, 2)"""


def sequences(d):
    return cooc.id_lists(d.lists, d.vocab, MAX_FEATURES)


@query("co_window", sql("tok vocab", "SELECT src, dst, cnt FROM cw WHERE src < dst", extra=SEQ + ",\n" + _window_sql("cw", 10)))
def co_window(d):
    return cooc.window(sequences(d), 10).where("src < dst")


PPMI_W = """wc AS (SELECT src, sum(cnt)::DOUBLE AS c FROM cw GROUP BY 1),
pw AS (SELECT src, dst, value FROM (SELECT cw.src, cw.dst, ln(cnt * (SELECT sum(c) FROM wc) / (a.c * b.c)) AS value FROM cw
  JOIN wc a ON a.src = cw.src JOIN wc b ON b.src = cw.dst) WHERE value > 0)"""


@query("co_window_ppmi", sql("tok vocab", "SELECT src, dst, value FROM pw WHERE value > 1e-9 AND src < dst", "value",
                             extra=SEQ + ",\n" + _window_sql("cw", 5) + ",\n" + PPMI_W))
def co_window_ppmi(d):
    return vectors.ppmi_cells(cooc.window(sequences(d), 5), MAX_FEATURES).where("value > 1e-9 AND src < dst")


# The cells of a whole vocabulary are tens of millions of rows, so the queries over them make
# every cell and report each term's row of the matrix.
@query("co_documents", sql("bow", """SELECT a.term_id AS src, count(DISTINCT b.term_id) AS n_cells, count(*) AS total, CAST(sum(b.term_id) AS BIGINT) AS weighted
FROM bow a JOIN bow b ON a.doc_id = b.doc_id AND a.term_id <> b.term_id GROUP BY 1"""))
def co_documents(d):
    return cooc.documents(d.rows).groupBy("src").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("cnt").alias("total"), F.sum(F.col("cnt") * F.col("dst")).alias("weighted"))


@query("co_bigrams", sql("", "SELECT w1, w2, cnt FROM abi", extra=BIGRAMS))
def co_bigrams(d):
    return cooc.bigrams(ascii_lists(d))


@query("co_pmi_bigrams", sql("", "SELECT w1, w2, cnt, pmi FROM atop", "pmi", extra=BIGRAMS))
def co_pmi_bigrams(d):
    return cooc.pmi_bigrams(ascii_lists(d), 200, 10)


CONN = "(" + ", ".join(f"'{w}'" for w in sorted(CONNECTOR_WORDS)) + ")"
PHRASES = f"""ph AS (SELECT w1, w2, b.cnt, (b.cnt - 5) * (SELECT count(*) FROM auni)::DOUBLE / (u.cnt * v.cnt) AS score FROM abi b
  JOIN auni u ON w1 = u.w JOIN auni v ON w2 = v.w WHERE b.cnt >= 5 AND w1 NOT IN {CONN} AND w2 NOT IN {CONN}
  AND (b.cnt - 5) * (SELECT count(*) FROM auni)::DOUBLE / (u.cnt * v.cnt) > 10)"""
# A run of adjacent marked pairs joins greedily from its left end: every second pair of it.
JOINED = """pt AS (SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS pos FROM alist),
pm AS (SELECT doc_id, pos, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM pt),
hit AS (SELECT pm.doc_id, pos, w, ph.w1 IS NOT NULL AS h FROM pm LEFT JOIN ph ON w = ph.w1 AND nxt = ph.w2),
run AS (SELECT *, max(CASE WHEN NOT h THEN pos ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS last_off FROM hit),
st AS (SELECT doc_id, pos, w, h AND (pos - last_off) % 2 = 1 AS starts FROM run),
jt AS (SELECT doc_id, pos, CASE WHEN starts THEN w || '_' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) ELSE w END AS term,
  coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS eaten FROM st)"""


def joined_lists(d):
    lists = ascii_lists(d)
    return cooc.join_phrases(lists, cooc.phrase_scores(lists))


@query("co_phrases", sql("", "SELECT doc_id, term, count(*) AS n FROM jt WHERE NOT eaten GROUP BY 1, 2",
                         extra=BIGRAMS + ",\n" + PHRASES + ",\n" + JOINED))
def co_phrases(d):
    return joined_lists(d).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


DCOOC = """dc AS MATERIALIZED (SELECT a.term_id AS src, b.term_id AS dst, count(*) AS cnt FROM bow a JOIN bow b
  ON a.doc_id = b.doc_id AND a.term_id <> b.term_id GROUP BY 1, 2)"""


ROW_SUMS = "count(*) AS n_cells, sum({v}) AS total, min({v}) AS low, max({v}) AS high"


def _row_sums(cells, value):
    return cells.groupBy("src").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


@query("co_npmi_matrix", sql("bow", f"""SELECT src, {ROW_SUMS.format(v='npmi')} FROM (
  SELECT dc.src, dc.dst, ln(cnt * (SELECT sum(c) FROM m) / (a.c * b.c)) / -ln(cnt / (SELECT sum(c) FROM m)) AS npmi
  FROM dc JOIN m a ON a.src = dc.src JOIN m b ON b.src = dc.dst) GROUP BY 1""", "total low high",
                             extra=DCOOC + ",\nm AS (SELECT src, sum(cnt)::DOUBLE AS c FROM dc GROUP BY 1)"))
def co_npmi_matrix(d):
    half = settle(cooc.pair_table(d.rows), "pairs")       # counted once, read for row sums and for cells
    return _row_sums(cooc.npmi_cells(cooc.mirrored(half), MAX_FEATURES), "npmi")


PPMI_D = """pd AS (SELECT dc.src, dc.dst, ln(cnt / n / ((a.df / n) * (b.df / n) + 1e-10) + 1e-10) AS ppmi FROM dc JOIN vocab a ON a.term_id = dc.src
  JOIN vocab b ON b.term_id = dc.dst, (SELECT count(*)::DOUBLE AS n FROM documents) WHERE dc.src < dc.dst)"""


@query("co_ppmi_doc", sql("bow vocab", f"SELECT src, {ROW_SUMS.format(v='ppmi')} FROM pd WHERE ppmi > 1e-7 GROUP BY 1", "total low high", extra=DCOOC + ",\n" + PPMI_D))
def co_ppmi_doc(d):
    return _row_sums(cooc.ppmi_documents(d.rows, d.vocab, d.n_docs, MAX_FEATURES).where("ppmi > 1e-7"), "ppmi")


# -- vectors -----------------------------------------------------------------------

@query("vec_ppmi_svd")
def vec_ppmi_svd(d):
    cells = vectors.ppmi_cells(cooc.window(sequences(d), 5), MAX_FEATURES)
    return vectors.svd_vectors(cells, d.n_terms).select(
        "term_id", F.size("vec").alias("dim"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("sq_norm"))


@query("vec_skipgram")
def vec_skipgram(d):
    out = vectors.skipgram_vectors(d.lists, d.triples, d.vocab)
    return out.select("term_id", "term", F.size("vec").alias("dim"), "missing")


@query("vec_missing", sql("vocab", """SELECT count(*) AS n, count(*) FILTER (WHERE vec_id IS NULL) AS n_missing FROM vocab
LEFT JOIN embeddings ON vec_id = term_id"""))
def vec_missing(d):
    emb = d.table("embeddings").select(F.col("vec_id").cast("int").alias("term_id"), F.col("embedding").alias("vec"))
    out = vectors.fill_missing(d.vocab, emb, DIM)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("missing").cast("int")).alias("n_missing"))


def _long(df, key, n=DIM):
    return df.select(*([key] if isinstance(key, str) else key), F.posexplode("vec").alias("i", "x"))


@query("vec_document", sql("bow wvx", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, coalesce(x, 0.0) AS x FROM (SELECT doc_id, i FROM documents, (SELECT unnest(range(1, 65)) AS i))
LEFT JOIN (SELECT doc_id, i, sum(cnt * x) / max(t) AS x FROM bow JOIN (SELECT doc_id, sum(cnt) AS t FROM bow GROUP BY 1) USING (doc_id)
  JOIN wvx USING (term_id) GROUP BY 1, 2) USING (doc_id, i)""", "x"))
def vec_document(d):
    return _long(vectors.document_vectors(d.documents, d.bow, d.word_vectors, DIM, MAX_FEATURES), "doc_id")


@query("vec_topic", sql("tv", "SELECT topic, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS i, unnest(vec) AS x FROM tv", "x"))
def vec_topic(d):
    return _long(d.topic_vectors, "topic")


@query("vec_topic_words", sql("words wvx", "SELECT topic, CAST(i - 1 AS INTEGER) AS i, avg(x) AS x FROM words JOIN wvx USING (term_id) GROUP BY 1, 2", "x"))
def vec_topic_words(d):
    return _long(vectors.topic_word_vectors(d.words, d.word_vectors, DIM), "topic")


@query("vec_phrase", sql("triples wvx", """SELECT head || ' ' || dependent AS phrase, relation, CAST(a.i - 1 AS INTEGER) AS i, (a.x + b.x) / 2 AS x
FROM triples JOIN wvx a ON head = a.term JOIN wvx b ON dependent = b.term AND a.i = b.i WHERE cnt >= 5""", "x"))
def vec_phrase(d):
    return _long(vectors.phrase_vectors(d.triples, d.word_vectors, MAX_FEATURES), ["phrase", "relation"])


@query("vec_project2d")
def vec_project2d(d):
    return vectors.project2d(d.topic_vectors, d.word_vectors)
