"""Queries over sources, table state and text preparation (inventory 2.1 to 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import EXTRA_STOP_WORDS, STOP_WORDS
from ..operators import cooc, corpus, metrics, reports, stats
from ..operators import vocab as V
from ..operators.context import collect_contexts
from ..session import stage_path
from ..sources import conllu, readers, store
from .base import (CTES, DIM, ENG, MAX_FEATURES, SP, STOPS, TOPICS, query, sql, stripped,
                   u01, wordlist, ws)

CLEAN = f"clean AS (SELECT doc_id, {ws('text')} AS t, lang, source, n_chars FROM documents)"


def _count(tokens) -> object:
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# -- sources -----------------------------------------------------------------------

@query("src_lines", f"""SELECT t AS text FROM (SELECT {stripped('l')} AS t FROM (
  SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS l FROM documents)) WHERE t <> ''""")
def src_lines(d):
    path = stage_path(d.spark, "lines")
    d.documents.select("text").write.text(path)
    return readers.read_lines(d.spark, path).select("text")


@query("src_blocks", f"SELECT t AS text FROM (SELECT {ws('text')} AS t FROM documents) WHERE t <> ''")
def src_blocks(d):
    path = stage_path(d.spark, "blocks")
    d.documents.select(T.normalise_ws("text").alias("text")).where("text <> ''").write.option(
        "lineSep", "\n\n").text(path)
    return readers.read_blocks(d.spark, path).select("text")


@query("src_folder", f"SELECT {stripped('text')} AS text, count(*) AS n FROM benchmark GROUP BY 1")
def src_folder(d):
    path = stage_path(d.spark, "folder")
    d.table("benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return readers.read_folder(d.spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("src_table", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def src_table(d):
    return readers.from_table(d.table("documents"), "text", "doc_id")


@query("src_list", """SELECT row_number() OVER (ORDER BY source) - 1 AS doc_id, source AS text
FROM (SELECT DISTINCT source FROM documents)""")
def src_list(d):
    names = sorted(r[0] for r in d.table("documents").select("source").distinct().collect())
    return readers.from_list(d.spark, names)


@query("src_conllu", sql("stok", "SELECT * FROM stok"))
def src_conllu(d):
    path = stage_path(d.spark, "conllu")
    sents = d.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_id", "s")).select(
        "doc_id", "sent_id", F.regexp_extract_all(F.lower("s"), F.lit(T.WORD_RUN), F.lit(1)).alias("w"))
    rels = F.array(*[F.lit(r) for r in ("compound", "amod", "nsubj", "obj", "nmod", "advmod")])

    def line(w, i):
        dep = F.when(i == 0, "root").otherwise(F.element_at(rels, F.length(w) % 6 + 1))
        return F.concat_ws("\t", (i + 1).cast("string"), w, F.lit("_"), F.lit("X"), F.lit("_"), F.lit("_"),
                           i.cast("string"), dep, F.lit("_"), F.lit("_"))

    head = F.concat(F.lit("# sent_id = "), F.concat_ws("-", "doc_id", "sent_id"))
    block = F.concat_ws("\n", head, F.lit("1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_"),
                        F.array_join(F.transform("w", line), "\n"))
    sents.where(F.size("w") > 0).select(block.alias("value")).write.option("lineSep", "\n\n").text(path)
    return conllu.read_conllu(d.spark, path, ENG)


@query("src_csv_speech", sql("", "SELECT t AS text FROM clean WHERE t <> '' AND len(string_split(t, ' ')) >= 20",
                             extra=CLEAN))
def src_csv_speech(d):
    path = stage_path(d.spark, "speech")
    d.documents.select(F.col("doc_id").alias("session"), F.col("lang").alias("country"),
                       T.normalise_ws("text").alias("Speech")).write.csv(
        path, header=True, escape='"', quoteAll=True)
    return readers.speeches(readers.read_csv(d.spark, path)).select("text")


@query("src_csv_posts", f"""WITH c AS (SELECT role, {ws('text')} AS t, turn FROM conversations),
p AS (SELECT CASE WHEN turn % 3 <> 0 AND t <> '' AND lower(t) <> 'nan' THEN role || ' ' || t ELSE role END AS text,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS label FROM c)
SELECT text, label FROM p WHERE len(string_split(text, ' ')) >= 5""")
def src_csv_posts(d):
    path = stage_path(d.spark, "posts")
    d.table("conversations").select(
        F.col("role").alias("Title"), F.when(F.col("turn") % 3 != 0, T.normalise_ws("text")).alias("Text"),
        F.col("role").alias("Political Lean")).write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.posts(readers.read_csv(d.spark, path), {"user": 0, "assistant": 1})


@query("src_csv_anycase", f"SELECT doc_id, t AS text FROM (SELECT doc_id, {stripped('text')} AS t FROM documents) WHERE t <> ''")
def src_csv_anycase(d):
    return readers.any_case_text(d.documents.select("doc_id", F.col("text").alias(" Body ")))


@query("src_jsonl_debates", sql("", f"""SELECT doc_id, text FROM (SELECT doc_id, text, {u01(7, 'doc_id')} AS u FROM documents
  WHERE lang IN ('en', 'fr') AND n_chars % 3 <> 0 AND {ws('text')} <> '' AND len(string_split({ws('text')}, ' ')) >= 30)
ORDER BY u, doc_id LIMIT 100"""))
def src_jsonl_debates(d):
    path = stage_path(d.spark, "debates")
    d.documents.select(
        "doc_id", "text", F.when(F.col("lang").isin("en", "fr"), "MEP").otherwise("Chair").alias("speaker_role"),
        F.when(F.col("n_chars") % 3 == 0, "x").when(F.col("n_chars") % 3 == 1, " ").alias("translated_text")
    ).write.json(path)
    table = d.spark.read.schema(
        "doc_id bigint, text string, speaker_role string, translated_text string").json(path)
    return readers.debates(table, 100, seed=7)


@query("src_annotations", sql("", f"""SELECT doc_id, text, CASE WHEN t0 >= 0.5 THEN 0 WHEN t1 >= 0.5 THEN 1 WHEN t2 >= 0.5 THEN 2
  WHEN t3 >= 0.5 THEN 3 WHEN t4 >= 0.5 THEN 4 WHEN greatest(t5, t6) >= 0.5 THEN 5 WHEN score > 0 THEN 6 ELSE 7 END AS label, score
FROM (SELECT doc_id, min(text) AS text, {', '.join(f'avg(CASE WHEN (doc_id * 31 + a * 17 + {t} * 7) % 5 < 2 THEN 1.0 ELSE 0.0 END) AS t{t}' for t in range(7))},
  avg(((doc_id * 13 + a * 7) % 21 - 10) / 5.0) AS score FROM documents, (SELECT unnest([0, 1, 2]) AS a) GROUP BY doc_id)
WHERE {ws('text')} <> '' AND len(string_split({ws('text')}, ' ')) >= 30""", "score"))
def src_annotations(d):
    rows = d.documents.select("doc_id", "text", F.explode(F.array(*[F.lit(a) for a in range(3)])).alias("a"))
    for t, name in enumerate(readers.TARGETS):
        rows = rows.withColumn(f"target_{name}", F.when(
            (F.col("doc_id") * 31 + F.col("a") * 17 + t * 7) % 5 < 2, 1.0).otherwise(0.0))
    rows = rows.withColumn("hate_speech_score", ((F.col("doc_id") * 13 + F.col("a") * 7) % 21 - 10) / 5.0)
    return readers.annotations(rows.withColumnRenamed("doc_id", "comment_id"), order="a")


@query("src_dedup_text", """SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text""")
def src_dedup_text(d):
    return readers.dedup_text(d.documents)


@query("src_pipe_cells", sql("words", "SELECT topic + 1 AS topic_id, term AS item FROM words"))
def src_pipe_cells(d):
    cells = store.word_cells(d.words, d.mwes).withColumn("model", F.lit("nmf")).withColumn("k", F.lit(TOPICS))
    return readers.pipe_cells(cells, "keywords", "nmf", TOPICS).select("topic_id", "item")


MAIN = """agg AS (SELECT corpus, model, k, round(avg(npmi), 4) AS npmi_mean, round(stddev_samp(npmi), 4) AS npmi_std FROM runs GROUP BY 1, 2, 3),
main AS (SELECT corpus, model, k, npmi_mean, npmi_std FROM (SELECT *, row_number() OVER (PARTITION BY corpus, model
  ORDER BY CASE WHEN corpus = 'O' AND k = 20 THEN 0 ELSE 1 END, npmi_mean IS NULL, npmi_mean DESC, k) AS r FROM agg) WHERE r = 1)"""


def _main(d):
    return stats.main_table(stats.mean_std(d.runs, ["npmi"]), "O", 20, "npmi_mean")


@query("src_best_k", sql("runs", "SELECT corpus, model, k FROM main WHERE corpus = 'F'", extra=MAIN))
def src_best_k(d):
    wanted = d.runs.where(F.col("corpus") == "F").select("corpus", "model").distinct()
    return readers.best_k(wanted, _main(d))


@query("src_embeddings", sql("demb", "SELECT doc_id, CAST(len(vec) AS INTEGER) AS n, list_sum(vec) AS s FROM demb", "s"))
def src_embeddings(d):
    from ..functions import vec

    return readers.embeddings(d.table("embeddings")).select(
        "doc_id", F.size("vec").alias("n"), vec.total("vec").alias("s"))


@query("src_sample_class", sql("", f"""SELECT doc_id, quality AS label FROM (SELECT doc_id, quality, row_number() OVER (
  PARTITION BY quality ORDER BY {u01(3, 'doc_id')}, doc_id) AS r FROM labels JOIN documents USING (doc_id)) WHERE r <= 50"""))
def src_sample_class(d):
    rows = d.table("labels").select("doc_id", F.col("quality").alias("label")).join(
        d.documents.select("doc_id"), "doc_id")
    return readers.sample_per_class(rows, 50, seed=3)


@query("src_label_filter", "SELECT label, count(*) AS n FROM embeddings WHERE label < 6 GROUP BY 1")
def src_label_filter(d):
    return readers.label_counts(readers.filter_labels(d.table("embeddings"), 6))


@query("src_preflight", " UNION ALL ".join(
    f"SELECT '{t}' AS corpus, count(*) AS n, count(*) > 0 AS ok FROM {t}"
    for t in ("documents", "conversations", "benchmark", "pages")))
def src_preflight(d):
    return readers.preflight({t: d.table(t) for t in ("documents", "conversations", "benchmark", "pages")})


# -- sinks and table state ---------------------------------------------------------

def _hash_sql(name: str, src: str) -> str:
    return f"""{name} AS (SELECT CAST(sum(n) AS BIGINT) AS n_docs, sha1(string_agg(h, '|' ORDER BY b)) AS digest FROM (
  SELECT b, sha1(string_agg(h, '|' ORDER BY i)) AS h, count(*) AS n FROM (
    SELECT doc_id // 1000 AS b, doc_id AS i, sha1(coalesce(text, '')) AS h FROM {src}) GROUP BY b))"""


BENCH_DOCS = "bdocs AS (SELECT item_id AS doc_id, text FROM benchmark)"


@query("snk_corpus_hash", sql("", "SELECT * FROM h", extra=_hash_sql("h", "documents")))
def snk_corpus_hash(d):
    return store.corpus_hash(d.documents)


@query("snk_signature", sql("", """SELECT 'corpus_hash' AS key, digest AS value FROM h
UNION ALL SELECT 'max_features', '15000' UNION ALL SELECT 'min_df', '5' UNION ALL SELECT 'relations', '["amod", "nsubj"]'""",
                            extra=_hash_sql("h", "documents")))
def snk_signature(d):
    return store.signature(d.documents, {"min_df": 5, "max_features": 15000, "relations": {"nsubj", "amod"}})


@query("snk_sig_diff", sql("", """SELECT 'corpus_hash' AS key, h.digest AS old, g.digest AS new FROM h, g
UNION ALL SELECT 'min_df', '5', '2' UNION ALL SELECT 'tol', NULL, '0.1'""",
                           extra=",\n".join([_hash_sql("h", "documents"), BENCH_DOCS, _hash_sql("g", "bdocs")])))
def snk_sig_diff(d):
    bench = d.table("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return store.signature_diff(store.signature(d.documents, {"min_df": 5, "k": 4}),
                                store.signature(bench, {"min_df": 2, "k": 4, "tol": 0.1}))


def _sizes(d, tables):
    out = None
    for name in sorted(tables):
        part = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_parse_store", sql("bow vocab triples", """SELECT 'bow' AS name, count(*) AS n FROM bow
UNION ALL SELECT 'triples', count(*) FROM triples UNION ALL SELECT 'vocab', count(*) FROM vocab"""))
def snk_parse_store(d):
    path = stage_path(d.spark, "parse")
    sig = store.signature(d.documents, {"min_df": 5})
    store.save_parse(path, {"vocab": d.vocab, "bow": d.bow, "triples": d.triples}, sig)
    tables, why = store.load_parse(d.spark, path, sig)
    stale, reasons = store.load_parse(d.spark, path, store.signature(d.documents, {"min_df": 6}))
    if why or stale is not None or not reasons:
        raise RuntimeError(f"store check failed: {why} {reasons}")
    return _sizes(d, tables)


CTX = f"""ctx AS (SELECT term_id, doc_id, vec FROM (SELECT term_id, b.doc_id, vec, row_number() OVER (PARTITION BY term_id
  ORDER BY {u01(42, 'term_id', 'b.doc_id')}, b.doc_id) AS r FROM bow b JOIN demb e ON b.doc_id = e.doc_id) WHERE r <= 50)"""


@query("snk_ctx_store", sql("bow demb", "SELECT term_id, count(*) AS n FROM ctx GROUP BY 1", extra=CTX))
def snk_ctx_store(d):
    path = stage_path(d.spark, "ctx")
    store.save_tables(path, "contexts", {"contexts": collect_contexts(d.bow, d.embeddings)}, {"cap": 50})
    tables, _ = store.load_tables(d.spark, path, "contexts")
    return tables["contexts"].groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))


def _saved(d, docs=None):
    path = stage_path(d.spark, "model")
    store.save_model(path, d.theta, d.phi, d.vocab, {"num_topics": TOPICS, "later": 1}, docs)
    return store.load_model(d.spark, path, ("num_topics",))


@query("snk_model_save", sql("words", "SELECT topic, rank, term FROM words"))
def snk_model_save(d):
    tables, _ = _saved(d)
    return reports.top_words(tables["phi"], 10).select("topic", "rank", "term")


@query("snk_model_load", sql("phi theta vocab", """SELECT 'config:num_topics' AS name, 4 AS n
UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'phi', count(*) FROM phi
UNION ALL SELECT 'theta', count(*) FROM theta UNION ALL SELECT 'vocab', count(*) FROM vocab"""))
def snk_model_load(d):
    tables, config = _saved(d, d.documents.select("doc_id", "text"))
    rows = [(f"config:{k}", int(v)) for k, v in config.items()]
    return _sizes(d, tables).unionByName(d.spark.createDataFrame(rows, "name string, n bigint"))


@query("snk_runs_append", sql("runs", """SELECT corpus, model, count(*) AS n, count(DISTINCT seed) AS n_seeds,
  sum(npmi) AS npmi_sum FROM runs GROUP BY 1, 2""", "npmi_sum"))
def snk_runs_append(d):
    path = stage_path(d.spark, "runs")
    store.append_runs(d.runs.where("seed <= 4"), path)
    done = d.spark.read.parquet(path)
    todo = store.pending(d.runs.select(*store.RUN_KEY), done)
    store.append_runs(d.runs.join(todo, list(store.RUN_KEY)), path)
    return d.spark.read.parquet(path).groupBy("corpus", "model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("n_seeds"), F.sum("npmi").alias("npmi_sum"))


@query("snk_redo_errors", sql("runs", "SELECT corpus, model, seed, k FROM runs WHERE seed % 3 = 0"))
def snk_redo_errors(d):
    broken = d.runs.withColumn("npmi", F.when(F.col("seed") % 3 == 0, float("nan")).otherwise(F.col("npmi")))
    return store.pending(d.runs.select(*store.RUN_KEY), broken, "npmi")


@query("snk_words", sql("words mwes", """SELECT topic + 1 AS topic_id, keywords, coalesce(mwe_phrases, '') AS mwe_phrases FROM
  (SELECT topic, string_agg(term, ' | ' ORDER BY rank) AS keywords FROM words GROUP BY 1) LEFT JOIN
  (SELECT topic, string_agg(phrase, ' | ' ORDER BY rank) AS mwe_phrases FROM mwes GROUP BY 1) USING (topic)"""))
def snk_words(d):
    return store.word_cells(d.words, d.mwes)


# -- text preparation --------------------------------------------------------------

@query("txt_normalise_ws", f"SELECT doc_id, {ws('text')} AS text FROM documents")
def txt_normalise_ws(d):
    return d.documents.select("doc_id", T.normalise_ws("text").alias("text"))


@query("txt_min_chars", f"SELECT doc_id FROM documents WHERE length({ws('text')}) > 10")
def txt_min_chars(d):
    return d.documents.where(T.long_enough("text")).select("doc_id")


@query("txt_sentences", sql("sents", "SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, s AS sentence FROM sents"))
def txt_sentences(d):
    return d.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_id", "sentence"))


def _chunk_sql(where: str = "TRUE") -> str:
    return f"""segs AS (SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS seg_id, unnest(cs) AS text FROM (
  SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= 800 THEN [t] ELSE
    CASE WHEN p.cur <> '' THEN list_append(p.done, p.cur) ELSE p.done END END AS cs FROM (
    SELECT doc_id, t, list_reduce(list_transform(ss, lambda z: {{'done': []::VARCHAR[], 'cur': z}}),
      lambda acc, x: CASE WHEN acc.cur <> '' AND length(acc.cur) + 1 + length(x.cur) > 800
        THEN {{'done': list_append(acc.done, acc.cur), 'cur': x.cur}}
        ELSE {{'done': acc.done, 'cur': CASE WHEN acc.cur = '' THEN x.cur ELSE acc.cur || ' ' || x.cur END}} END,
      {{'done': []::VARCHAR[], 'cur': ''}}) AS p FROM (
      SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') AS ss
      FROM clean WHERE {where}))))"""


@query("txt_chunk_bow", sql("", "SELECT doc_id, seg_id, text FROM segs", extra=CLEAN + ",\n" + _chunk_sql()))
def txt_chunk_bow(d):
    return corpus.segments(d.documents, 800)


@query("txt_chunk_neural", sql("", "SELECT doc_id, seg_id, text FROM segs",
                               extra=CLEAN + ",\n" + _chunk_sql("length(t) > 10")))
def txt_chunk_neural(d):
    return corpus.segments(d.documents, 800, drop_short=True)


@query("txt_chunk_labels", sql("", "SELECT doc_id, seg_id, quality FROM segs JOIN labels USING (doc_id)",
                               extra=CLEAN + ",\n" + _chunk_sql()))
def txt_chunk_labels(d):
    return corpus.label_segments(corpus.segments(d.documents, 800),
                                 d.table("labels").select("doc_id", "quality")).select("doc_id", "seg_id", "quality")


def _count_sql(expr: str) -> str:
    return f"SELECT term, count(*) AS n FROM (SELECT unnest({expr}) AS term FROM documents) GROUP BY 1"


@query("txt_word_tokens", _count_sql(wordlist("text")))
def txt_word_tokens(d):
    return _count(d.documents.select(F.explode(T.words("text")).alias("term")))


@query("txt_ascii_tokens", _count_sql("regexp_extract_all(lower(text), '[a-z]{2,}')"))
def txt_ascii_tokens(d):
    return _count(d.documents.select(F.explode(T.ascii_words("text")).alias("term")))


@query("txt_ref_tokens", _count_sql(
    f"list_filter(string_split({ws('lower(text)')}, ' '), lambda z: regexp_full_match(z, '\\p{{L}}+') AND length(z) > 2 "
    f"AND NOT list_contains({STOPS}, z))"))
def txt_ref_tokens(d):
    return _count(d.documents.select(F.explode(T.reference_words("text", ENG)).alias("term")))


@query("txt_ref_bow_tokens", _count_sql(
    "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda z: regexp_full_match(z, '[a-z][a-z_]+') "
    f"AND NOT list_contains({STOPS}, z))"))
def txt_ref_bow_tokens(d):
    return _count(d.documents.select(F.explode(T.reference_bow_words("text", ENG)).alias("term")))


KEPT = "NOT is_stop AND is_alpha AND length(lemma) >= 3"


@query("txt_lemma_filter", sql("stok", f"SELECT doc_id, sent_id, tok_id, lemma FROM stok WHERE {KEPT}"))
def txt_lemma_filter(d):
    return corpus.kept_tokens(d.tokens).select("doc_id", "sent_id", "tok_id", "lemma")


@query("txt_lemma_docs", sql("stok", f"""SELECT doc_id, string_agg(lemma, ' ' ORDER BY sent_id, tok_id) AS lemmas
FROM stok WHERE {KEPT} GROUP BY 1"""))
def txt_lemma_docs(d):
    return corpus.lemma_documents(d.tokens)


@query("txt_stop_words", f"""SELECT term, n FROM ({_count_sql(wordlist('text'))}) WHERE NOT list_contains({STOPS}, term)""")
def txt_stop_words(d):
    stops = corpus.stop_table(d.spark, STOP_WORDS["eng"])
    words = d.documents.select(F.explode(T.words("text")).alias("term"))
    return _count(words.join(F.broadcast(stops), "term", "left_anti"))


UNION = "[" + ", ".join(f"'{w}'" for w in sorted(ENG | EXTRA_STOP_WORDS)) + "]"


@query("txt_stop_union", f"""SELECT s.term, count(t.term) AS n FROM (SELECT unnest({UNION}) AS term) s LEFT JOIN
  (SELECT unnest({wordlist('text')}) AS term FROM documents) t ON s.term = t.term GROUP BY 1""")
def txt_stop_union(d):
    stops = corpus.stop_table(d.spark, STOP_WORDS["eng"], EXTRA_STOP_WORDS)
    seen = _count(d.documents.select(F.explode(T.words("text")).alias("term")))
    return stops.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


@query("txt_clean_topic_words", sql("phi", """SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY r) AS INTEGER) AS rank, term FROM (
  SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS r FROM phi)
WHERE r <= 15 AND term NOT IN ('les', 'the', 'der', 'los') QUALIFY row_number() OVER (PARTITION BY topic ORDER BY r) <= 10"""))
def txt_clean_topic_words(d):
    return corpus.clean_topic_words(reports.top_words(d.phi, 15), {"les", "the", "der", "los"}, 10).select(
        "topic", "rank", "term")


BIGRAMS = f"""alist AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS tokens FROM documents),
abi AS (SELECT w1, w2, count(*) AS cnt FROM (SELECT unnest(list_slice(tokens, 1, len(tokens) - 1)) AS w1,
  unnest(list_slice(tokens, 2, len(tokens))) AS w2 FROM alist WHERE len(tokens) >= 2) GROUP BY 1, 2),
auni AS (SELECT w, count(*) AS cnt FROM (SELECT unnest(tokens) AS w FROM alist) GROUP BY 1),
abest AS (SELECT w1, w2, b.cnt, ln((b.cnt / (SELECT sum(cnt) FROM abi)::DOUBLE) / ((u.cnt / (SELECT sum(cnt) FROM auni)::DOUBLE) *
  (v.cnt / (SELECT sum(cnt) FROM auni)::DOUBLE))) AS pmi FROM abi b JOIN auni u ON w1 = u.w JOIN auni v ON w2 = v.w WHERE b.cnt >= 10),
atop AS (SELECT w1, w2, cnt, pmi, CAST(row_number() OVER (ORDER BY round(pmi, 9) DESC, w1, w2) AS INTEGER) AS rank FROM abest QUALIFY rank <= 200)"""


def ascii_lists(d):
    return corpus.word_lists(d.documents, T.ascii_words("text"))


@query("txt_split_bigrams", sql("", """SELECT w1 AS term, count(*) AS n FROM (SELECT w1 FROM abi WHERE cnt >= 10
  UNION ALL SELECT w2 FROM abi WHERE cnt >= 10) GROUP BY 1""", extra=BIGRAMS))
def txt_split_bigrams(d):
    joined = cooc.bigrams(ascii_lists(d)).where("cnt >= 10").select(
        F.lit(0).alias("topic"), F.lit(1).alias("rank"), F.concat_ws("_", "w1", "w2").alias("term"))
    return _count(corpus.split_bigrams(joined))


@query("txt_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def txt_preview(d):
    return d.documents.select("doc_id", T.preview("text", 80).alias("preview"))


@query("txt_ngrams", sql("lists", """SELECT gram, count(DISTINCT doc_id) AS df FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS gram FROM lists
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2])) FROM lists)
GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5"""))
def txt_ngrams(d):
    grams = d.lists.select("doc_id", F.explode(F.array_distinct(
        F.concat(T.ngrams("tokens", 2), T.ngrams("tokens", 3)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


@query("txt_content_flag", sql("mwes", """SELECT avg(v) AS mwe_content_ratio FROM (SELECT topic, avg(CASE WHEN len(list_filter(
  string_split(lower(phrase), ' '), lambda z: length(z) > 3 AND NOT list_contains(['just','like','know','dont','don','youre','im','ive','thats',
  'really','way','going','got','want','make','think','thing','things','lot','yeah','okay','ok','good','bad','people','said'], z))) > 0
  THEN 1.0 ELSE 0.0 END) AS v FROM mwes GROUP BY 1)""", "mwe_content_ratio"))
def txt_content_flag(d):
    return metrics.content_ratio(d.mwes)
