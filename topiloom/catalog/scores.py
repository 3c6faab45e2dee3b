"""Queries over quality metrics, run statistics and user hooks (2.9, 2.10, 2.13)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import classify, context, cooc, corpus, metrics, reports, stats, vectors
from ..operators import vocab as V
from ..plans import fit as fits
from ..session import settle, spread
from .base import DIM, LANGS, MAX_FEATURES, TOPICS, query, replicates_sql, sql
from .graphs import DCOOC, PPMI_D, SEQ, TFIDF, _window_sql, sequences
from .models import BETA, STATIC, _parsed
from .texts import BIGRAMS, MAIN, _main, ascii_lists

N = "(SELECT count(*)::DOUBLE FROM documents)"
PAIRS = """kw AS (SELECT topic, rank, w.term_id, df FROM words w JOIN vocab v ON w.term_id = v.term_id),
tb AS (SELECT doc_id, term_id FROM bow WHERE term_id IN (SELECT term_id FROM kw)),
tco AS (SELECT a.term_id AS i, b.term_id AS j, count(*) AS co FROM tb a JOIN tb b ON a.doc_id = b.doc_id AND a.term_id <> b.term_id GROUP BY 1, 2),
prs AS (SELECT a.topic, a.rank AS r1, b.rank AS r2, a.df AS d1, b.df AS d2, coalesce(co, 0) AS co FROM kw a JOIN kw b ON a.topic = b.topic AND a.rank < b.rank
  LEFT JOIN tco ON i = a.term_id AND j = b.term_id)"""


def _pairs(d):
    if "_pairs" not in d.__dict__:
        d._pairs = settle(metrics.scored_pairs(d.words, d.rows, d.vocab, 10, MAX_FEATURES))
    return d._pairs


CVCELLS = """ci AS (SELECT src, sum(cnt)::DOUBLE AS c FROM {c} GROUP BY 1),
cc AS (SELECT x.src, x.dst, ln(cnt * (SELECT sum(c) FROM ci) / (a.c * b.c)) / -ln(cnt / (SELECT sum(c) FROM ci)) AS v FROM {c} x JOIN ci a ON a.src = x.src JOIN ci b ON b.src = x.dst
  WHERE x.src IN (SELECT term_id FROM words)),
cstrong AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) AS r FROM cc) WHERE r <= 10 AND v > 0),
cctx AS (SELECT DISTINCT topic, dst FROM words JOIN cstrong ON term_id = src),
cblk AS (SELECT w.topic, w.term_id AS src, x.dst, coalesce(v, 0.0) AS v FROM words w JOIN cctx x USING (topic) LEFT JOIN cc ON cc.src = w.term_id AND cc.dst = x.dst),
csum AS (SELECT topic, dst, sum(v) AS s FROM cblk GROUP BY 1, 2),
cw2 AS (SELECT topic, src, CASE WHEN sum(v * v) = 0 OR max(tn) = 0 THEN 0 ELSE sum(v * s) / (sqrt(sum(v * v)) * max(tn)) END AS c FROM cblk JOIN csum USING (topic, dst)
  JOIN (SELECT topic, sqrt(sum(s * s)) AS tn FROM csum GROUP BY 1) USING (topic) GROUP BY 1, 2),
cv AS (SELECT avg(m) AS c_v FROM (SELECT topic, avg(c) AS m FROM cw2 GROUP BY 1))"""


@query("m_cv", sql("tok vocab words", "SELECT c_v FROM cv", "c_v", extra=SEQ + ",\n" + _window_sql("cw", 10) + ",\n" + CVCELLS.format(c="cw")))
def m_cv(d):
    return metrics.c_v_window(d.words, sequences(d), d.vocab, 10, 10, 10, MAX_FEATURES)


NPMI = f"""(SELECT avg(m) FROM (SELECT avg(CASE WHEN co = 0 THEN -1 WHEN co = {N} THEN 0 ELSE ln(co / {N} / ((d1 / {N}) * (d2 / {N}))) / -ln(co / {N}) END) AS m FROM prs GROUP BY topic))"""
NPMI_EPS = f"""(SELECT avg(m) FROM (SELECT avg(ln((co / {N} + 1e-10) / ((d1 / {N} + 1e-10) * (d2 / {N} + 1e-10))) / -ln(co / {N} + 1e-10)) AS m FROM prs GROUP BY topic))"""


@query("m_npmi", sql("words bow vocab", f"SELECT {NPMI} AS npmi", "npmi", extra=PAIRS))
def m_npmi(d):
    return metrics.npmi(_pairs(d), d.n_docs)


@query("m_npmi_eps", sql("words bow vocab", f"SELECT {NPMI_EPS} AS npmi_eps", "npmi_eps", extra=PAIRS))
def m_npmi_eps(d):
    return metrics.npmi_smoothed(_pairs(d), d.n_docs)


WIN = """wl AS (SELECT doc_id, len(tokens) AS n FROM lists WHERE len(tokens) > 0),
wn AS (SELECT sum(greatest(1, n - 9))::DOUBLE AS n FROM wl),
wocc AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, pos - 9), least(pos, greatest(1, n - 9) - 1) + 1)) AS s FROM tok JOIN wl USING (doc_id)
  WHERE term IN (SELECT term FROM words)),
wdf AS (SELECT term, count(*) AS df FROM wocc GROUP BY 1),
wco AS (SELECT a.term AS a, b.term AS b, count(*) AS co FROM wocc a JOIN wocc b ON a.doc_id = b.doc_id AND a.s = b.s GROUP BY 1, 2),
wpr AS (SELECT x.topic, x.rank AS r1, y.rank AS r2, x.term AS a, y.term AS b, ln((coalesce(co, 0) / n + 1e-12) / ((p.df / n) * (q.df / n))) / -ln(coalesce(co, 0) / n + 1e-12) AS m
  FROM words x JOIN words y ON x.topic = y.topic JOIN wdf p ON p.term = x.term JOIN wdf q ON q.term = y.term LEFT JOIN wco ON wco.a = x.term AND wco.b = y.term, wn)"""
CNPMI = "(SELECT avg(v) FROM (SELECT avg(m) AS v FROM wpr WHERE r1 < r2 GROUP BY topic))"
CVW = """(SELECT avg(v) FROM (SELECT topic, avg(c) AS v FROM (SELECT topic, a, sum(m * t) / (sqrt(sum(m * m)) * sqrt(sum(t * t))) AS c FROM wpr
  JOIN (SELECT topic, b, sum(m) AS t FROM wpr GROUP BY 1, 2) USING (topic, b) GROUP BY 1, 2) GROUP BY 1))"""


def _window(d):
    return metrics.window_coherence(d.words, spread(d.lists), 10)


@query("m_cnpmi_window", sql("tok words", f"SELECT {CNPMI} AS c_npmi, {CVW} AS c_v", "c_npmi c_v", extra=WIN))
def m_cnpmi_window(d):
    w = _window(d)
    return d.spark.createDataFrame([(w["c_npmi"], w["c_v"])], "c_npmi double, c_v double")


UMASS = "um AS (SELECT topic, avg(ln((co + 1.0) / (d1 + 1.0))) AS umass FROM prs GROUP BY 1)"
EXCL = """ex AS (SELECT topic, avg(weight / m) AS exclusivity FROM phi JOIN words USING (topic, term_id) JOIN (SELECT term_id, sum(weight) AS m FROM phi GROUP BY 1) USING (term_id) GROUP BY 1)""".replace("weight / m", "phi.weight / m")


@query("m_umass", sql("words bow vocab", "SELECT topic, umass FROM um", "umass", extra=PAIRS + ",\n" + UMASS))
def m_umass(d):
    return metrics.umass(_pairs(d))


DIV = "(SELECT count(DISTINCT term) / count(*)::DOUBLE FROM words)"


@query("m_diversity", sql("words", f"SELECT {DIV} AS diversity", "diversity"))
def m_diversity(d):
    return metrics.diversity(d.words)


@query("m_exclusivity", sql("phi words", "SELECT avg(exclusivity) AS exclusivity FROM ex", "exclusivity", extra=EXCL))
def m_exclusivity(d):
    return metrics.exclusivity(d.phi, d.words, 10 * TOPICS)


RED = f"""(SELECT coalesce(sum(s / (10 + 10 - s)::DOUBLE), 0) / ({TOPICS} * ({TOPICS} - 1) / 2) FROM (SELECT count(*) AS s FROM words a JOIN words b ON a.term = b.term AND a.topic < b.topic GROUP BY a.topic, b.topic))"""


@query("m_redundancy", sql("words", f"SELECT {RED} AS redundancy", "redundancy"))
def m_redundancy(d):
    return metrics.redundancy(d.words)


@query("m_summary", sql("words bow vocab phi", f"SELECT c_v, {NPMI} AS npmi, {DIV} AS diversity, (SELECT avg(exclusivity) FROM ex) AS exclusivity, {RED} AS redundancy FROM cv",
                        "c_v npmi diversity exclusivity redundancy", extra=",\n".join([PAIRS, EXCL, DCOOC, CVCELLS.format(c="dc")])))
def m_summary(d):
    return fits.summary(d.words, _parsed(d), d.phi, 10)


def _label_pairs(d):
    return d.dominant.select("doc_id", F.col("topic").alias("a")).join(
        d.embeddings.select("doc_id", F.col("label").alias("b")), "doc_id")


NMI = """np AS (SELECT topic AS a, label AS b, count(*) AS n FROM dom JOIN demb USING (doc_id) GROUP BY 1, 2),
nt AS (SELECT sum(n)::DOUBLE AS t FROM np),
na AS (SELECT a, sum(n) AS n FROM np GROUP BY 1), nb AS (SELECT b, sum(n) AS n FROM np GROUP BY 1),
nmi AS (SELECT (SELECT sum(np.n / t * ln(np.n * t / (na.n * nb.n))) FROM np JOIN na USING (a) JOIN nb USING (b), nt) /
  (((SELECT -sum(n / t * ln(n / t)) FROM na, nt) + (SELECT -sum(n / t * ln(n / t)) FROM nb, nt)) / 2) AS nmi)"""


def _features(d):
    return d.theta_rows.join(d.table("labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select(
        "doc_id", "label", F.col("w").alias("vec"))


@query("m_evaluator")
def m_evaluator(d):
    runs = _runs3(d)
    row = [metrics.npmi_smoothed(_pairs(d), d.n_docs).first()[0], metrics.diversity(d.words, 0.0).first()[0], TOPICS,
           metrics.nmi(_label_pairs(d)).first()[0], classify.holdout_f1(_features(d)), metrics.ari(runs).first()[0]]
    return d.spark.createDataFrame([tuple(row)], "npmi_coherence double, topic_diversity double, n_topics int, "
                                                 "nmi double, downstream_f1 double, stability_ari double")


@query("m_quality", sql("tok words", f"SELECT {CNPMI} * {DIV} AS quality", "quality", extra=WIN))
def m_quality(d):
    return metrics.diversity(d.words).select((F.col("diversity") * _window(d)["c_npmi"]).alias("quality"))


CD = """(SELECT avg(sqrt(u * u + e * e)) FROM (SELECT (umass - min(umass) OVER ()) / (max(umass) OVER () - min(umass) OVER ()) AS u,
  (exclusivity - min(exclusivity) OVER ()) / (max(exclusivity) OVER () - min(exclusivity) OVER ()) AS e FROM um JOIN ex USING (topic)))"""


def _cd(d):
    return metrics.cd_score(metrics.umass(_pairs(d)).join(
        metrics.exclusivity_per_topic(d.phi, d.words, 10 * TOPICS), "topic"))


@query("m_cd", sql("words bow vocab phi", f"SELECT {CD} AS cd_score", "cd_score", extra=",\n".join([PAIRS, UMASS, EXCL])))
def m_cd(d):
    return _cd(d)


JS = """(SELECT sum(0.5 * a * log2(a / m) + 0.5 * b * log2(b / m)) / 6 FROM (SELECT greatest(coalesce(p.weight, 0), 1e-12) AS a, greatest(coalesce(q.weight, 0), 1e-12) AS b,
  greatest((coalesce(p.weight, 0) + coalesce(q.weight, 0)) * 0.5, 1e-12) AS m FROM (SELECT i, j, term_id FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), vocab WHERE i < j) g
  LEFT JOIN phi p ON p.topic = i AND p.term_id = g.term_id LEFT JOIN phi q ON q.topic = j AND q.term_id = g.term_id))"""


@query("m_js", sql("phi vocab", f"SELECT {JS} AS js_divergence", "js_divergence"))
def m_js(d):
    return metrics.js_divergence(d.phi, TOPICS)


BETW = "(SELECT avg(list_cosine_similarity(a.vec, b.vec)) FROM tv a JOIN tv b ON a.topic < b.topic)"


@query("m_between_cos", sql("tv", f"SELECT {BETW} AS between_topic_cosine", "between_topic_cosine"))
def m_between_cos(d):
    return metrics.between_topic_cosine(d.topic_vectors, DIM)


WE = """(SELECT coalesce(avg(v), 0) FROM (SELECT avg(list_cosine_similarity(x.vec, y.vec)) AS v FROM words a JOIN words b ON a.topic = b.topic AND a.rank < b.rank
  JOIN wv x ON x.term_id = a.term_id JOIN wv y ON y.term_id = b.term_id GROUP BY a.topic))"""


@query("m_we_coherence", sql("words wv", f"SELECT {WE} AS we_coherence", "we_coherence"))
def m_we_coherence(d):
    return metrics.we_coherence(d.words, d.word_vectors, DIM)


INTRA = """iu AS (SELECT doc_id, topic, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM demb JOIN dom USING (doc_id))),
ic AS (SELECT topic, i, avg(x) AS c FROM iu GROUP BY 1, 2),
intra AS (SELECT avg(m) AS v FROM (SELECT topic, avg(s) AS m FROM (SELECT iu.topic, doc_id, sum(x * c) / max(n) AS s FROM iu JOIN ic USING (topic, i)
  JOIN (SELECT topic, sqrt(sum(c * c)) AS n FROM ic GROUP BY 1) USING (topic) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2))"""


@query("m_intra_emb", sql("demb dom", "SELECT v AS intra_topic FROM intra", "intra_topic", extra=INTRA))
def m_intra_emb(d):
    return metrics.intra_topic(d.dominant, d.embeddings, DIM)


@query("m_intra_tfidf", sql("bow dom", """SELECT avg(v) AS intra_tfidf FROM (SELECT topic, (coalesce(q, 0) - n) / (n * (n - 1)) AS v FROM (SELECT topic, count(*)::DOUBLE AS n FROM dom GROUP BY 1)
LEFT JOIN (SELECT topic, sum(s * s) AS q FROM (SELECT topic, term_id, sum(tfidf.weight) AS s FROM tfidf JOIN dom USING (doc_id) GROUP BY 1, 2) GROUP BY 1) USING (topic) WHERE n >= 2)""",
                                 "intra_tfidf", extra=TFIDF.format(bow="bow")))
def m_intra_tfidf(d):
    return metrics.intra_tfidf(V.tfidf(d.bow, d.n_docs, MAX_FEATURES), d.dominant)


PPL = """(SELECT exp(-sum(cnt * ln(greatest(p, 1e-12))) / sum(cnt)) FROM (SELECT doc_id, term_id, any_value(cnt) AS cnt, sum(t.weight * p.weight) AS p FROM bow JOIN theta t USING (doc_id)
  JOIN phi p USING (topic, term_id) GROUP BY 1, 2))"""


def _perplexity(d):
    return metrics.perplexity_at(context.expected_at(d.rows, d.theta, d.phi, TOPICS, MAX_FEATURES))


@query("m_perplexity", sql("bow theta phi", f"SELECT {PPL} AS perplexity", "perplexity"))
def m_perplexity(d):
    return _perplexity(d)


@query("m_mwe_compact_words", sql("mwes wv", """SELECT avg(list_cosine_similarity(a.vec, b.vec)) AS mwe_compactness FROM mwes JOIN wv a ON a.term = split_part(phrase, ' ', 1)
JOIN wv b ON b.term = split_part(phrase, ' ', 2) WHERE rank <= 10""", "mwe_compactness"))
def m_mwe_compact_words(d):
    return metrics.mwe_word_compactness(d.mwes, d.word_vectors, 10, MAX_FEATURES)


PV = """pv AS (SELECT topic, phrase, list((a.x + b.x) / 2 ORDER BY a.i) AS vec FROM mwes JOIN wvx a ON a.term = split_part(phrase, ' ', 1)
  JOIN wvx b ON b.term = split_part(phrase, ' ', 2) AND a.i = b.i GROUP BY 1, 2)"""
MTOP = "(SELECT avg(v) FROM (SELECT avg(list_cosine_similarity(pv.vec, tv.vec)) AS v FROM pv JOIN tv USING (topic) GROUP BY topic))"
MCOMP = """(SELECT avg(v) FROM (SELECT topic, avg(1 - m) AS v FROM (SELECT pv.topic, phrase, max(list_cosine_similarity(pv.vec, wv.vec)) AS m FROM pv JOIN words USING (topic)
  JOIN wv USING (term_id) GROUP BY 1, 2) GROUP BY 1))"""


def phrase_rows(d):
    parts = d.mwes.select("topic", "rank", "phrase", F.split("phrase", " ")[0].alias("a"), F.split("phrase", " ")[1].alias("b"))
    v = d.word_vectors
    return parts.join(v.select(F.col("term").alias("a"), F.col("vec").alias("va")), "a").join(
        v.select(F.col("term").alias("b"), F.col("vec").alias("vb")), "b").select(
        "topic", "rank", "phrase", F.zip_with("va", "vb", lambda x, y: (x + y) / 2.0).alias("vec"))


def single_rows(d):
    return d.words.select("topic", "term").join(d.word_vectors.select("term", "vec"), "term")


@query("m_mwe_compact_topic", sql("mwes wvx tv", f"SELECT {MTOP} AS mwe_topic_compactness", "mwe_topic_compactness", extra=PV))
def m_mwe_compact_topic(d):
    return metrics.mwe_topic_compactness(phrase_rows(d), d.topic_vectors)


SPEC = f"""(SELECT avg(s) FROM (SELECT topic, rank, max(ln({N} / df)) AS s FROM (SELECT topic, rank, unnest(string_split(phrase, ' ')) AS term FROM mwes) JOIN
  (SELECT term, count(*) AS df FROM counts GROUP BY 1) USING (term) GROUP BY 1, 2))"""


@query("m_mwe_specificity", sql("mwes counts", f"SELECT {SPEC} AS mwe_specificity", "mwe_specificity"))
def m_mwe_specificity(d):
    return metrics.mwe_specificity(d.mwes, V.doc_freq(d.counts), d.n_docs)


@query("m_mwe_compl", sql("mwes wvx words wv", f"SELECT {MCOMP} AS mwe_complementarity", "mwe_complementarity", extra=PV))
def m_mwe_compl(d):
    return metrics.mwe_complementarity(phrase_rows(d), single_rows(d))


# The lexicon is an input table; here it is derived from the vocabulary by arithmetic.
LEX = """lex AS (SELECT term AS token, ((term_id * 37) % 9 - 4)::DOUBLE AS valence FROM vocab),
lex2 AS (SELECT term AS token, ((term_id * 11) % 7 - 3)::DOUBLE AS valence FROM vocab)"""


def lexicon(d, a=37, m=9, s=4):
    return d.vocab.select(F.col("term").alias("token"), ((F.col("term_id") * a) % m - s).cast("double").alias("valence"))


def _scored(src: str, lex: str, out: str, cols: str) -> str:
    return f"""{out} AS (SELECT {cols}, any_value(text) AS text, coalesce(sum(valence), 0) / sqrt(coalesce(sum(valence), 0) * coalesce(sum(valence), 0) + 15) AS score FROM (
  SELECT {cols}, text, unnest(string_split(lower(replace(text, '_', ' ')), ' ')) AS token FROM {src}) LEFT JOIN {lex} USING (token) GROUP BY {cols})"""


STR = "strs AS (SELECT 'T' || topic AS corpus, 'mwe' AS kind, rank, phrase AS text FROM mwes UNION ALL SELECT 'T' || topic, 'uni', rank, term FROM words)"


@query("m_valence", sql("mwes words vocab", """SELECT a AS mwe_valence, b AS unigram_valence, a - b AS valence_gap FROM (SELECT avg(abs(score)) FILTER (WHERE kind = 'mwe') AS a,
avg(abs(score)) FILTER (WHERE kind = 'uni') AS b FROM sc)""", "mwe_valence unigram_valence valence_gap", extra=",\n".join([LEX, STR, _scored("strs", "lex", "sc", "corpus, kind, rank")])))
def m_valence(d):
    return metrics.valence(d.mwes, d.words, lexicon(d))


def _strings(d):
    return d.mwes.select(F.concat(F.lit("T"), "topic").alias("corpus"), F.lit("mwe").alias("kind"), F.col("phrase").alias("text")).unionByName(
        d.words.select(F.concat(F.lit("T"), "topic").alias("corpus"), F.lit("uni").alias("kind"), F.col("term").alias("text")))


SIGNED = sql("mwes words vocab", """SELECT corpus, scorer, mwe, uni, mwe - uni AS gap, CAST(row_number() OVER (PARTITION BY scorer ORDER BY mwe - uni DESC, corpus) AS INTEGER) AS rank FROM (
  SELECT corpus, scorer, avg(score) FILTER (WHERE kind = 'mwe') AS mwe, avg(score) FILTER (WHERE kind = 'uni') AS uni FROM (SELECT *, 'one' AS scorer FROM sc UNION ALL SELECT *, 'two' FROM sc2) GROUP BY 1, 2)""",
             "mwe uni gap", extra=",\n".join([LEX, STR, _scored("strs", "lex", "sc", "corpus, kind, rank"), _scored("strs", "lex2", "sc2", "corpus, kind, rank")]))


def _signed(d):
    lex = lexicon(d).select(F.lit("one").alias("scorer"), "*").unionByName(
        lexicon(d, 11, 7, 3).select(F.lit("two").alias("scorer"), "*"))
    return metrics.signed_valence(_strings(d), lex)


@query("m_valence_signed", SIGNED)
def m_valence_signed(d):
    return _signed(d)


@query("udf_scorer", SIGNED)
def udf_scorer(d):
    return _signed(d)


@query("m_valence_pmi", sql("mwes vocab", """SELECT b AS pmi_mean, a AS mwe_mean, a - b AS delta FROM (SELECT avg(score) FILTER (WHERE kind = 'm') AS a, avg(score) FILTER (WHERE kind = 'b') AS b FROM sc)""",
                            "pmi_mean mwe_mean delta", extra=",\n".join([BIGRAMS, LEX, "vs AS (SELECT 'm' AS kind, topic * 100 + rank AS i, phrase AS text FROM mwes UNION ALL SELECT 'b', rank, w1 || ' ' || w2 FROM atop)",
                                                                         _scored("vs", "lex", "sc", "kind, i")])))
def m_valence_pmi(d):
    return metrics.valence_vs_bigrams(d.mwes, settle(cooc.pmi_bigrams(ascii_lists(d), 200, 10)), lexicon(d))


@query("m_valence_probs", sql("theta", """SELECT avg(CASE WHEN doc_id % 2 = 0 THEN 1 - a ELSE abs(b - c) END) AS valence FROM (SELECT doc_id, max(weight) FILTER (WHERE topic = 0) AS a,
max(weight) FILTER (WHERE topic = 1) AS b, max(weight) FILTER (WHERE topic = 2) AS c FROM theta GROUP BY 1)""", "valence"))
def m_valence_probs(d):
    name = F.when(F.col("topic") == 0, "neutral").when(F.col("topic") == 1, "POSITIVE").otherwise("NEGATIVE")
    rows = d.theta.where((F.col("topic") < 3) & ~((F.col("doc_id") % 2 == 1) & (F.col("topic") == 0)))
    return metrics.probability_valence(rows.select(F.col("doc_id").alias("item"), name.alias("label"), F.col("weight").alias("p")))


STANCE = f"""(SELECT avg(1 - h / ln(greatest(m, 2))) FROM (SELECT topic, -sum(c / t * ln(c / t + 1e-12)) AS h, count(*) AS m FROM (
  SELECT topic, quality, count(*) AS c, sum(count(*)) OVER (PARTITION BY topic) AS t FROM (SELECT doc_id, topic, count(*) OVER (PARTITION BY topic) AS n FROM dom) JOIN labels USING (doc_id) WHERE n >= 5 GROUP BY 1, 2) GROUP BY 1))"""


def _stance(d):
    return metrics.stance_concentration(d.dominant, d.table("labels").select("doc_id", F.col("quality").alias("label")))


@query("m_stance", sql("dom", f"SELECT {STANCE} AS stance", "stance"))
def m_stance(d):
    return _stance(d)


COLUMNS = ("perplexity", "npmi", "c_v", "c_npmi", "we_coherence", "diversity", "quality", "exclusivity", "cd_score", "js_divergence",
           "between_topic_cosine", "intra_topic_concentration", "mwe_compactness", "mwe_specificity", "mwe_complementarity",
           "mwe_content_ratio", "mwe_valence", "unigram_valence", "valence_gap", "mwe_valence_tf", "unigram_valence_tf",
           "valence_gap_tf", "stance_concentration", "nmi", "runtime_sec", "peak_cpu_memory_mb", "peak_gpu_memory_mb")
_ALL = {"perplexity": PPL, "npmi": NPMI_EPS, "c_v": CVW, "c_npmi": CNPMI, "we_coherence": WE, "diversity": DIV, "quality": f"{CNPMI} * {DIV}",
        "exclusivity": "(SELECT avg(exclusivity) FROM ex)", "cd_score": CD, "js_divergence": JS, "between_topic_cosine": BETW,
        "intra_topic_concentration": "(SELECT v FROM intra)", "mwe_compactness": MTOP, "mwe_specificity": SPEC, "mwe_complementarity": MCOMP,
        "mwe_valence": "(SELECT avg(abs(score)) FROM sc WHERE kind = 'mwe')", "unigram_valence": "(SELECT avg(abs(score)) FROM sc WHERE kind = 'uni')",
        "valence_gap": "(SELECT avg(abs(score)) FROM sc WHERE kind = 'mwe') - (SELECT avg(abs(score)) FROM sc WHERE kind = 'uni')",
        "stance_concentration": STANCE, "nmi": "(SELECT nmi FROM nmi)",
        "mwe_content_ratio": "(SELECT avg(v) FROM (SELECT avg(CASE WHEN len(list_filter(string_split(phrase, ' '), lambda z: length(z) > 3)) > 0 THEN 1.0 ELSE 0.0 END) AS v FROM mwes GROUP BY topic))"}


@query("m_evaluate_all", sql("tok words bow vocab phi theta dom demb mwes wv wvx tv", "SELECT " + ", ".join(
    f"{_ALL.get(c, 'NULL::DOUBLE')} AS {c}" for c in COLUMNS), " ".join(_ALL),
    extra=",\n".join([PAIRS, UMASS, EXCL, WIN, INTRA, PV, LEX, STR, _scored("strs", "lex", "sc", "corpus, kind, rank"), NMI])))
def m_evaluate_all(d):
    """The wide record; columns without an input (model scorers, resources) stay NULL."""
    val = metrics.valence(d.mwes, d.words, lexicon(d)).first()
    win, div = _window(d), metrics.diversity(d.words).first()[0]
    got = {
        "perplexity": _perplexity(d), "npmi": metrics.npmi_smoothed(_pairs(d), d.n_docs), "we_coherence": metrics.we_coherence(d.words, d.word_vectors, DIM),
        "exclusivity": metrics.exclusivity(d.phi, d.words, 10 * TOPICS), "cd_score": _cd(d), "js_divergence": metrics.js_divergence(d.phi, TOPICS),
        "between_topic_cosine": metrics.between_topic_cosine(d.topic_vectors, DIM), "intra_topic_concentration": metrics.intra_topic(d.dominant, d.embeddings, DIM),
        "mwe_compactness": metrics.mwe_topic_compactness(phrase_rows(d), d.topic_vectors), "mwe_specificity": metrics.mwe_specificity(d.mwes, V.doc_freq(d.counts), d.n_docs),
        "mwe_complementarity": metrics.mwe_complementarity(phrase_rows(d), single_rows(d)), "mwe_content_ratio": metrics.content_ratio(d.mwes),
        "stance_concentration": _stance(d), "nmi": metrics.nmi(_label_pairs(d)),
    }
    row = {k: df.first()[0] for k, df in got.items()}
    c_npmi = win["c_npmi"]
    row |= {**win, "diversity": div, "quality": None if c_npmi is None else c_npmi * div, **val.asDict()}
    return d.spark.createDataFrame([tuple(row.get(c) for c in COLUMNS)], ", ".join(f"{c} double" for c in COLUMNS))


@query("m_topic_entropy", sql("phi", "SELECT avg(h) AS topic_entropy FROM (SELECT -sum(weight * ln(weight + 1e-10)) AS h FROM phi GROUP BY topic)", "topic_entropy"))
def m_topic_entropy(d):
    return metrics.topic_entropy(d.phi)


@query("m_soft_ppmi", sql("phi bow vocab", """SELECT sum(2 * greatest(ppmi, 0) * a.weight * b.weight) / 4 AS soft_ppmi FROM pd JOIN phi a ON a.term_id = src
JOIN phi b ON b.term_id = dst AND a.topic = b.topic""", "soft_ppmi", extra=DCOOC + ",\n" + PPMI_D))
def m_soft_ppmi(d):
    return metrics.soft_ppmi(d.phi, cooc.ppmi_documents(d.rows, d.vocab, d.n_docs, MAX_FEATURES), MAX_FEATURES, TOPICS)


@query("m_soft_we", sql("tv wv wvx", """SELECT avg(c) AS soft_we FROM (SELECT topic, list_cosine_similarity(list(m ORDER BY i), any_value(vec)) AS c FROM (
  SELECT topic, i, sum(weight * x / n) AS m FROM sbeta JOIN wvx USING (term_id) JOIN (SELECT term_id, sqrt(sum(x * x)) AS n FROM wvx GROUP BY 1) USING (term_id) GROUP BY 1, 2)
JOIN tv USING (topic) GROUP BY 1)""", "soft_we", extra=STATIC + ",\n" + BETA))
def m_soft_we(d):
    return metrics.soft_we(d.topic_vectors, context.static_beta(d.topic_list, d.word_vectors), d.word_vectors, DIM, MAX_FEATURES)


@query("m_nmi", sql("dom demb", "SELECT nmi FROM nmi", "nmi", extra=NMI))
def m_nmi(d):
    return metrics.nmi(_label_pairs(d))


def _runs3(d):
    lang = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int")
    return d.dominant.select(F.lit(0).alias("run"), "doc_id", "topic").unionByName(
        d.documents.select(F.lit(1).alias("run"), "doc_id", lang.alias("topic"))).unionByName(
        d.documents.select(F.lit(2).alias("run"), "doc_id", (F.col("n_chars") % 3).cast("int").alias("topic")))


@query("m_ari", sql("dom", """SELECT avg((ij - a * b / t) / ((a + b) / 2 - a * b / t)) AS ari FROM (SELECT r, o, sum(n * (n - 1) / 2.0) AS ij, any_value(m * (m - 1) / 2.0) AS t FROM cells, (SELECT count(*)::DOUBLE AS m FROM smp) GROUP BY 1, 2)
JOIN (SELECT r, o, sum(n * (n - 1) / 2.0) AS a FROM (SELECT r, o, x, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (r, o)
JOIN (SELECT r, o, sum(n * (n - 1) / 2.0) AS b FROM (SELECT r, o, y, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (r, o)""", "ari", extra=f"""
smp AS (SELECT doc_id FROM documents),
r3 AS (SELECT 0 AS run, doc_id, topic FROM dom UNION ALL SELECT 1, doc_id, list_position(['en', 'fr', 'de', 'es'], lang) FROM documents UNION ALL SELECT 2, doc_id, n_chars % 3 FROM documents),
cells AS (SELECT a.run AS r, b.run AS o, a.topic AS x, b.topic AS y, count(*)::DOUBLE AS n FROM r3 a JOIN r3 b ON a.doc_id = b.doc_id AND a.run < b.run WHERE a.doc_id IN (SELECT doc_id FROM smp) GROUP BY 1, 2, 3, 4)"""))
def m_ari(d):
    return metrics.ari(_runs3(d))


@query("m_f1_holdout")
def m_f1_holdout(d):
    return d.spark.createDataFrame([(classify.holdout_f1(_features(d)),)], "macro_f1 double")


@query("m_cv_classify")
def m_cv_classify(d):
    r = classify.cross_validate(_features(d))
    return d.spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r))


@query("m_downstream")
def m_downstream(d):
    theta = _features(d)
    phrases = sorted(r[0] for r in d.mwes.select("phrase").distinct().collect())
    found = reports.phrase_features(d.documents, d.mwes).groupBy("doc_id").agg(F.collect_set("phrase").alias("p"))
    flags = F.array(*[F.coalesce(F.array_contains("p", p), F.lit(False)).cast("double") for p in phrases])
    both = theta.join(found, "doc_id", "left").select("doc_id", "label", "vec", flags.alias("m"))
    emb = theta.select("doc_id", "label").join(d.embeddings.select("doc_id", "vec"), "doc_id")
    return classify.downstream({"tfidf": classify.tfidf_features(theta, d.documents), "theta": theta, "mwe": both.select("doc_id", "label", F.col("m").alias("vec")),
                                "theta+mwe": both.select("doc_id", "label", F.concat("vec", "m").alias("vec")), "embedding": emb}, seeds=(0, 1, 2))


# -- statistics over run records ---------------------------------------------------

@query("st_bootstrap", sql("", """SELECT l_returnflag, n, estimate, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT l_returnflag, sum(w * l_discount) / sum(w) AS m FROM bs GROUP BY l_returnflag, b)
JOIN (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS estimate FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1, 2, 3""", "estimate ci_low ci_high",
                             extra=f"bs AS {replicates_sql('lineitem', 'l_orderkey * 10 + l_linenumber', 200)}"))
def st_bootstrap(d):
    rows = spread(d.table("lineitem")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return stats.bootstrap_poisson(rows, "l_discount", "id", ["l_returnflag"])


PAIRED = "pr AS (SELECT a.corpus, a.seed, a.k, a.npmi AS a, b.npmi AS b FROM runs a JOIN runs b ON a.corpus = b.corpus AND a.seed = b.seed AND a.k = b.k WHERE a.model = 'A' AND b.model = 'R')"
KEY = ["corpus", "k"]


def _paired(d):
    return stats.paired(d.runs, "npmi", "A", "R")


@query("st_paired_ci")
def st_paired_ci(d):
    return stats.bootstrap_draws(_paired(d).withColumn("d", F.col("a") - F.col("b")), "d", KEY)


@query("st_excludes_zero", sql("runs", "SELECT corpus, k, min(a - b) > 0 OR max(a - b) < 0 AS excludes FROM pr GROUP BY 1, 2", extra=PAIRED))
def st_excludes_zero(d):
    g = _paired(d).groupBy(*KEY).agg(F.min(F.col("a") - F.col("b")).alias("ci_low"), F.max(F.col("a") - F.col("b")).alias("ci_high"))
    return g.select(*KEY, stats.excludes_zero().alias("excludes"))


CLIFF = "cl AS (SELECT x.corpus, x.k, (sum(CASE WHEN x.a > y.b THEN 1 ELSE 0 END) - sum(CASE WHEN x.a < y.b THEN 1 ELSE 0 END)) / count(*)::DOUBLE AS cliffs_delta FROM pr x JOIN pr y ON x.corpus = y.corpus AND x.k = y.k GROUP BY 1, 2)"


@query("st_cliffs", sql("runs", "SELECT corpus, k, cliffs_delta FROM cl", "cliffs_delta", extra=PAIRED + ",\n" + CLIFF))
def st_cliffs(d):
    return stats.cliffs_delta(_paired(d), KEY)


@query("st_cohens_dz", sql("runs", "SELECT corpus, k, avg(a - b) / stddev_samp(a - b) AS cohens_dz FROM pr GROUP BY 1, 2", "cohens_dz", extra=PAIRED))
def st_cohens_dz(d):
    return stats.cohens_dz(_paired(d), KEY)


WILC = """rk AS (SELECT corpus, k, a - b AS d, row_number() OVER (PARTITION BY corpus, k ORDER BY abs(a - b)) AS r FROM pr),
ss AS (SELECT corpus, k, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS statistic FROM rk GROUP BY 1, 2),
wx AS (SELECT corpus, k, n, statistic, least(1.0, 2.0 * (SELECT count(*) FROM dp WHERE dp.r = ss.n AND dp.s <= statistic) / pow(2, n)) AS p_value FROM ss)"""
DP = "dp AS (SELECT 0 AS r, 0 AS s UNION ALL SELECT r + 1, s + g * (r + 1) FROM dp, (SELECT unnest([0, 1]) AS g) WHERE r < 8)"


def _recursive(text: str) -> str:
    return text.replace("WITH ", f"WITH RECURSIVE {DP},\n", 1)


@query("st_wilcoxon", _recursive(sql("runs", """SELECT corpus, k, n, statistic, p_value, CASE WHEN 2.0 / pow(2, n) > 0.05 THEN 'low' ELSE '' END AS note FROM wx""",
                                     "statistic p_value", extra=PAIRED + ",\n" + WILC)))
def st_wilcoxon(d):
    return stats.wilcoxon(_paired(d), KEY).withColumn("note", F.when(F.col("note") != "", "low").otherwise(""))


HOLM = """ho AS (SELECT corpus, k, p_value, least(1.0, max(s) OVER (ORDER BY p_value, corpus, k)) AS p_holm FROM (
  SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, corpus, k) + 1) * p_value AS s FROM wx))"""


@query("st_holm", _recursive(sql("runs", "SELECT corpus, k, p_value, p_holm FROM ho", "p_value p_holm", extra=",\n".join([PAIRED, WILC, HOLM]))))
def st_holm(d):
    return stats.holm(stats.wilcoxon(_paired(d), KEY).select(*KEY, "p_value"), p="p_value", tie=KEY)


AGG = "SELECT {g}, 'npmi' AS metric, count(*) AS n, avg(npmi) AS mean, coalesce(stddev_samp(npmi), 0) AS sd FROM runs GROUP BY {g}"


@query("st_aggregate", sql("runs", AGG.format(g="corpus, model"), "mean sd"))
def st_aggregate(d):
    return stats.summarise(d.runs, "npmi").drop("ci_low", "ci_high")


@query("st_compare_group", sql("runs", AGG.format(g="model, k"), "mean sd"))
def st_compare_group(d):
    return stats.summarise(d.runs, "npmi", group=("model", "k")).drop("ci_low", "ci_high")


@query("udf_group", sql("runs", AGG.format(g="corpus, seed"), "mean sd"))
def udf_group(d):
    return stats.summarise(d.runs, "npmi", group=("corpus", "seed")).drop("ci_low", "ci_high")


@query("st_compare_paired", _recursive(sql("runs", """SELECT corpus, k, 'npmi' AS metric, n, 'R' AS baseline, 'A' AS treatment, mb AS mean_baseline, mt AS mean_treatment, mt - mb AS diff, cliffs_delta, p_value AS p_raw, p_holm
FROM wx JOIN ho USING (corpus, k, p_value) JOIN cl USING (corpus, k) JOIN (SELECT corpus, k, avg(a) AS mt, avg(b) AS mb FROM pr GROUP BY 1, 2) USING (corpus, k)""",
    "mean_baseline mean_treatment diff cliffs_delta p_raw p_holm", extra=",\n".join([PAIRED, CLIFF, WILC, HOLM]))))
def st_compare_paired(d):
    return stats.compare(d.runs, "npmi", "A", "R").drop("ci_low", "ci_high", "note")


@query("st_mean_std", sql("runs", """SELECT corpus, model, k, round(avg(npmi), 4) AS npmi_mean, round(stddev_samp(npmi), 4) AS npmi_std, round(avg(c_v), 4) AS c_v_mean, round(stddev_samp(c_v), 4) AS c_v_std
FROM runs GROUP BY 1, 2, 3""", "npmi_mean npmi_std c_v_mean c_v_std"))
def st_mean_std(d):
    return stats.mean_std(d.runs, ["npmi", "c_v"])


@query("st_main_table", sql("runs", "SELECT corpus, model, k, npmi_mean, npmi_std FROM main", "npmi_mean npmi_std", extra=MAIN))
def st_main_table(d):
    return _main(d)


# -- user hooks --------------------------------------------------------------------

class FirstWordHead:
    """A stand-in parser: the first word of a text is the head of all others."""

    name = "first-word"

    def pipe(self, texts, batch_size=64):
        for text in texts:
            forms = text.split()
            yield [(0, i + 1, w, w, "X", "root" if i == 0 else "nmod", 0 if i == 0 else 1, False, w.isalpha())
                   for i, w in enumerate(forms)]


@query("udf_parser", "SELECT item_id AS doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(w, '\\p{L}+')) AS n_alpha FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS w FROM benchmark) GROUP BY 1")
def udf_parser(d):
    docs = d.table("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return corpus.parse_with(docs, FirstWordHead).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_alpha").cast("int")).alias("n_alpha"))


@query("udf_statistic", sql("runs", "SELECT corpus, model, count(*) AS n, median(npmi) AS estimate FROM runs GROUP BY 1, 2", "estimate"))
def udf_statistic(d):
    return stats.bootstrap_draws(d.runs, "npmi", ["corpus", "model"], statistic=np.median).drop("ci_low", "ci_high")


@query("udf_reducer", sql("wv tv", "SELECT 'word' AS kind, term AS label, vec[1] AS x, vec[2] AS y FROM wv UNION ALL SELECT 'topic', CAST(topic AS VARCHAR), vec[1], vec[2] FROM tv", "x y"))
def udf_reducer(d):
    def first_two(rows):
        return rows.withColumn("x", F.col("vec")[0]).withColumn("y", F.col("vec")[1])

    return vectors.project2d(d.topic_vectors, d.word_vectors, first_two)


@query("udf_relations", sql("mwes", """SELECT topic, CAST(rank AS INTEGER) AS rank, phrase, relation FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, phrase) AS rank FROM (
  SELECT w.topic, head || ' ' || dependent AS phrase, relation, cnt * CASE WHEN count(*) = 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM triples t JOIN words w ON (t.head = w.term OR t.dependent = w.term)
  WHERE relation = 'nsubj' GROUP BY w.topic, head, dependent, relation, cnt)) WHERE rank <= 5"""))
def udf_relations(d):
    return reports.mwes(d.words, d.triples, 10 * TOPICS, 5, {"nsubj"}).select("topic", "rank", "phrase", "relation")
