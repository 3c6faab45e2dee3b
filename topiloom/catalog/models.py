"""Queries over topic fitting, inference and reports (2.7 and 2.8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import TopicConfig
from ..functions import text as T
from ..functions import vec
from ..operators import classify, context, cooc, corpus, covariates, nmf, reports, temporal, vectors
from ..operators import vocab as V
from ..plans import fit as fits
from ..plans import grid
from ..session import settle, stage_path
from ..streaming import foldin
from .base import (DIM, ENG, MAX_FEATURES, MIN_DF, STOPS, TOPICS, query, replicates_sql, sql, u01)
from .graphs import CTFIDF, joined_lists
from .texts import BIGRAMS, CTX
from .graphs import JOINED, PHRASES

ITER = TopicConfig().max_iter
K = TOPICS


def _fit(d, k=K, **kw):
    args = {"max_iter": ITER, "tol": 1e-4, "init": "svd"} | kw
    return nmf.fit(d.rows, d.n_terms, k, **args)


def fitted(d):
    """One fit shared by the queries that only read a model."""
    if "_fitted" not in d.__dict__:
        d._fitted = _fit(d)
    return d._fitted


def syntax_arrays(d):
    from ..operators import graphs

    return graphs.edge_arrays(d.syntax, d.n_terms, 15)


# An arithmetic start gives both engines the same factors for one update step.
def start_w(d):
    w = F.array(*[((F.col("doc_id") * 7919 + k * 104729) % 10007 + 1) / F.lit(10007.0) for k in range(K)])
    return d.rows.select("doc_id", w.alias("w"))


def start_h(d):
    h = F.array(*[((F.col("term_id") * 7907 + k * 103) % 1009 + 1) / F.lit(1009.0) for k in range(K)])
    return d.vocab.select("term_id", h.alias("h"))


START = f"""w0 AS MATERIALIZED (SELECT doc_id, k, ((doc_id * 7919 + k * 104729) % 10007 + 1) / 10007.0::DOUBLE AS w FROM (SELECT DISTINCT doc_id FROM bow), (SELECT unnest(range({K})) AS k)),
h0 AS MATERIALIZED (SELECT term_id, k, ((term_id * 7907 + k * 103) % 1009 + 1) / 1009.0::DOUBLE AS h FROM vocab, (SELECT unnest(range({K})) AS k))"""
STEPS = 3


def _fitted_cells(name: str, w: str, h: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT doc_id, term_id, cnt, greatest(sum(w * h), 1e-10) AS wh FROM bow JOIN {w} USING (doc_id) "
            f"JOIN {h} USING (term_id, k) GROUP BY 1, 2, 3)")


def kl_steps(n: int, lam: float = 0.0) -> str:
    """The updates of H and then W, written out ``n`` times, with an optional graph term."""
    out = [START]
    for i in range(n):
        w, h, h1 = f"w{i}", f"h{i}", f"h{i + 1}"
        out += [_fitted_cells(f"wh{i}", w, h),
                f"num{i} AS (SELECT term_id, k, sum(cnt / wh * w) AS num FROM wh{i} JOIN {w} USING (doc_id) GROUP BY 1, 2)",
                f"den{i} AS (SELECT k, sum(w) AS den FROM {w} GROUP BY 1)"]
        top, bottom, pulled = "coalesce(num, 0)", "den", ""
        if lam:
            out.append(f"ha{i} AS (SELECT src AS term_id, k, sum(weight * h) AS ha, sum(weight) AS deg FROM syntax JOIN {h} ON dst = {h}.term_id GROUP BY 1, 2)")
            top, bottom = f"({top} + {lam} * coalesce(ha, 0))", f"(den + {lam} * h * coalesce(deg, 0))"
            pulled = f" LEFT JOIN ha{i} USING (term_id, k)"
        out += [f"{h1} AS MATERIALIZED (SELECT term_id, k, h * {top} / ({bottom} + 1e-10) AS h FROM {h} LEFT JOIN num{i} USING (term_id, k) JOIN den{i} USING (k){pulled})",
                _fitted_cells(f"vh{i}", w, h1),
                f"""w{i + 1} AS MATERIALIZED (SELECT doc_id, k, w * n / (s + 1e-10) AS w FROM {w} JOIN (SELECT doc_id, k, sum(cnt / wh * h) AS n FROM vh{i} JOIN {h1} USING (term_id) GROUP BY 1, 2) USING (doc_id, k)
  JOIN (SELECT k, sum(h) AS s FROM {h1} GROUP BY 1) USING (k))"""]
    return ",\n".join(out)


def frobenius_steps(n: int) -> str:
    out = [START]
    for i in range(n):
        w, h, h1 = f"w{i}", f"h{i}", f"h{i + 1}"
        out += [f"fn{i} AS (SELECT term_id, k, sum(cnt * w) AS num FROM bow JOIN {w} USING (doc_id) GROUP BY 1, 2)",
                f"gw{i} AS (SELECT a.k AS k, b.k AS j, sum(a.w * b.w) AS g FROM {w} a JOIN {w} b USING (doc_id) GROUP BY 1, 2)",
                f"fd{i} AS (SELECT term_id, gw{i}.k AS k, sum(g * h) AS den FROM gw{i} JOIN {h} ON j = {h}.k GROUP BY 1, 2)",
                f"{h1} AS MATERIALIZED (SELECT term_id, k, h * coalesce(num, 0) / (den + 1e-10) AS h FROM {h} LEFT JOIN fn{i} USING (term_id, k) JOIN fd{i} USING (term_id, k))",
                f"gh{i} AS (SELECT a.k AS k, b.k AS j, sum(a.h * b.h) AS g FROM {h1} a JOIN {h1} b USING (term_id) GROUP BY 1, 2)",
                f"wd{i} AS (SELECT doc_id, gh{i}.k AS k, sum(g * w) AS den FROM gh{i} JOIN {w} ON j = {w}.k GROUP BY 1, 2)",
                f"wn{i} AS (SELECT doc_id, k, sum(cnt * h) AS num FROM bow JOIN {h1} USING (term_id) GROUP BY 1, 2)",
                f"w{i + 1} AS MATERIALIZED (SELECT doc_id, k, w * num / (den + 1e-10) AS w FROM {w} JOIN wn{i} USING (doc_id, k) JOIN wd{i} USING (doc_id, k))"]
    return ",\n".join(out)


SCALED = """hs AS (SELECT k, sum(h) AS s FROM h{n} GROUP BY 1),
phi_n AS (SELECT term_id, k, h / s AS value FROM h{n} JOIN hs USING (k)),
theta_n AS (SELECT doc_id, k, w * s / sum(w * s) OVER (PARTITION BY doc_id) AS value FROM w{n} JOIN hs USING (k))""".format(n=STEPS)
BOTH = "SELECT doc_id AS id, 'w' AS factor, CAST(k AS INTEGER) AS k, value FROM theta_n UNION ALL SELECT term_id, 'h', CAST(k AS INTEGER), value FROM phi_n"
PENALTY = "0.1 * (SELECT sum(weight * (a.h * a.h - a.h * b.h)) FROM syntax JOIN h{i} a ON src = a.term_id JOIN h{i} b ON dst = b.term_id AND a.k = b.k)"


def objective_sql(i: int, penalty: bool) -> str:
    """The objective at the factors after ``i`` updates."""
    value = (f"(SELECT sum(cnt * (ln(cnt::DOUBLE) - ln(wh)) - cnt) FROM ob{i}) + (SELECT sum(a.s * b.s) FROM (SELECT k, sum(w) AS s FROM w{i} GROUP BY 1) a "
             f"JOIN (SELECT k, sum(h) AS s FROM h{i} GROUP BY 1) b USING (k))")
    return value + (" + " + PENALTY.format(i=i) if penalty else "")


def started(d, **how):
    """The solver itself, from given factors, for a few updates."""
    h0 = np.zeros((K, d.n_terms))
    for r in start_h(d).collect():          # K numbers for each term of a bounded vocabulary
        h0[:, r["term_id"]] = r["h"]
    return nmf.fit(d.rows, d.n_terms, K, max_iter=STEPS, tol=0.0, start=(start_w(d), h0), **how)


def _factors(fit):
    w = fit.theta.select(F.col("doc_id").alias("id"), F.lit("w").alias("factor"), F.posexplode("w").alias("k", "value"))
    h = fit.phi.select(F.col("term_id").cast("bigint").alias("id"), F.lit("h").alias("factor"), F.posexplode("h").alias("k", "value"))
    return w.unionByName(h)


@query("nmf_init")
def nmf_init(d):
    start, ht = nmf.init_factors(d.rows.withColumn("dw", F.lit(1.0)), K, d.n_terms)
    if not (np.isfinite(ht).all() and (ht >= 0).all()):
        raise RuntimeError("initial topics must be finite and non-negative")
    return start.select("doc_id", F.posexplode("w").alias("topic", "weight"))


@query("nmf_kl", sql("bow vocab", BOTH, "value", extra=kl_steps(STEPS) + ",\n" + SCALED))
def nmf_kl(d):
    return _factors(started(d))


@query("nmf_frobenius", sql("bow vocab", BOTH, "value", extra=frobenius_steps(STEPS) + ",\n" + SCALED))
def nmf_frobenius(d):
    return _factors(started(d, divergence="frobenius"))


@query("nmf_graph_term", sql("bow vocab syntax", BOTH, "value", extra=kl_steps(STEPS, 0.1) + ",\n" + SCALED))
def nmf_graph_term(d):
    return _factors(started(d, graphs=[(syntax_arrays(d), 0.1)]))


@query("nmf_objective", sql("bow vocab syntax", f"SELECT round({objective_sql(STEPS, True)}, 2) AS objective", "objective",
                            extra=kl_steps(STEPS, 0.1) + ",\n" + _fitted_cells(f"ob{STEPS}", f"w{STEPS}", f"h{STEPS}")))
def nmf_objective(d):
    value = started(d, graphs=[(syntax_arrays(d), 0.1)]).objective
    return d.spark.createDataFrame([(round(value, 2),)], "objective double")


@query("nmf_stop", sql("bow vocab", " UNION ALL ".join(f"SELECT {i} AS iter, round({objective_sql(i, False)}, 2) AS objective" for i in range(1, STEPS + 1)), "objective",
                       extra=",\n".join([kl_steps(STEPS), *[_fitted_cells(f"ob{i}", f"w{i}", f"h{i}") for i in range(1, STEPS + 1)]])))
def nmf_stop(d):
    return started(d).history_table().withColumn("objective", F.round("objective", 2))


@query("nmf_rescale", sql("bow vocab", """SELECT 'phi' AS factor, CAST(k AS BIGINT) AS id, sum(value) AS total, max(value) AS peak FROM phi_n GROUP BY k
UNION ALL SELECT 'theta', doc_id, sum(value), max(value) FROM theta_n GROUP BY doc_id""", "total peak", extra=kl_steps(STEPS) + ",\n" + SCALED))
def nmf_rescale(d):
    rows = _factors(started(d))
    key = F.when(F.col("factor") == "h", F.col("k").cast("bigint")).otherwise(F.col("id"))
    return rows.groupBy(F.when(F.col("factor") == "h", "phi").otherwise("theta").alias("factor"), key.alias("id")).agg(
        F.sum("value").alias("total"), F.max("value").alias("peak"))


@query("nmf_fit")
def nmf_fit(d):
    cfg = TopicConfig(num_topics=K, max_features=MAX_FEATURES, max_iter=ITER, vector_backend="ppmi_svd")
    model = fits.fit(d.documents.select("doc_id"), d.tokens, cfg)
    return model.topic_info()


def _parsed(d):
    return fits.Parsed(d.documents.select("doc_id"), d.vocab, d.n_terms, d.n_docs, d.bow, d.rows, d.lists,
                       d.triples, d.vpairs)


@query("nmf_ablation")
def nmf_ablation(d):
    rows, names = [], ("graph", "plain")
    found = nmf.fit_many(d.rows, d.n_terms, [nmf.Job(K, graphs=[(syntax_arrays(d), lam)], max_iter=ITER) for lam in (0.1, 0.0)])
    for name, res in zip(names, found):
        phi = res.phi_long(d.vocab)
        row = fits.summary(settle(reports.top_words(phi, 10)), _parsed(d), phi).first()
        rows.append((name, *[row[m] for m in grid.METRICS]))
    return d.spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in grid.METRICS))


@query("nmf_fold_in")
def nmf_fold_in(d):
    return nmf.fold_in(d.rows, fitted(d).matrix()).select("doc_id", F.posexplode("w").alias("topic", "weight"))


@query("nmf_fold_in_stream")
def nmf_fold_in_stream(d):
    """The documents, read as a stream and scored against the fit, batch by batch."""
    scored = foldin.fold_in_stream(d.spark, f"{d.sf_dir}/documents.parquet", d.vocab, fitted(d).matrix(), ENG)
    return scored.select("doc_id", F.posexplode("w").alias("topic", "weight"))


@query("nmf_perplexity")
def nmf_perplexity(d):
    h = fitted(d).matrix()
    value = nmf.perplexity(d.rows, nmf.fold_in(d.rows, h), h)
    return d.spark.createDataFrame([(value,)], "perplexity double")


@query("nmf_bootstrap")
def nmf_bootstrap(d):
    return nmf.bootstrap(d.rows, fitted(d), max_iter=ITER)


MATCH = """pk AS (SELECT topic, term_id, weight FROM phi),
cosines AS MATERIALIZED (SELECT i, j, sum(x * y) / (sqrt(max(nx)) * sqrt(max(ny))) AS c FROM (SELECT topic AS i, term_id, weight AS x, sum(weight * weight) OVER (PARTITION BY topic) AS nx FROM pk)
  JOIN (SELECT k AS j, term_id, h AS y, sum(h * h) OVER (PARTITION BY k) AS ny FROM h0) USING (term_id) GROUP BY 1, 2),
best AS (SELECT [a.j, b.j, c.j, d.j] AS js, [a.c, b.c, c.c, d.c] AS cs FROM cosines a, cosines b, cosines c, cosines d
  WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND len(list_distinct([a.j, b.j, c.j, d.j])) = 4 ORDER BY a.c + b.c + c.c + d.c DESC LIMIT 1)"""


@query("nmf_match", sql("bow vocab phi", "SELECT CAST(i AS INTEGER) AS topic, CAST(js[i + 1] AS INTEGER) AS matched, cs[i + 1] AS similarity FROM best, (SELECT unnest(range(4)) AS i)",
                        "similarity", extra=START + ",\n" + MATCH))
def nmf_match(d):
    """The topics of the corpus matched one to one with the starting topics."""
    cols, sims = nmf.match_topics(context.wide_rows(d.phi, "term_id", K, "h"), start_h(d), K)
    return d.spark.createDataFrame([(t, int(cols[t]), float(sims[t])) for t in range(K)],
                                   "topic int, matched int, similarity double")


@query("nmf_search_k")
def nmf_search_k(d):
    parsed, fits_of = _parsed(d), {}

    def prepare(ks):
        jobs = [nmf.Job(k, max_iter=ITER) for k in ks]
        fits_of.update(zip(ks, nmf.fit_many(d.rows, d.n_terms, jobs)))

    def score(k):
        phi = fits_of[k].phi_long(d.vocab)
        row = fits.summary(settle(reports.top_words(phi, 10)), parsed, phi).first()
        return row["npmi"], row["diversity"]

    best, out = grid.search_k(score, (2, 4, 6, 8), finetune=True, prepare=prepare)
    return d.spark.createDataFrame([(k, r["npmi"], r["div"], r["score"], k == best, r["error"]) for k, r in sorted(out.items())],
                                   "k int, npmi double, diversity double, score double, best boolean, error string")


@query("lda_fit")
def lda_fit(d):
    words, _ = classify.lda(d.rows, d.vocab, d.n_terms, K)
    return words


@query("lda_bigrams")
def lda_bigrams(d):
    """The baseline on word lists in which collocations are joined."""
    counts = settle(V.token_counts(settle(joined_lists(d))))
    vocab = settle(V.build_vocab(counts, MIN_DF, MAX_FEATURES))
    words, _ = classify.lda(V.doc_rows(V.bow(counts, vocab, MAX_FEATURES)), vocab, vocab.count(), K)
    return words


@query("kmeans_init")
def kmeans_init(d):
    """The centres, and how near the words are to the best of them on average."""
    centres = settle(context.kmeans_centres(d.word_vectors, K), "centres")
    topics = [(r["topic"], r["vec"]) for r in centres.orderBy("topic").collect()]
    near = context.mean_best_similarity(d.word_vectors, topics).first()[0]
    return centres.select("topic", F.posexplode("vec").alias("i", "x"), F.lit(near).cast("double").alias("mean_best_similarity"))


# -- contextual operators ----------------------------------------------------------

@query("ctx_collect", sql("bow demb", "SELECT term_id, doc_id FROM ctx", extra=CTX))
def ctx_collect(d):
    return context.collect_contexts(d.bow, d.embeddings).select("term_id", "doc_id")


TVX = "tl AS (SELECT topic, unnest(vec) AS t, generate_subscripts(vec, 1) AS i FROM tv)"
CTXB = """cx AS (SELECT term_id, doc_id, topic, list_dot_product(c.vec, tv.vec) AS z, c.vec AS vec, tv.vec AS tvec FROM ctx c, tv),
ca AS (SELECT *, exp(z - max(z) OVER (PARTITION BY term_id, topic)) AS a FROM cx),
cu AS (SELECT term_id, topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS i, a, tvec FROM ca),
cp AS (SELECT term_id, topic, i, sum(a * x) AS x, any_value(tvec[i]) AS t FROM cu GROUP BY 1, 2, 3),
sims AS (SELECT term_id, topic, sum(x * t) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(t * t)), 1e-8)) AS sim FROM cp GROUP BY 1, 2
  UNION ALL SELECT term_id, topic, list_cosine_similarity(wv.vec, tv.vec) FROM wv, tv WHERE term_id NOT IN (SELECT term_id FROM ctx))"""
BETA = """eb AS (SELECT topic, term_id, exp(sim / 0.1 - max(sim / 0.1) OVER (PARTITION BY topic)) AS e FROM sims),
sbeta AS (SELECT topic, term_id, e / sum(e) OVER (PARTITION BY topic) AS weight FROM eb)"""
STATIC = "sims AS (SELECT topic, term_id, list_cosine_similarity(wv.vec, tv.vec) AS sim FROM wv, tv)"


@query("ctx_beta", sql("bow demb tv wv", "SELECT topic, term_id, weight FROM sbeta", "weight", extra=",\n".join([CTX, CTXB, BETA])))
def ctx_beta(d):
    pairs = context.context_pairs(d.bow, d.embeddings)
    return context.contextual_beta(d.topic_list, pairs, d.embeddings, d.word_vectors, DIM)


@query("beta_static", sql("tv wv", "SELECT topic, term_id, weight FROM sbeta", "weight", extra=STATIC + ",\n" + BETA))
def beta_static(d):
    return context.static_beta(d.topic_list, d.word_vectors)


@query("theta_words", sql("bow theta phi", """SELECT doc_id, term_id, sum(t.weight * p.weight) AS p FROM bow JOIN theta t USING (doc_id)
JOIN phi p USING (topic, term_id) GROUP BY 1, 2""", "p"))
def theta_words(d):
    return context.expected_at(d.bow, d.theta, d.phi, TOPICS, MAX_FEATURES)


@query("emb_refine", sql("demb dom tv", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM (
  SELECT doc_id, i, 0.7 * e.vec[i] + 0.3 * tv.vec[i] AS x FROM demb e JOIN dom USING (doc_id) JOIN tv USING (topic), (SELECT unnest(range(1, 65)) AS i))""", "x"))
def emb_refine(d):
    return context.refine(d.embeddings, d.dominant, d.topic_vectors, TOPICS, 0.3).select(
        "doc_id", F.posexplode("vec").alias("i", "x"))


def posterior(d):
    mu = F.array(*[((F.col("doc_id") * 31 + k * 17) % 13) / F.lit(4.0) for k in range(K)])
    lv = F.array(*[((F.col("doc_id") * 7 + k * 5) % 11) / F.lit(2.0) - 6.0 for k in range(K)])
    return d.documents.select("doc_id", mu.alias("mu"), lv.alias("logvar"))


_Z = ", ".join(f"""((doc_id * 31 + {k} * 17) % 13) / 4.0::DOUBLE + exp((((doc_id * 7 + {k} * 5) % 11) / 2.0::DOUBLE - 6.0) * 0.5) *
  sqrt(-2.0 * ln(1.0 - {u01("'0a'", 'doc_id', 's', k)})) * cos(2.0 * pi() * {u01("'0b'", 'doc_id', 's', k)}) AS z{k}""" for k in range(K))
MC = f"""zz AS (SELECT doc_id, s, {_Z} FROM documents, (SELECT unnest(range(1, 11)) AS s)),
ze AS (SELECT doc_id, s, {', '.join(f'exp(z{k} - greatest(z0, z1, z2, z3)) AS e{k}' for k in range(K))} FROM zz),
mc AS ({' UNION ALL '.join(f'SELECT doc_id, {k} AS topic, avg(e{k} / (e0 + e1 + e2 + e3)) AS mean, stddev_samp(e{k} / (e0 + e1 + e2 + e3)) AS sd FROM ze GROUP BY 1' for k in range(K))})"""


@query("theta_mc", sql("", "SELECT doc_id, topic, mean, sd FROM mc", "mean sd", extra=MC))
def theta_mc(d):
    return context.posterior_draws(posterior(d), 10, K)


@query("theta_regimes", sql("", """SELECT regime, count(*) AS n, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM (SELECT CASE WHEN std < 0.02 THEN 'CERTAIN'
  WHEN std > 0.08 AND ent > 0.6 * ln(4.0) THEN 'AMBIGUOUS' WHEN std > 0.08 THEN 'POORLY_ENCODED' ELSE 'MODERATE' END AS regime FROM (
    SELECT doc_id, avg(sd) AS std, -sum(mean * ln(mean + 1e-10)) AS ent FROM mc GROUP BY 1)) GROUP BY 1""", "share", extra=MC))
def theta_regimes(d):
    draws = context.posterior_draws(posterior(d), 10, K)
    return context.regime_counts(context.uncertainty_regimes(draws, K))


# -- covariates and time -----------------------------------------------------------

@query("cov_encode", sql("", """SELECT doc_id, lang AS level, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS pos,
  (n_chars - avg(n_chars) OVER ()) / (stddev_pop(n_chars) OVER () + 1e-10) AS z FROM documents""", "z"))
def cov_encode(d):
    return covariates.encode_text(d.documents, "lang").join(covariates.encode_number(d.documents, "n_chars"), "doc_id")


@query("cov_effect_boot")
def cov_effect_boot(d):
    z = covariates.encode_number(d.documents, "n_chars").join(
        d.documents.select("doc_id", (F.col("lang") == "en").cast("double").alias("english")), "doc_id")
    return covariates.effect_bootstrap(d.theta_rows, z, ["z", "english"], K)


@query("cov_effect_ols", sql("theta", """SELECT topic, regr_slope(weight, z) AS coef, regr_r2(weight, z) AS r2,
  sqrt(regr_syy(weight, z) * (1 - regr_r2(weight, z)) / ((count(*) - 2) * regr_sxx(weight, z))) AS se
FROM theta JOIN (SELECT doc_id, (n_chars - avg(n_chars) OVER ()) / (stddev_pop(n_chars) OVER () + 1e-10) AS z FROM documents) USING (doc_id) GROUP BY 1""", "coef r2 se"))
def cov_effect_ols(d):
    return covariates.effect_ols(d.theta, covariates.encode_number(d.documents, "n_chars")).select("topic", "coef", "r2", "se")


SLICES = """edges AS (SELECT unnest(quantile_cont(ts, [0.2, 0.4, 0.6, 0.8])) AS e FROM times),
sl AS (SELECT doc_id, CAST(count(e) AS INTEGER) AS slice FROM times LEFT JOIN edges ON ts > e GROUP BY 1)"""


@query("time_slices", sql("times", "SELECT doc_id, slice FROM sl", extra=SLICES))
def time_slices(d):
    return temporal.slices(d.times, 5).select("doc_id", "slice")


@query("time_prevalence", sql("times theta", """SELECT slice, topic + 1 AS topic, n, mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT slice, topic, sum(w * weight) / sum(w) AS m FROM bt GROUP BY slice, topic, b) JOIN (
  SELECT slice, topic, count(*) AS n, avg(weight) AS mean FROM sl JOIN theta USING (doc_id) GROUP BY 1, 2) USING (slice, topic) GROUP BY 1, 2, 3, 4""",
                              "mean ci_low ci_high", extra=SLICES + f""",
bt AS (SELECT slice, topic, b, weight, w FROM {replicates_sql('times', 'doc_id', 200)} JOIN sl USING (doc_id) JOIN theta USING (doc_id))"""))
def time_prevalence(d):
    return temporal.prevalence(d.theta, temporal.slices(d.times, 5))


@query("time_drift")
def time_drift(d):
    return temporal.drift(d.rows, temporal.slices(d.times, 3), d.n_terms, K, max_iter=ITER)


# -- grids -------------------------------------------------------------------------

@query("grid_expand", sql("runs", "SELECT corpus, model, CAST(seed AS INTEGER) AS seed, k FROM (SELECT DISTINCT corpus FROM runs), (SELECT DISTINCT model FROM runs), (SELECT DISTINCT seed FROM runs), (SELECT DISTINCT k FROM runs)"))
def grid_expand(d):
    got = [sorted(r[0] for r in d.runs.select(c).distinct().collect()) for c in ("corpus", "model", "seed", "k")]
    return grid.expand(d.spark, *got)


def _cfg(**kw):
    return TopicConfig(num_topics=K, max_features=MAX_FEATURES, max_iter=ITER, lambda_embed=0.0, vector_backend="none", **kw)


@query("grid_fit")
def grid_fit(d):
    path = stage_path(d.spark, "grid")
    specs = [grid.ModelSpec("graph", _cfg()), grid.ModelSpec("permuted", _cfg(), control="permute")]
    corpora = {"documents": (d.documents.select("doc_id"), d.tokens, d.lists)}
    return grid.run(d.spark, corpora, specs, (0,), (K,), path)


@query("grid_modes")
def grid_modes(d):
    return grid.graph_modes(d.documents.select("doc_id"), d.tokens, _cfg())


# -- reports -----------------------------------------------------------------------

HIDE = ("les", "the", "der", "los", "des")


@query("rep_top_words", sql("phi", f"""SELECT topic, CAST(rank AS INTEGER) AS rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic
  ORDER BY weight DESC, term) AS rank FROM phi WHERE term NOT IN {HIDE}) WHERE rank <= 10""", "weight"))
def rep_top_words(d):
    return reports.top_words(d.phi, 10, HIDE)


@query("rep_top_ctfidf", sql("bow dom", """SELECT topic, CAST(rank AS INTEGER) AS rank, term, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic
  ORDER BY w DESC, term) AS rank FROM (SELECT topic, term, round(weight, 12) AS w FROM ctf)) WHERE rank <= 10""", "weight", extra=CTFIDF))
def rep_top_ctfidf(d):
    scores = V.ctfidf(d.bow, d.dominant, TOPICS).withColumn("weight", F.round("weight", 12))
    return reports.ranked(scores, 10).select("topic", "rank", "term", "weight")


@query("rep_top_cosine", sql("tv wv wvx triples", """SELECT 'word' AS kind, topic, CAST(rank AS INTEGER) AS rank, term AS item, '' AS relation, sim FROM (SELECT topic, term, list_cosine_similarity(wv.vec, tv.vec) AS sim,
  row_number() OVER (PARTITION BY topic ORDER BY list_cosine_similarity(wv.vec, tv.vec) DESC, term) AS rank FROM wv, tv) WHERE rank <= 5
UNION ALL SELECT 'phrase', topic, CAST(rank AS INTEGER), phrase, relation, sim FROM (SELECT topic, phrase, relation, list_cosine_similarity(pv.vec, tv.vec) AS sim,
  row_number() OVER (PARTITION BY topic ORDER BY list_cosine_similarity(pv.vec, tv.vec) DESC, phrase) AS rank FROM pv, tv) WHERE rank <= 5""", "sim", extra="""
pv AS (SELECT head || ' ' || dependent AS phrase, relation, list((a.x + b.x) / 2 ORDER BY a.i) AS vec FROM triples JOIN wvx a ON head = a.term
  JOIN wvx b ON dependent = b.term AND a.i = b.i WHERE cnt >= 5 GROUP BY 1, 2)"""))
def rep_top_cosine(d):
    phrases = vectors.phrase_vectors(d.triples, d.word_vectors, MAX_FEATURES)
    a = reports.cosine_ranked(d.topic_list, d.word_vectors.select("term", "vec"), "term", 5)
    b = reports.cosine_ranked(d.topic_list, phrases, "phrase", 5, keep=["relation"])
    return a.select(F.lit("word").alias("kind"), "topic", "rank", F.col("term").alias("item"), F.lit("").alias("relation"), "sim").unionByName(
        b.select(F.lit("phrase").alias("kind"), "topic", "rank", F.col("phrase").alias("item"), "relation", "sim"))


@query("rep_mwe", sql("mwes", "SELECT topic, rank, phrase, relation, score, cnt, in_topic FROM mwes", "score"))
def rep_mwe(d):
    return d.mwes


@query("rep_mwe_counts", sql("mwes", "SELECT topic, count(*) AS n_mwes FROM mwes GROUP BY 1"))
def rep_mwe_counts(d):
    return reports.mwe_counts(d.mwes)


LABELS = """tw3 AS (SELECT topic, list(term ORDER BY rank) AS w FROM words WHERE rank <= 3 GROUP BY 1),
p1 AS (SELECT topic, [phrase] AS p FROM mwes WHERE rank = 1),
lab AS (SELECT topic, array_to_string(list_slice(list_concat(coalesce(p, []), w), 1, 3), ', ') AS label FROM tw3 LEFT JOIN p1 USING (topic))"""


@query("rep_labels", sql("words mwes", "SELECT topic, label FROM lab", extra=LABELS))
def rep_labels(d):
    return reports.labels(d.words, d.mwes)


@query("rep_topic_info", sql("words mwes dom", """SELECT topic + 1 AS topic_id, (SELECT count(*) FROM dom x WHERE x.topic = l.topic) AS size, label, top_words, coalesce(m, '') AS mwes
FROM lab l JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS top_words FROM words GROUP BY 1) USING (topic)
LEFT JOIN (SELECT topic, string_agg(phrase, ', ' ORDER BY rank) AS m FROM mwes WHERE rank <= 3 GROUP BY 1) USING (topic)""", extra=LABELS))
def rep_topic_info(d):
    return reports.topic_info(d.dominant, d.words, d.mwes, TOPICS)


@query("rep_doc_topics", sql("dom", """SELECT doc_id, topic + 1 AS dominant_topic, round(weight, 3) AS dominant_prob,
  CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text_preview FROM dom JOIN documents USING (doc_id)""", "dominant_prob"))
def rep_doc_topics(d):
    return reports.document_topics(d.dominant, d.documents)


@query("rep_rake", sql("theta", f"""SELECT topic, CAST(rank AS INTEGER) AS rank, phrase, score FROM (SELECT topic, phrase, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, phrase) AS rank FROM tot) WHERE rank <= 10""", "score", extra=f"""
best AS (SELECT topic, doc_id FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS r FROM theta) WHERE r <= 30),
pieces AS (SELECT topic, trim(p) AS phrase FROM (SELECT topic, unnest(string_split(array_to_string(list_transform(
  regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+|[^\\s\\x0b\\p{{L}}\\p{{N}}_'']'), lambda z: CASE WHEN list_contains({STOPS}, z) OR NOT regexp_full_match(z, '[\\p{{L}}\\p{{N}}_'']+') THEN '|' ELSE z END), ' '), '|')) AS p
  FROM best JOIN documents USING (doc_id)) WHERE trim(p) <> '' AND len(string_split(trim(p), ' ')) <= 4),
pw AS (SELECT topic, phrase, unnest(string_split(phrase, ' ')) AS w, len(string_split(phrase, ' ')) AS l FROM pieces),
ws AS (SELECT topic, w, sum(l) / count(*)::DOUBLE AS s FROM pw GROUP BY 1, 2),
tot AS (SELECT topic, phrase, round(sum(s), 9) AS score FROM (SELECT topic, phrase, unnest(string_split(phrase, ' ')) AS w FROM (SELECT DISTINCT topic, phrase FROM pieces)) JOIN ws USING (topic, w) GROUP BY 1, 2)"""))
def rep_rake(d):
    return reports.rake(d.documents, d.theta, ENG)


@query("rep_generic_mwe", sql("dom", f"""SELECT topic, kind, CAST(rank AS INTEGER) AS rank, replace(term, '_', ' ') AS term FROM (SELECT *, row_number() OVER (PARTITION BY topic, kind ORDER BY w DESC, term) AS rank FROM (
  SELECT topic, term, CASE WHEN contains(term, '_') THEN 'phrase' ELSE 'single' END AS kind, round(n / greatest(sum(n) OVER (PARTITION BY topic), 1)::DOUBLE * ln(1 + 4 / (count(*) OVER (PARTITION BY term))::DOUBLE), 12) AS w FROM gcls)
  WHERE len(list_filter(string_split(term, '_'), lambda z: list_contains({STOPS}, z))) = 0) WHERE rank <= 10""",
                              extra=BIGRAMS + ",\n" + PHRASES + ",\n" + JOINED + """,
gc AS (SELECT doc_id, term, count(*) AS cnt FROM jt WHERE NOT eaten GROUP BY 1, 2),
gv AS (SELECT term FROM gc GROUP BY 1 HAVING count(*) >= 5),
gcls AS (SELECT topic, term, CAST(sum(cnt) AS BIGINT) AS n FROM gc JOIN gv USING (term) JOIN dom USING (doc_id) GROUP BY 1, 2)"""))
def rep_generic_mwe(d):
    counts = settle(V.token_counts(settle(joined_lists(d))))
    vocab = V.build_vocab(counts, MIN_DF, MAX_FEATURES)
    bow = V.bow(counts, vocab, MAX_FEATURES)
    scores = V.ctfidf(bow, d.dominant, TOPICS).withColumn("weight", F.round("weight", 12))
    return reports.generic_mwes(scores, ENG)


@query("rep_mwe_features", sql("mwes", "SELECT doc_id, phrase FROM documents JOIN (SELECT DISTINCT phrase FROM mwes) ON contains(lower(text), phrase)"))
def rep_mwe_features(d):
    return reports.phrase_features(d.documents, d.mwes)


@query("rep_topic_points")
def rep_topic_points(d):
    return reports.topic_points(vectors.pca_reducer(d.embeddings), d.dominant)


@query("rep_all_words", sql("words bow dom", """SELECT 'beta' AS model, topic, rank, term FROM words UNION ALL SELECT 'ctfidf', topic, CAST(rank AS INTEGER), term FROM (
  SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rank FROM ctf) WHERE rank <= 10""", extra=CTFIDF))
def rep_all_words(d):
    scores = V.ctfidf(d.bow, d.dominant, TOPICS).withColumn("weight", F.round("weight", 12))
    return reports.all_words({"beta": d.words, "ctfidf": reports.ranked(scores, 10)})
