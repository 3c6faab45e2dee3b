"""Topic quality metrics. A topic with fewer than two known words is skipped.

Undefined values are NULL. Every metric is a one-row DataFrame named after it, unless
the docstring says per topic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded, vec
from ..functions import text as T
from ..session import bounded, collect_bounded, settle
from . import cooc
from .reports import ranked

EPS = 1e-10


def _pairs(topic_words: DataFrame) -> DataFrame:
    """``(topic, r1, t1, r2, t2)`` with ``r1 < r2``; a topic lists at most top_k words."""
    a = topic_words.select("topic", F.col("rank").alias("r1"), F.col("term_id").alias("t1"))
    b = topic_words.select("topic", F.col("rank").alias("r2"), F.col("term_id").alias("t2"))
    return a.join(b, "topic").where(F.col("r1") < F.col("r2"))


def known_words(topic_words: DataFrame, vocab: DataFrame, top_k: int, bound: int | None) -> DataFrame:
    """Top words inside the vocabulary with ``term_id`` and ``df``; topics of one word go."""
    rows = topic_words.where(F.col("rank") <= top_k).join(
        bounded(vocab.select("term", "term_id", "df"), bound), "term")
    n = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n.where(F.col("n") >= 2).select("topic"), "topic")


def scored_pairs(topic_words: DataFrame, docs: DataFrame, vocab: DataFrame, top_k: int = 10,
                 bound: int | None = None) -> DataFrame:
    """Topic word pairs with document frequencies ``d1``, ``d2`` and co-frequency ``co``.

    Documents are first reduced to the scored words, so a long document adds only the
    pairs among them.
    """
    rows = settle(known_words(topic_words, vocab, top_k, bound))
    wanted = sorted({r["term_id"] for r in collect_bounded(rows.select("term_id").distinct())})
    few = docs.select(F.filter("ids", lambda i: i.isin(wanted)).alias("ids"))
    co = cooc.pair_counts(few).select(F.col("src").alias("lo"), F.col("dst").alias("hi"),
                                      F.col("cnt").alias("co"))
    df = rows.select("term_id", "df").distinct()
    return (
        _pairs(rows)
        .withColumn("lo", F.least("t1", "t2")).withColumn("hi", F.greatest("t1", "t2"))
        .join(co, ["lo", "hi"], "left")
        .join(df.select(F.col("term_id").alias("t1"), F.col("df").alias("d1")), "t1")
        .join(df.select(F.col("term_id").alias("t2"), F.col("df").alias("d2")), "t2")
        .select("topic", "r1", "r2", "t1", "t2", "d1", "d2", F.coalesce("co", F.lit(0)).alias("co"))
    )


def _mean_of_topics(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy("topic").agg(F.avg(value).alias("v")).agg(F.avg("v").alias(name))


def npmi(pairs: DataFrame, n_docs: int) -> DataFrame:
    """Mean document NPMI; a pair that never meets is -1, one that is everywhere 0."""
    n = F.lit(float(n_docs))
    p = F.col("co") / n
    value = (
        F.when(F.col("co") <= 0, -1.0).when(F.col("co") == n, 0.0)
        .otherwise(F.log(p / ((F.col("d1") / n) * (F.col("d2") / n))) / -F.log(p)))
    return _mean_of_topics(pairs, value, "npmi")


def npmi_smoothed(pairs: DataFrame, n_docs: int, eps: float = EPS) -> DataFrame:
    """The variant that adds ``eps`` to all three probabilities; 0 without a topic."""
    n = F.lit(float(n_docs))
    p, a, b = F.col("co") / n + eps, F.col("d1") / n + eps, F.col("d2") / n + eps
    out = _mean_of_topics(pairs, F.log(p / (a * b)) / -F.log(p), "npmi_eps")
    return out.select(F.coalesce("npmi_eps", F.lit(0.0)).alias("npmi_eps"))


def umass(pairs: DataFrame) -> DataFrame:
    """Per topic: mean of ``ln((co + 1) / (df of the higher ranked word + 1))``."""
    value = F.log((F.col("co") + 1.0) / (F.col("d1") + 1.0))
    return pairs.groupBy("topic").agg(F.avg(value).alias("umass"))


def diversity(topic_words: DataFrame, empty: float | None = None) -> DataFrame:
    """Distinct over total listed words."""
    total = F.count("term")
    return topic_words.agg(
        F.when(total > 0, F.count_distinct("term") / total).otherwise(F.lit(empty).cast("double"))
        .alias("diversity"))


def exclusivity_per_topic(phi: DataFrame, topic_words: DataFrame, n_words: int) -> DataFrame:
    """Per topic: mean share of a word's mass that the topic holds, over its top words."""
    wanted = topic_words.select("topic", "term")
    terms = bounded(wanted.select("term").distinct(), n_words)
    near = phi.join(terms, "term")
    mass = near.groupBy("term").agg(F.sum("weight").alias("m"))
    share = F.when(F.col("m") == 0, 0.0).otherwise(F.col("weight") / F.col("m"))
    return (
        near.join(wanted, ["topic", "term"]).join(mass, "term")
        .groupBy("topic").agg(F.avg(share).alias("exclusivity"))
    )


def exclusivity(phi: DataFrame, topic_words: DataFrame, n_words: int) -> DataFrame:
    return exclusivity_per_topic(phi, topic_words, n_words).agg(
        F.avg("exclusivity").alias("exclusivity"))


def redundancy(topic_words: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard overlap of topic word sets; 0 with fewer than two topics.

    Only topics that share a word are joined; all other pairs add 0 to the mean.
    """
    tw = topic_words.select("topic", "term").distinct()
    sizes = tw.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    other = tw.select(F.col("topic").alias("o"), "term")
    shared = tw.join(other, "term").where(F.col("topic") < F.col("o")).groupBy("topic", "o").agg(
        F.count(F.lit(1)).alias("s"))
    k = sizes.count()
    n_pairs = k * (k - 1) / 2
    jac = shared.join(sizes, "topic").join(
        sizes.select(F.col("topic").alias("o"), F.col("n").alias("m")), "o").select(
        (F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("j"))
    return jac.agg((F.coalesce(F.sum("j"), F.lit(0.0)) / F.lit(max(n_pairs, 1.0))).alias("redundancy"))


def c_v(rows: DataFrame, marginals: DataFrame, cooc_rows: DataFrame, total: float,
        n_context: int = 10, bound: int | None = None) -> DataFrame:
    """C_V: cosine of each word's NPMI row with the summed row, over the context set.

    ``rows`` are known topic words, ``cooc_rows(src, dst, cnt)`` their co-occurrence
    rows, ``marginals(term_id, c)`` all row sums. Only the rows of scored words are
    built, never a V x V table.
    """
    left = bounded(marginals.select(F.col("term_id").alias("src"), F.col("c").alias("ci")), bound)
    right = bounded(marginals.select(F.col("term_id").alias("dst"), F.col("c").alias("cj")), bound)
    cells = settle(cooc_rows.join(left, "src").join(right, "dst").select(
        "src", "dst", cooc.npmi_expr(F.col("cnt").cast("double"), F.col("ci"), F.col("cj"),
                                     F.lit(float(total))).alias("v")))
    best = Window.partitionBy("src").orderBy(F.desc("v"), "dst")
    strong = cells.withColumn("r", F.row_number().over(best)).where(
        (F.col("r") <= n_context) & (F.col("v") > 0)).select("src", "dst")
    words = rows.select("topic", F.col("term_id").alias("src"))
    context = words.join(strong, "src").select("topic", "dst").distinct()
    block = settle(
        words.join(context, "topic").join(cells, ["src", "dst"], "left")
        .select("topic", "src", "dst", F.coalesce("v", F.lit(0.0)).alias("v")))
    summed = block.groupBy("topic", "dst").agg(F.sum("v").alias("s"))
    tn = summed.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("tn"))
    per_word = block.join(summed, ["topic", "dst"]).groupBy("topic", "src").agg(
        F.sum(F.col("v") * F.col("s")).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("wn"))
    value = F.when((F.col("wn") == 0) | (F.col("tn") == 0), 0.0).otherwise(
        F.col("d") / (F.col("wn") * F.col("tn")))
    return _mean_of_topics(per_word.join(tn, "topic"), value, "c_v")


def c_v_documents(topic_words: DataFrame, docs: DataFrame, vocab: DataFrame, top_k: int = 10,
                  n_context: int = 10, bound: int | None = None) -> DataFrame:
    """C_V with whole-document co-occurrence."""
    rows = settle(known_words(topic_words, vocab, top_k, bound))
    wanted = sorted({r["term_id"] for r in collect_bounded(rows.select("term_id").distinct())})
    marg = cooc.marginals(docs)
    total = float(marg.agg(F.sum("c")).first()[0] or 0)
    return c_v(rows, marg.withColumn("c", F.col("c").cast("double")),
               cooc.pair_counts(docs, wanted), total, n_context, bound)


def c_v_window(topic_words: DataFrame, seqs: DataFrame, vocab: DataFrame, top_k: int = 10,
               width: int = 10, n_context: int = 10, bound: int | None = None) -> DataFrame:
    """C_V with sliding-window co-occurrence over ``seqs(doc_id, seq)``; only the rows of
    scored words and the row sums are counted."""
    rows = settle(known_words(topic_words, vocab, top_k, bound))
    wanted = [r["term_id"] for r in collect_bounded(rows.select("term_id").distinct())]
    cells, marg = cooc.window_cells(seqs, width, wanted)
    total = float(marg.agg(F.sum("c")).first()[0] or 0)
    return c_v(rows, marg, cells, total, n_context, bound)


def window_coherence(topic_words: DataFrame, lists: DataFrame, width: int) -> dict[str, float | None]:
    """Window coherence over tokenised text: ``c_npmi`` (pair mean) and ``c_v`` (cosine).

    Bigrams are split, unknown words dropped and topics of fewer than two words left
    out. One pass counts a matrix that covers the listed words only.
    """
    listed: dict[int, list[str]] = {}
    for r in collect_bounded(topic_words.select("topic", "rank", "term").orderBy("topic", "rank")):
        listed.setdefault(r["topic"], []).extend(t for t in r["term"].split("_") if t)
    terms = sorted({t for ts in listed.values() for t in ts})
    n, windows = cooc.window_counts(lists, terms, width)
    pos = {t: i for i, t in enumerate(terms)}
    scores: dict[str, list[float]] = {"c_npmi": [], "c_v": []}
    for ts in listed.values():
        idx = [pos[t] for t in ts if n[pos[t], pos[t]] > 0]
        if len(idx) < 2:
            continue
        p = n[np.ix_(idx, idx)] / windows
        single = np.diag(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = np.log((p + 1e-12) / np.outer(single, single)) / -np.log(p + 1e-12)
        scores["c_npmi"].append(float(m[np.triu_indices(len(idx), 1)].mean()))
        total = m.sum(axis=0)
        scores["c_v"].append(float(np.mean(
            m @ total / (np.linalg.norm(m, axis=1) * np.linalg.norm(total)))))
    return {k: float(np.mean(v)) if v else None for k, v in scores.items()}


def cd_score(per_topic: DataFrame) -> DataFrame:
    """Mean length of min-max scaled (umass, exclusivity); a flat column counts as 0."""
    lo_hi = per_topic.agg(*[f(c).alias(f"{n}_{c}") for c in ("umass", "exclusivity")
                            for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(c):
        lo, hi = lo_hi[f"lo_{c}"], lo_hi[f"hi_{c}"]
        if lo is None or hi - lo < 1e-12:
            return F.lit(0.0)
        return (F.col(c) - lo) / F.lit(hi - lo)

    u, e = scaled("umass"), scaled("exclusivity")
    return per_topic.agg(F.avg(F.sqrt(u * u + e * e)).alias("cd_score"))


def js_divergence(dist: DataFrame, num_topics: int) -> DataFrame:
    """Mean pairwise Jensen-Shannon divergence (log 2) of topic rows ``dist``.

    The rows are turned into one array of K values per term, and each term adds its
    share to every topic pair inside the row.
    """
    ks = range(num_topics)
    wide = dist.groupBy("term").agg(*[
        F.coalesce(F.sum(F.when(F.col("topic") == k, F.col("weight"))), F.lit(0.0)).alias(f"p{k}")
        for k in ks])
    floor = F.lit(1e-12)

    def share(i, j):
        a, b = F.col(f"p{i}"), F.col(f"p{j}")
        m = F.greatest((a + b) * 0.5, floor)
        a, b = F.greatest(a, floor), F.greatest(b, floor)
        return 0.5 * a * F.log2(a / m) + 0.5 * b * F.log2(b / m)

    pairs = [(i, j) for i in ks for j in ks if i < j]
    sums = wide.agg(*[F.sum(share(i, j)).alias(f"d{i}_{j}") for i, j in pairs])
    mean = sum((F.col(f"d{i}_{j}") for i, j in pairs[1:]), F.col(f"d{pairs[0][0]}_{pairs[0][1]}"))
    return sums.select((mean / F.lit(float(len(pairs)))).alias("js_divergence"))


def pairwise_cosine(rows: DataFrame, key: str, dim: int, name: str, single: float | None = None) -> DataFrame:
    """Per ``key``: mean cosine over all pairs of its vectors, without building pairs.

    ``(|sum of unit vectors|^2 - sum of their squared lengths) / (n (n - 1))``.
    """
    u = rows.select(key, vec.unit(vec.doubles("vec")).alias("u"))
    g = u.groupBy(key).agg(vec.sum_arrays("u", dim).alias("s"),
                           F.sum(vec.dot("u", "u")).alias("q"), F.count(F.lit(1)).alias("n"))
    value = (vec.dot("s", "s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))
    return g.where(F.col("n") >= 2).select(key, value.alias(name))


def between_topic_cosine(topics: DataFrame, dim: int) -> DataFrame:
    """Mean pairwise cosine of topic vectors."""
    return pairwise_cosine(topics.withColumn("_g", F.lit(0)), "_g", dim, "between_topic_cosine").agg(
        F.max("between_topic_cosine").alias("between_topic_cosine"))


def we_coherence(topic_words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean pairwise cosine of the vectors of a topic's words; 0 without any topic."""
    rows = topic_words.join(vectors.select("term", "vec"), "term")
    return pairwise_cosine(rows, "topic", dim, "v").agg(
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("we_coherence"))


def intra_topic(dominant: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Mean cosine of documents to their topic's centroid, topics of two or more.

    A member's cosine to the normalised centroid averages to the centroid's length, so
    one aggregation is enough.
    """
    rows = dominant.select("doc_id", "topic").join(embeddings.select("doc_id", "vec"), "doc_id").select(
        "topic", vec.unit(vec.doubles("vec")).alias("u"))
    g = rows.groupBy("topic").agg(vec.sum_arrays("u", dim).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= 2).agg(F.avg(vec.norm("s") / F.col("n")).alias("intra_topic"))


def intra_tfidf(tfidf: DataFrame, dominant: DataFrame) -> DataFrame:
    """Mean pairwise TF-IDF cosine inside dominant topics, in time linear in the entries.

    Rows are unit length, so a topic's pair sum is ``|sum of rows|^2`` minus ``n``.
    """
    sizes = dominant.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    sums = tfidf.join(dominant.select("doc_id", "topic"), "doc_id").groupBy("topic", "term_id").agg(
        F.sum("weight").alias("s")).groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    value = (F.coalesce("q", F.lit(0.0)) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return sizes.where(F.col("n") >= 2).join(sums, "topic", "left").agg(F.avg(value).alias("intra_tfidf"))


def perplexity_at(cells: DataFrame) -> DataFrame:
    """``exp(-sum cnt ln p / sum cnt)`` over cells ``(cnt, p)``, p at least 1e-12."""
    ll = F.sum(F.col("cnt") * F.log(F.greatest("p", F.lit(1e-12))))
    return cells.agg(F.exp(-ll / F.sum("cnt")).alias("perplexity"))


def mwe_word_compactness(mwe: DataFrame, vectors: DataFrame, top_k: int = 10,
                         bound: int | None = None) -> DataFrame:
    """Mean cosine between the two words of each phrase."""
    parts = mwe.where(F.col("rank") <= top_k).select(
        F.split("phrase", " ", 2)[0].alias("a"), F.split("phrase", " ", 2)[1].alias("b"))
    v = vectors.select("term", vec.doubles("vec").alias("vec"))
    left = bounded(v.select(F.col("term").alias("a"), F.col("vec").alias("va")), bound)
    right = bounded(v.select(F.col("term").alias("b"), F.col("vec").alias("vb")), bound)
    return parts.join(left, "a").join(right, "b").agg(
        F.avg(vec.cosine("va", "vb")).alias("mwe_compactness"))


def mwe_topic_compactness(phrases: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean over topics of the mean cosine of phrase and topic vector."""
    rows = phrases.join(topics.select("topic", vec.doubles("vec").alias("tv")), "topic")
    return _mean_of_topics(rows, vec.cosine(vec.doubles("vec"), "tv"), "mwe_topic_compactness")


def mwe_specificity(phrases: DataFrame, df_table: DataFrame, n_docs: int) -> DataFrame:
    """Mean over phrases of the largest token ``ln(n / df)``; unknown tokens are left out."""
    toks = phrases.select("topic", "rank", F.explode(F.split(T.spaced("phrase"), " ")).alias("term"))
    best = toks.join(df_table, "term").groupBy("topic", "rank").agg(
        F.max(F.log(F.lit(float(n_docs)) / F.col("df"))).alias("s"))
    return best.agg(F.avg("s").alias("mwe_specificity"))


def mwe_complementarity(phrases: DataFrame, singles: DataFrame) -> DataFrame:
    """Mean over topics of ``1 - max cosine(phrase, a single word of the topic)``."""
    s = singles.select("topic", vec.doubles("vec").alias("sv"))
    best = phrases.select("topic", "phrase", vec.doubles("vec").alias("pv")).join(s, "topic").groupBy(
        "topic", "phrase").agg(F.max(vec.cosine("pv", "sv")).alias("m"))
    return _mean_of_topics(best, 1.0 - F.col("m"), "mwe_complementarity")


def content_ratio(phrases: DataFrame) -> DataFrame:
    """Mean over topics of the share of content-bearing phrases."""
    return _mean_of_topics(phrases, T.content_bearing("phrase").cast("double"), "mwe_content_ratio")


# -- valence and stance ------------------------------------------------------------

def compound(strings: DataFrame, lexicon: DataFrame, alpha: float = 15.0) -> DataFrame:
    """Adds ``score``: ``s / sqrt(s^2 + alpha)`` of the summed token valences."""
    keyed = strings.withColumn("_id", F.xxhash64(*strings.columns))
    rows = keyed.distinct()
    sums = (
        rows.select("_id", F.explode(F.split(F.lower(T.spaced("text")), " ")).alias("token"))
        .join(lexicon, "token").groupBy("_id").agg(F.sum("valence").alias("s"))
    )
    s = F.coalesce("s", F.lit(0.0))
    return keyed.join(sums, "_id", "left").withColumn("score", s / F.sqrt(s * s + alpha)).drop("_id", "s")


def valence(phrases: DataFrame, words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean absolute valence of phrases and of words, and the gap."""
    both = compound(phrases.select(F.lit("p").alias("kind"), F.col("phrase").alias("text")).unionByName(
        words.select(F.lit("w").alias("kind"), F.col("term").alias("text"))), lexicon)
    a = F.avg(F.when(F.col("kind") == "p", F.abs("score")))
    b = F.avg(F.when(F.col("kind") == "w", F.abs("score")))
    return both.agg(a.alias("mwe_valence"), b.alias("unigram_valence"), (a - b).alias("valence_gap"))


def signed_valence(strings: DataFrame, lexicons: DataFrame) -> DataFrame:
    """``(corpus, scorer, mwe, uni, gap, rank)``: signed means per corpus and scorer.

    ``strings(corpus, kind, text)`` with kind ``mwe`` or ``uni``; ``lexicons(scorer,
    token, valence)`` holds one named lexicon per scorer.
    """
    out = None
    for scorer in sorted(r[0] for r in collect_bounded(lexicons.select("scorer").distinct())):
        lex = lexicons.where(F.col("scorer") == scorer).select("token", "valence")
        part = compound(strings, lex).groupBy("corpus").agg(
            F.avg(F.when(F.col("kind") == "mwe", F.col("score"))).alias("mwe"),
            F.avg(F.when(F.col("kind") == "uni", F.col("score"))).alias("uni"))
        part = part.select("corpus", F.lit(scorer).alias("scorer"), "mwe", "uni")
        out = part if out is None else out.unionByName(part)
    gap = out.withColumn("gap", F.col("mwe") - F.col("uni"))
    return gap.withColumn("rank", F.row_number().over(
        Window.partitionBy("scorer").orderBy(F.desc("gap"), "corpus")))


def valence_vs_bigrams(mwe: DataFrame, bigrams: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean signed score of phrases minus that of the top PMI bigrams."""
    both = compound(mwe.select(F.lit("m").alias("kind"), F.col("phrase").alias("text")).unionByName(
        bigrams.select(F.lit("b").alias("kind"), F.concat_ws(" ", "w1", "w2").alias("text"))), lexicon)
    m = F.avg(F.when(F.col("kind") == "m", F.col("score")))
    b = F.avg(F.when(F.col("kind") == "b", F.col("score")))
    return both.agg(b.alias("pmi_mean"), m.alias("mwe_mean"), (m - b).alias("delta"))


def probability_valence(probs: DataFrame) -> DataFrame:
    """Mean intensity from class probabilities ``(item, label, p)``.

    ``1 - P(neutral)`` where a neutral class exists, else ``|P(positive) - P(negative)|``.
    """
    def of(name):
        return F.max(F.when(F.lower("label") == name, F.col("p")))

    per = probs.groupBy("item").agg(of("neutral").alias("n"), of("positive").alias("a"),
                                    of("negative").alias("b"))
    zero = F.lit(0.0)
    value = F.when(F.col("n").isNotNull(), 1.0 - F.col("n")).otherwise(
        F.abs(F.coalesce("a", zero) - F.coalesce("b", zero)))
    return per.agg(F.avg(value).alias("valence"))


def stance_concentration(dominant: DataFrame, labels: DataFrame, min_docs: int = 5,
                         sample: int | None = None, seed: int = 0) -> DataFrame:
    """Mean over topics of ``1 - H(labels) / ln(max(n_labels, 2))`` on labelled documents.

    All labelled documents count; ``sample`` takes that many of each topic.
    """
    sizes = dominant.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    picked = dominant.select("doc_id", "topic").join(sizes.select("topic"), "topic")
    if sample is not None:
        w = Window.partitionBy("topic").orderBy(seeded.uniform(seed, "doc_id"), "doc_id")
        picked = picked.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
        picked = picked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).drop("r")
    counts = picked.join(labels.select("doc_id", "label"), "doc_id").groupBy("topic", "label").agg(
        F.count(F.lit(1)).alias("c"))
    n = counts.groupBy("topic").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("m"))
    p = F.col("c") / F.col("t")
    h = counts.join(n, "topic").groupBy("topic", "m").agg((-F.sum(p * F.log(p + 1e-12))).alias("h"))
    return h.agg(F.avg(1.0 - F.col("h") / F.log(F.greatest("m", F.lit(2)))).alias("stance"))


# -- soft values over topic-word rows ----------------------------------------------

def topic_entropy(phi: DataFrame) -> DataFrame:
    """Mean entropy of the topic-word rows."""
    e = phi.groupBy("topic").agg((-F.sum(F.col("weight") * F.log(F.col("weight") + 1e-10))).alias("h"))
    return e.agg(F.avg("h").alias("topic_entropy"))


def soft_ppmi(phi: DataFrame, ppmi: DataFrame, bound: int | None, num_topics: int) -> DataFrame:
    """Mean over topics of ``sum_ij beta_i PPMI_ij beta_j``; ``ppmi`` holds each pair once."""
    from .context import wide_rows

    wide = wide_rows(phi, "term_id", num_topics, "b")
    a = bounded(wide.select(F.col("term_id").alias("src"), F.col("b").alias("bi")), bound)
    b = bounded(wide.select(F.col("term_id").alias("dst"), F.col("b").alias("bj")), bound)
    total = ppmi.join(a, "src").join(b, "dst").agg(F.sum(2.0 * F.col("ppmi") * vec.dot("bi", "bj")).alias("s"))
    return total.select((F.coalesce("s", F.lit(0.0)) / float(num_topics)).alias("soft_ppmi"))


def soft_we(topics: DataFrame, beta: DataFrame, vectors: DataFrame, dim: int, bound: int | None) -> DataFrame:
    """Mean cosine of each topic with its beta-weighted mean unit word vector."""
    v = bounded(vectors.select("term_id", vec.unit(vec.doubles("vec")).alias("u")), bound)
    means = beta.join(v, "term_id").groupBy("topic").agg(
        vec.sum_arrays("u", dim, F.col("weight")).alias("m"))
    return means.join(topics.select("topic", vec.doubles("vec").alias("tv")), "topic").agg(
        F.avg(vec.cosine("m", "tv")).alias("soft_we"))


# -- agreement with labels ---------------------------------------------------------

def nmi(pairs: DataFrame) -> DataFrame:
    """Normalised mutual information of ``pairs(a, b)``, arithmetic mean of entropies."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    n = F.lit(max(total, 1.0))
    ra = cells.groupBy("a").agg(F.sum("n").alias("na"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    mi = cells.join(ra, "a").join(rb, "b").agg(F.sum(
        F.col("n") / n * F.log(F.col("n") * n / (F.col("na") * F.col("nb")))).alias("v"))
    ha = ra.agg((-F.sum(F.col("na") / n * F.log(F.col("na") / n))).alias("v"))
    hb = rb.agg((-F.sum(F.col("nb") / n * F.log(F.col("nb") / n))).alias("v"))
    all_ = mi.withColumn("k", F.lit("m")).unionByName(ha.withColumn("k", F.lit("a"))).unionByName(
        hb.withColumn("k", F.lit("b")))
    g = all_.agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in "mab"])
    den = (F.col("a") + F.col("b")) / 2.0
    return g.select(F.when(den < 1e-15, 1.0).otherwise(F.greatest(F.col("m"), F.lit(0.0)) / den).alias("nmi"))


def ari(runs: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean adjusted Rand index over all pairs of ``runs(run, doc_id, topic)``.

    All documents count. A ``sample`` takes that many in a seeded order of their ids, the
    same ones in each run.
    """
    if sample is not None:
        ids = runs.select("doc_id").distinct().orderBy(seeded.uniform(seed, "doc_id"), "doc_id").limit(sample)
        runs = runs.join(ids, "doc_id")
    other = runs.select("doc_id", F.col("run").alias("o"), F.col("topic").alias("b"))
    cells = runs.join(other, "doc_id").where(F.col("run") < F.col("o")).groupBy("run", "o", "topic", "b").agg(
        F.count(F.lit(1)).cast("double").alias("n"))

    def comb(c):
        return F.sum(F.col(c) * (F.col(c) - 1) / 2.0)

    key = ["run", "o"]
    ij = cells.groupBy(*key).agg(comb("n").alias("ij"), F.sum("n").alias("n"))
    a = cells.groupBy(*key, "topic").agg(F.sum("n").alias("n")).groupBy(*key).agg(comb("n").alias("a"))
    b = cells.groupBy(*key, "b").agg(F.sum("n").alias("n")).groupBy(*key).agg(comb("n").alias("bb"))
    e = F.col("a") * F.col("bb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("a") + F.col("bb")) / 2.0
    value = F.when(top == e, 1.0).otherwise((F.col("ij") - e) / (top - e))
    return ij.join(a, key).join(b, key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("ari"))
