"""Word, document, topic and phrase vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..session import bounded, hold, settle
from .sparse import SUM_TASKS, blocks, lists, sparse, times, truncated_svd


def ppmi_cells(cooc: DataFrame, bound: int | None, shift: str = "none") -> DataFrame:
    """``(src, dst, value)``: positive PMI of a symmetric co-occurrence table.

    ``shift="total"`` multiplies the ratio by the total count once more.
    """
    rows = settle(cooc.groupBy("src").agg(F.sum("cnt").cast("double").alias("c")), "sums")
    total = float(rows.agg(F.sum("c")).first()[0] or 0.0)
    left = bounded(rows.select("src", F.col("c").alias("ci")), bound)
    right = bounded(rows.select(F.col("src").alias("dst"), F.col("c").alias("cj")), bound)
    factor = total * total if shift == "total" else total
    value = F.log(F.col("cnt") * F.lit(factor) / (F.col("ci") * F.col("cj")))
    return (
        cooc.join(left, "src").join(right, "dst")
        .select("src", "dst", F.greatest(value, F.lit(0.0)).alias("value"))
        .where(F.col("value") > 0)
    )


def svd_vectors(cells: DataFrame, n_terms: int, dim: int = 100) -> DataFrame:
    """``(term_id, vec)``: U * sqrt(S) of the truncated SVD, zero-padded to ``dim``."""
    rows = hold(
        cells.groupBy("src")
        .agg(F.sort_array(F.collect_list(F.struct("dst", "value"))).alias("r"))
        .select("src", F.col("r.dst").alias("ids"), F.col("r.value").alias("cnts")))
    s, right = truncated_svd(rows, n_terms, min(dim, n_terms - 1))
    basis = np.zeros((n_terms, dim))
    basis[:, :s.size] = right / np.sqrt(s)              # X v / s * sqrt(s)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches):
            ids, x, _, sizes = sparse(rb, 1, 2)
            yield pa.RecordBatch.from_arrays([rb.column(0), lists(times(ids, x, sizes, basis))], names=["term_id", "vec"])

    return rows.mapInArrow(left, "term_id int, vec array<double>")


def skipgram_vectors(token_lists: DataFrame, triples: DataFrame, vocab: DataFrame, dim: int = 100,
                     window: int = 5, epochs: int = 10, seed: int = 42,
                     words_per_task: int = 100_000) -> DataFrame:
    """Skip-gram vectors of lemma lists plus each dependency pair as a short sentence.

    All words are neighbours, those outside the vocabulary too; vectors are returned for the
    vocabulary only.
    Each epoch trains on as many parts as the words fill, and the vectors of the parts are
    averaged before the next. A part sends on the vectors of all its words in every epoch, so
    there are at most ``SUM_TASKS`` parts for each core, whatever the corpus; more words make the
    parts longer. A vocabulary word without a vector gets zeros.
    """
    pair_sents = (
        triples.where(F.col("head") != F.col("dependent")).select("head", "dependent").distinct()
        .select(F.array("head", "dependent").alias("tokens"))
    )
    words = token_lists.select(F.filter("tokens", lambda w: w.isNotNull()).alias("tokens")).where(F.size("tokens") > 0)
    sentences = settle(words.unionByName(pair_sents), "sentences")
    n_words = sentences.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = training_parts(n_words, words_per_task, sentences.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=1, seed=seed,
                     numPartitions=parts, inputCol="tokens", outputCol="v").fit(sentences)
    found = model.getVectors().select(
        F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
    return fill_missing(vocab, found, dim)


def training_parts(n_words: int, words_per_task: int, cores: int) -> int:
    return max(1, min(-(-n_words // words_per_task), SUM_TASKS * cores))


def fill_missing(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(term_id, term, vec, missing)``: zeros for words without a vector."""
    key = "term" if "term" in vectors.columns else "term_id"
    return vocab.select("term_id", "term").join(
        vectors.select(key, vec.doubles("vec").alias("vec")), key, "left").select(
        "term_id", "term", F.coalesce("vec", vec.zeros(dim)).alias("vec"),
        F.col("vec").isNull().alias("missing"))


def weighted_mean(rows: DataFrame, key: str, dim: int, weight: str = "w") -> DataFrame:
    """``(key, vec)``: weighted mean of array rows, combined before the shuffle."""
    return (
        rows.groupBy(key)
        .agg(vec.sum_arrays("vec", dim, F.col(weight)).alias("s"), F.sum(weight).alias("w"))
        .select(key, F.transform("s", lambda x: x / F.when(F.col("w") == 0, 1.0)
                                 .otherwise(F.col("w"))).alias("vec"))
    )


def document_vectors(docs: DataFrame, bow_df: DataFrame, vectors: DataFrame, dim: int,
                     bound: int | None) -> DataFrame:
    """Count-weighted mean word vector per document; zeros for an empty document.

    The mean runs over all counted terms, those without a vector adding zeros.
    """
    table = bounded(vectors.select("term_id", vec.doubles("vec").alias("vec")), bound)
    rows = bow_df.join(table, "term_id", "left").select(
        "doc_id", F.col("cnt").cast("double").alias("w"),
        F.coalesce("vec", vec.zeros(dim)).alias("vec"))
    means = weighted_mean(rows, "doc_id", dim)
    return docs.select("doc_id").join(means, "doc_id", "left").select(
        "doc_id", F.coalesce("vec", vec.zeros(dim)).alias("vec"))


def topic_vectors(phi: DataFrame, vectors: DataFrame, dim: int, bound: int | None,
                  normalize: bool = False) -> DataFrame:
    """``(topic, vec)``: sum of phi times word vector, optionally of unit length."""
    table = bounded(vectors.select("term_id", vec.doubles("vec").alias("vec")), bound)
    sums = phi.join(table, "term_id").groupBy("topic").agg(
        vec.sum_arrays("vec", dim, F.col("weight")).alias("vec"))
    return sums.select("topic", (vec.unit("vec") if normalize else F.col("vec")).alias("vec"))


def topic_word_vectors(topic_words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(topic, vec)``: mean vector of a topic's listed words; zeros without any."""
    rows = topic_words.join(vectors.select("term", vec.doubles("vec").alias("vec")), "term").select(
        "topic", "vec", F.lit(1.0).alias("w"))
    means = weighted_mean(rows, "topic", dim)
    return topic_words.select("topic").distinct().join(means, "topic", "left").select(
        "topic", F.coalesce("vec", vec.zeros(dim)).alias("vec"))


def phrase_vectors(triples: DataFrame, vectors: DataFrame, bound: int | None,
                   min_count: int = 5) -> DataFrame:
    """``(phrase, relation, cnt, vec)``: mean of the two word vectors of each triple."""
    v = vectors.select("term", vec.doubles("vec").alias("vec"))
    a = bounded(v.select(F.col("term").alias("head"), F.col("vec").alias("va")), bound)
    b = bounded(v.select(F.col("term").alias("dependent"), F.col("vec").alias("vb")), bound)
    return (
        triples.where(F.col("cnt") >= min_count).join(a, "head").join(b, "dependent")
        .select(F.concat_ws(" ", "head", "dependent").alias("phrase"), "relation", "cnt",
                F.zip_with("va", "vb", lambda x, y: (x + y) / 2.0).alias("vec"))
    )


def pca_reducer(rows: DataFrame) -> DataFrame:
    """Adds ``x`` and ``y``, the first two principal components of ``vec``."""
    feats = rows.withColumn("_f", array_to_vector("vec"))
    out = PCA(k=2, inputCol="_f", outputCol="_p").fit(feats).transform(feats)
    xy = vector_to_array("_p")
    return out.withColumn("x", xy[0]).withColumn("y", xy[1]).drop("_f", "_p")


def project2d(topics: DataFrame, vectors: DataFrame,
              reducer: Callable[[DataFrame], DataFrame] = pca_reducer) -> DataFrame:
    """``(kind, label, x, y)`` for topics and words; any reducer that adds x and y."""
    points = topics.select(F.lit("topic").alias("kind"), F.col("topic").cast("string").alias("label"),
                           vec.doubles("vec").alias("vec")).unionByName(
        vectors.select(F.lit("word").alias("kind"), F.col("term").alias("label"),
                       vec.doubles("vec").alias("vec")))
    return reducer(points).select("kind", "label", "x", "y")
