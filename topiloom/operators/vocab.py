"""Vocabulary, document-term counts and term weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import numbered
from ..session import bounded, by_repeats
from .lookup import flat_lists


def token_counts(lists: DataFrame) -> DataFrame:
    """``(doc_id, term, cnt)`` from token lists, counted inside the row.

    Only documents whose id stands in several rows are grouped by a shuffle; their ids are found
    first. If these ids have no bound, all documents are.
    """
    def grouped(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))

    own, again = by_repeats(lists)
    if own is None:
        return grouped(again)
    kind = lists.schema["doc_id"].dataType.simpleString()
    counts = own.select("doc_id", "tokens").mapInArrow(_row_counts, f"doc_id {kind}, term string, cnt bigint")
    return counts if again is None else counts.unionByName(grouped(again))


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        words, row = flat_lists(rb.column(1))
        coded = words.dictionary_encode(null_encoding="encode")
        size = max(1, len(coded.dictionary))
        keys, n = np.unique(row * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(keys // size)), coded.dictionary.take(pa.array(keys % size)), pa.array(n.astype(np.int64))],
                                         names=["doc_id", "term", "cnt"])


def number_terms(terms: DataFrame, bound: int | None) -> DataFrame:
    """Ids 0.. in lexicographic order of ``term``.

    A bounded vocabulary is numbered in one sort, an unbounded one over range partitions.
    """
    if bound is not None:
        rank = F.row_number().over(Window.orderBy("term")) - 1
        return terms.withColumn("term_id", rank.cast("int"))
    return numbered(terms, ["term"], "term_id").withColumn("term_id", F.col("term_id").cast("int"))


def build_vocab(counts: DataFrame, min_df: int = 5, max_features: int | None = 15_000) -> DataFrame:
    """``(term, df, tf, term_id)``: terms with enough documents, the most frequent kept.

    ``counts`` holds one row per document and term, so df is a plain count. Ties at
    the ``max_features`` edge go to the alphabetically first term.
    """
    stats = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("tf"))
        .where(F.col("df") >= min_df)
    )
    if max_features is not None:
        stats = stats.orderBy(F.desc("tf"), "term").limit(max_features)
    return number_terms(stats, max_features)


def bow(counts: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """``(doc_id, term_id, term, cnt)`` over the vocabulary."""
    ids = bounded(vocab.select("term", "term_id"), bound)
    return counts.join(ids, "term").select("doc_id", "term_id", "term", "cnt")


def encode(docs: DataFrame, lists: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """Counts of new documents over a frozen vocabulary.

    Unknown terms are dropped. A document without a known term keeps one row with
    NULL term and count 0.
    """
    known = bow(token_counts(lists), vocab, bound)
    return (
        docs.select("doc_id").join(known, "doc_id", "left")
        .withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    )


def doc_rows(bow_df: DataFrame) -> DataFrame:
    """``(doc_id, ids, cnts)``: one sparse row per document.

    A row holds distinct vocabulary terms, so it has at most ``max_features`` entries.
    """
    return (
        bow_df.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("term_id", F.col("cnt").cast("double").alias("c"))))
             .alias("r"))
        .select("doc_id", F.col("r.term_id").alias("ids"), F.col("r.c").alias("cnts"))
    )


def common_words(vocab: DataFrame, n_docs: int, top_n: int = 30) -> DataFrame:
    """The terms found in most documents, with their share."""
    return (
        vocab.select("term", F.col("df").alias("doc_freq"),
                     F.round(F.col("df") / F.lit(max(n_docs, 1)), 3).alias("share"))
        .orderBy(F.desc("doc_freq"), "term").limit(top_n)
    )


def doc_freq(counts: DataFrame) -> DataFrame:
    """``(term, df)`` lookup."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def normalise(bow_df: DataFrame, strategy: str = "tf") -> DataFrame:
    """Count normalisation: ``none``, ``tf`` (row total at least 1) or ``log1p``."""
    if strategy == "none":
        return bow_df.withColumn("value", F.col("cnt").cast("double"))
    if strategy == "log1p":
        return bow_df.withColumn("value", F.log1p("cnt"))
    if strategy == "tf":
        total = F.sum("cnt").over(Window.partitionBy("doc_id"))
        return bow_df.withColumn("value", F.col("cnt") / F.greatest(total, F.lit(1)))
    raise ValueError(f"unknown strategy {strategy!r}")


def tfidf(bow_df: DataFrame, n_docs: int, bound: int | None) -> DataFrame:
    """``(doc_id, term_id, weight)``: sublinear tf, smoothed idf, unit-length rows."""
    idf = bow_df.groupBy("term_id").agg(F.count(F.lit(1)).alias("df")).select(
        "term_id", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    raw = bow_df.join(bounded(idf, bound), "term_id").select(
        "doc_id", "term_id", ((F.log("cnt") + 1.0) * F.col("idf")).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term_id", (F.col("v") / length).alias("weight"))


def document_mask(docs: DataFrame, bow_df: DataFrame) -> DataFrame:
    """``(doc_id, kept)``: whether a document has any vocabulary term."""
    some = bow_df.select("doc_id").distinct().withColumn("kept", F.lit(True))
    return docs.select("doc_id").join(some, "doc_id", "left").select(
        "doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def dominant_topic(theta: DataFrame) -> DataFrame:
    """``(doc_id, topic, weight)``: the heaviest topic, the lowest one on ties."""
    best = F.max(F.struct(F.col("weight"), (-F.col("topic")).alias("neg"))).alias("b")
    return theta.groupBy("doc_id").agg(best).select(
        "doc_id", (-F.col("b.neg")).cast("int").alias("topic"), F.col("b.weight").alias("weight"))


def class_counts(bow_df: DataFrame, dominant: DataFrame) -> DataFrame:
    """``(topic, term, n)``: counts summed over the documents of each dominant topic."""
    return (
        bow_df.join(dominant.select("doc_id", "topic"), "doc_id")
        .groupBy("topic", "term").agg(F.sum("cnt").alias("n"))
    )


def ctfidf(bow_df: DataFrame, dominant: DataFrame, num_topics: int) -> DataFrame:
    """Class TF-IDF ``tf * ln(1 + K / classes with the word)``."""
    cls = class_counts(bow_df, dominant)
    totals = cls.groupBy("topic").agg(F.greatest(F.sum("n"), F.lit(1)).alias("tot"))
    spread = cls.groupBy("term").agg(F.count(F.lit(1)).alias("nk"))
    return (
        cls.join(bounded(totals, num_topics), "topic").join(spread, "term")
        .select("topic", "term",
                (F.col("n") / F.col("tot") * F.log(F.lit(1.0) + num_topics / F.col("nk")))
                .alias("weight"))
    )


def packed(bow_df: DataFrame) -> DataFrame:
    """``(doc_id, ids, cnts)``: the cells of a document in a few rows, made without moving or sorting a table.

    Cells that stand together meet in one row, so a document has one row for each batch that holds
    some of its cells.
    """
    kinds = [bow_df.schema[c].dataType.simpleString() for c in ("doc_id", "term_id", "cnt")]
    return bow_df.select("doc_id", "term_id", "cnt").mapInArrow(
        _packed_cells, "doc_id {}, ids array<{}>, cnts array<{}>".format(*kinds))


def _packed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        if rb.num_rows:
            code = rb.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            off = pa.array(np.append(first, len(code)).astype(np.int32))
            at = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(order[first])), *(pa.ListArray.from_arrays(off, rb.column(i).take(at)) for i in (1, 2))],
                names=["doc_id", "ids", "cnts"])


def pseudo_beta(bow_df: DataFrame, theta: DataFrame) -> DataFrame:
    """``tf[k, v] = sum_d theta[d, k] * count[d, v]`` in long form.

    Documents meet their topics as packed rows, ids and counts only, so neither the words nor a
    row for every word and topic are shuffled, and no task sorts its cells.
    """
    topics = theta.groupBy("doc_id").agg(F.collect_list(F.struct("topic", "weight")).alias("t"))
    sums = (
        packed(bow_df).join(topics, "doc_id").select("t", F.inline(F.arrays_zip("ids", "cnts")).alias("term_id", "cnt"))
        .select("term_id", "cnt", F.inline("t"))
        .groupBy("topic", "term_id").agg(F.sum(F.col("cnt") * F.col("weight")).alias("weight"))
    )
    terms = bow_df.select(F.col("term_id").alias("_id"), "term").distinct()
    return sums.join(terms, F.col("term_id").eqNullSafe(F.col("_id"))).select("topic", "term_id", "term", "weight")


def row_normalise(phi: DataFrame) -> DataFrame:
    """Topic rows scaled to sum 1; an all-zero row stays zero."""
    totals = phi.groupBy("topic").agg(F.sum("weight").alias("_t"))
    t = F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.col("_t"))
    return phi.join(totals, "topic").withColumn("weight", F.col("weight") / t).drop("_t")
