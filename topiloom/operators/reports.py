"""Topic reports: top words, multiword expressions, labels and document tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec
from ..functions.wordlists import MWE_RELATIONS
from ..session import bounded, settle
from .context import _per_topic

AUTOMATON_CHARS = 2_000_000


def ranked(rows: DataFrame, top_k: int, tie: str = "term", by: str = "weight",
           key: Sequence[str] = ("topic",)) -> DataFrame:
    """Best ``top_k`` rows per key with a 1-based ``rank``; the limit works map-side."""
    w = Window.partitionBy(*key).orderBy(F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def top_words(phi: DataFrame, top_k: int = 10, hide: Iterable[str] = ()) -> DataFrame:
    """``(topic, rank, term, weight)``; hidden words never change the model."""
    hidden = sorted({w.lower() for w in hide})
    rows = phi.where(~F.col("term").isin(hidden)) if hidden else phi
    return ranked(rows, top_k).select("topic", "rank", "term", "weight")


def cosine_ranked(topics: list[tuple[int, list[float]]], items: DataFrame, label: str, top_k: int,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Best words or phrases per topic by cosine with the topic vector."""
    sims = _per_topic(items, topics).select(
        "topic", label, *keep, vec.cosine(vec.doubles("vec"), "tv", 1e-8).alias("sim"))
    return ranked(sims, top_k, tie=label, by="sim").select("topic", "rank", label, *keep, "sim")


def mwes(topic_words: DataFrame, triples: DataFrame, n_words: int, top_k: int = 15,
         relations: Iterable[str] = MWE_RELATIONS) -> DataFrame:
    """``(topic, rank, phrase, relation, score, cnt, in_topic)``.

    A triple matches a topic through its head or its dependent; both is full weight,
    one is half. Each phrase keeps its best relation.
    """
    tw = topic_words.select("topic", "term").distinct()
    t = triples.where(F.col("relation").isin(sorted(relations)))
    hits = t.join(bounded(tw.select("topic", F.col("term").alias("head")), n_words), "head").unionByName(
        t.join(bounded(tw.select("topic", F.col("term").alias("dependent")), n_words), "dependent"))
    scored = (
        hits.groupBy("topic", "head", "relation", "dependent", "cnt")
        .agg(F.count(F.lit(1)).cast("int").alias("in_topic"))
        .select("topic", F.concat_ws(" ", "head", "dependent").alias("phrase"), "relation", "cnt",
                "in_topic", (F.col("cnt") * F.when(F.col("in_topic") == 2, 1.0).otherwise(0.5)).alias("score"))
    )
    best = ranked(scored, 1, tie="relation", by="score", key=("topic", "phrase")).drop("rank")
    return ranked(best, top_k, tie="phrase", by="score").select(
        "topic", "rank", "phrase", "relation", "score", "cnt", "in_topic")


def mwe_counts(mwe: DataFrame) -> DataFrame:
    return mwe.groupBy("topic").agg(F.count(F.lit(1)).alias("n_mwes"))


def _listed(rows: DataFrame, col: str, name: str, upto: int | None = None) -> DataFrame:
    """Per topic the ranked values as one array; a report list is short."""
    src = rows if upto is None else rows.where(F.col("rank") <= upto)
    return src.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", col))).getField(col).alias(name))


def labels(topic_words: DataFrame, mwe: DataFrame, n: int = 3) -> DataFrame:
    """``(topic, label)``: the best phrase and the top words, ``n`` parts."""
    words = _listed(topic_words, "term", "w", n)
    phrase = _listed(mwe, "phrase", "p", 1)
    empty = F.array().cast("array<string>")
    parts = F.slice(F.array_distinct(F.concat(F.coalesce("p", empty), F.coalesce("w", empty))), 1, n)
    return words.join(phrase, "topic", "full").select("topic", F.array_join(parts, ", ").alias("label"))


def topic_info(dominant: DataFrame, topic_words: DataFrame, mwe: DataFrame, num_topics: int) -> DataFrame:
    """One row per topic: 1-based id, size, label, words and phrases; empty topics stay."""
    spark = dominant.sparkSession
    sizes = dominant.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    words = _listed(topic_words, "term", "w").select("topic", F.array_join("w", ", ").alias("top_words"))
    phrases = _listed(mwe, "phrase", "p", 3).select("topic", F.array_join("p", ", ").alias("mwes"))
    every = spark.range(num_topics).select(F.col("id").cast("int").alias("topic"))
    return (
        every.join(sizes, "topic", "left").join(labels(topic_words, mwe), "topic", "left")
        .join(words, "topic", "left").join(phrases, "topic", "left")
        .select((F.col("topic") + 1).alias("topic_id"), F.coalesce("size", F.lit(0)).alias("size"),
                F.coalesce("label", F.lit("")).alias("label"),
                F.coalesce("top_words", F.lit("")).alias("top_words"),
                F.coalesce("mwes", F.lit("")).alias("mwes"))
        .orderBy(F.desc("size"), "topic_id")
    )


def document_topics(dominant: DataFrame, docs: DataFrame, chars: int = 80) -> DataFrame:
    """Dominant topic (1-based), probability to three digits and a preview."""
    return docs.select("doc_id", T.preview("text", chars).alias("text_preview")).join(
        dominant, "doc_id").select(
        "doc_id", (F.col("topic") + 1).alias("dominant_topic"),
        F.round("weight", 3).alias("dominant_prob"), "text_preview")


def rake(docs: DataFrame, theta: DataFrame, stop: Iterable[str], top_docs: int = 30, top_k: int = 10,
         max_words: int = 4) -> DataFrame:
    """``(topic, rank, phrase, score)`` from each topic's heaviest documents.

    Phrases are runs of words between stop words and punctuation, at most
    ``max_words`` long. A word scores degree / frequency, a phrase the sum of its words.
    """
    best = ranked(theta, top_docs, tie="doc_id").select("topic", "doc_id")
    stops = sorted(stop)
    marked = F.transform(
        F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+|[^\s\p{L}\p{N}_']"), F.lit(0)),
        lambda w: F.when(w.isin(stops) | ~w.rlike(r"^[\p{L}\p{N}_']+$"), F.lit("|")).otherwise(w))
    pieces = (
        docs.join(best, "doc_id")
        .select("topic", F.explode(F.split(F.array_join(marked, " "), r"\|")).alias("phrase"))
        .select("topic", F.trim("phrase").alias("phrase")).where(F.col("phrase") != "")
        .withColumn("ws", F.split("phrase", " "))
        .where(F.size("ws") <= max_words)
    )
    counted = pieces.groupBy("topic", "phrase").agg(F.first("ws").alias("ws"), F.count(F.lit(1)).alias("n"))
    scores = (
        counted.select("topic", F.explode("ws").alias("w"), "n", F.size("ws").alias("len"))
        .groupBy("topic", "w").agg((F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("s"))
    )
    totals = (
        counted.select("topic", "phrase", F.explode("ws").alias("w")).join(scores, ["topic", "w"])
        .groupBy("topic", "phrase").agg(F.sum("s").alias("score"))
    )
    return ranked(totals, top_k, tie="phrase", by="score").select("topic", "rank", "phrase", "score")


def generic_mwes(scores: DataFrame, stop: Iterable[str], top_k: int = 10) -> DataFrame:
    """``(topic, kind, rank, term)``: underscore bigrams and single words by class TF-IDF.

    A term with any part in the stop list is dropped.
    """
    stops = sorted(stop)
    clean = scores.where(~F.exists(F.split("term", "_"), lambda p: p.isin(stops))).withColumn(
        "kind", F.when(F.col("term").contains("_"), "phrase").otherwise("single"))
    return ranked(clean, top_k, key=("topic", "kind")).select(
        "topic", "kind", "rank", T.spaced("term").alias("term"))


def phrase_features(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, phrase)``: the lower-cased phrases each document contains.

    The phrases become one automaton that reads each text once, however many they are. It is
    sent to the tasks while the phrases have at most ``AUTOMATON_CHARS`` characters together;
    with more of them the documents are read once for each share of that size.
    """
    listed = settle(phrases.select(F.lower(F.regexp_replace("phrase", r"^\s+|\s+$", "")).alias("phrase")).where("phrase <> ''").distinct(), "phrases")
    chars = listed.agg(F.sum(F.length("phrase"))).first()[0] or 0
    shares = max(1, -(-chars // AUTOMATON_CHARS))
    texts = docs.select("doc_id", F.lower("text").alias("low")).where("low IS NOT NULL")
    out = None
    for share in range(shares):
        own = [r["phrase"] for r in listed.where(F.pmod(F.xxhash64("phrase"), F.lit(shares)) == share).collect()]
        found = texts.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(own)), "doc_id bigint, phrase string")
        out = found if out is None else out.unionByName(found)
    return out


def _matcher(phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for p in phrases.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for rb in batches:
            ids, hits = [], []
            for doc_id, low in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                found = {p for _, p in automaton.iter(low)} if phrases.value else ()
                ids += [doc_id] * len(found)
                hits += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.string())], names=["doc_id", "phrase"])

    return run


def topic_points(points: DataFrame, dominant: DataFrame) -> DataFrame:
    """Mean coordinate, mean dominant probability and size per topic."""
    return points.join(dominant, "doc_id").groupBy("topic").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("weight").alias("mean_prob"),
        F.count(F.lit(1)).alias("n"))


def all_words(lists: dict[str, DataFrame]) -> DataFrame:
    """Word lists of several models in one table."""
    out = None
    for name, tw in lists.items():
        part = tw.select(F.lit(name).alias("model"), "topic", "rank", "term")
        out = part if out is None else out.unionByName(part)
    return out
