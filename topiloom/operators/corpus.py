"""Text to segments, token rows and lemma documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import by_repeats

TOKEN_SCHEMA = (
    "doc_id bigint, sent_id int, tok_id int, form string, lemma string, upos string, "
    "dep string, head_id int, is_stop boolean, is_alpha boolean"
)


def segments(docs: DataFrame, max_chars: int | None = 800, drop_short: bool = False) -> DataFrame:
    """Documents cut into sentence-packed segments with a back-pointer.

    ``drop_short`` removes documents of ten characters or fewer first. With
    ``max_chars=None`` a document is one segment.
    """
    src = docs.where(T.long_enough("text")) if drop_short else docs
    parts = (
        F.array(T.normalise_ws("text")) if max_chars is None else T.chunks("text", max_chars)
    )
    return (
        src.select("doc_id", F.posexplode(parts).alias("seg_id", "text"))
        .where(F.col("text") != "")
    )


def label_segments(segs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each segment with the columns of its parent document's label row."""
    return segs.join(labels, "doc_id")


def word_lists(docs: DataFrame, expr: Column) -> DataFrame:
    """``(doc_id, tokens)``: one row per document, its tokens in order."""
    return docs.select("doc_id", expr.alias("tokens"))


def token_rows(lists: DataFrame) -> DataFrame:
    """``(doc_id, pos, term)`` in long form."""
    return lists.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def parse_with(docs: DataFrame, make_parser: Callable[[], object], batch_size: int = 64) -> DataFrame:
    """Token rows from any parser object with ``pipe(texts, batch_size)``.

    ``make_parser`` runs once per task. Each parsed document is a list of tuples
    ``(sent_id, tok_id, form, lemma, upos, dep, head_id, is_stop, is_alpha)``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        names = [c.split()[0] for c in TOKEN_SCHEMA.split(", ")]
        for pdf in batches:
            rows = [
                (doc_id, *tok)
                for doc_id, parsed in zip(pdf["doc_id"], parser.pipe(pdf["text"], batch_size))
                for tok in parsed
            ]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, TOKEN_SCHEMA)


def unpacked(tokens: DataFrame) -> DataFrame:
    """Token rows of a parse, which may be packed: ``(doc_id, toks)`` with a document's tokens in one row."""
    return tokens.select("doc_id", F.inline("toks")) if "toks" in tokens.columns else tokens


def kept_tokens(tokens: DataFrame) -> DataFrame:
    """Token rows whose lemma is alphabetic, no stop word and at least three long."""
    return unpacked(tokens).where(_kept(F.col))


def _kept(field: Callable[[str], Column]) -> Column:
    return ~field("is_stop") & field("is_alpha") & (F.length(field("lemma")) >= T.MIN_LEMMA_CHARS)


def lemma_lists(tokens: DataFrame) -> DataFrame:
    """Kept lemmas of each document in reading order.

    A group is one document, so its size is bounded by one text cell of the source. Documents
    that a packed parse holds in one row are not shuffled.
    """
    def grouped(rows: DataFrame) -> DataFrame:
        return (
            kept_tokens(rows)
            .groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("sent_id", "tok_id", "lemma"))).alias("seq"))
            .select("doc_id", F.col("seq.lemma").alias("tokens"))
        )

    own, again = by_repeats(tokens) if "toks" in tokens.columns else (None, tokens)
    if own is None:
        return grouped(again)
    seq = F.transform(F.filter("toks", lambda t: _kept(t.getField)),
                      lambda t: F.struct(t["sent_id"].alias("sent_id"), t["tok_id"].alias("tok_id"), t["lemma"].alias("lemma")))
    lists = own.select("doc_id", F.sort_array(seq).alias("seq")).where(F.size("seq") > 0).select(
        "doc_id", F.col("seq.lemma").alias("tokens"))
    return lists if again is None else lists.unionByName(grouped(again))


def term_lists(lists: DataFrame) -> DataFrame:
    """The terms that the vocabulary counts: the words of each document's lemmas.

    A lemma that is no single word, such as ``l'acqua`` or ``e-mail``, gives the words of two
    letters or more that it holds.
    """
    return lists.select("doc_id", T.words(F.array_join("tokens", " ")).alias("tokens"))


def lemma_documents(tokens: DataFrame) -> DataFrame:
    """Lemma string per document; learns no vocabulary."""
    return lemma_lists(tokens).select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


def stop_table(spark, *lists: Iterable[str]) -> DataFrame:
    """Union of stop lists as a one-column table."""
    words = sorted({w.lower() for ws in lists for w in ws})
    return spark.createDataFrame([(w,) for w in words], "term string")


def clean_topic_words(topic_words: DataFrame, stop: Iterable[str], top_k: int = 10) -> DataFrame:
    """Trim, drop one-letter and stop words, then re-rank and cut to ``top_k``."""
    from pyspark.sql import Window

    w = Window.partitionBy("topic").orderBy("rank")
    return (
        topic_words.withColumn("term", T.strip("term"))
        .where((F.length("term") > 1) & ~F.lower("term").isin(sorted(stop)))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top_k)
    )


def split_bigrams(topic_words: DataFrame) -> DataFrame:
    """``a_b`` becomes two rows; order inside the topic is kept in ``part``."""
    return topic_words.select(
        "topic", "rank", F.posexplode(F.split("term", "_")).alias("part", "term")
    ).where(F.col("term") != "")
