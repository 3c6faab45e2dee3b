"""The flagship query: which topics do the English documents hold?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TopicConfig
from ..functions import text as T
from ..functions.wordlists import STOP_WORDS
from ..operators import corpus
from ..session import spread
from . import fit as fits


def fit_documents(docs: DataFrame, cfg: TopicConfig, init: str = "svd") -> fits.Fitted:
    """Fit documents whose words stand for their own lemmas.

    With ``cfg.apply_chunking`` every text is first cut into segments of whole sentences of
    up to ``cfg.max_chunk_chars``, and the segments are the documents of the fit: theta has
    ``doc_id`` values of the form given by ``segment_ids``.
    """
    if cfg.apply_chunking:
        docs = segment_ids(corpus.segments(docs, cfg.max_chunk_chars))
    lists = corpus.word_lists(docs, T.kept_words("text", STOP_WORDS["eng"]))
    return fits.fit(docs.select("doc_id"), None, cfg, lists=lists, init=init)


def segment_ids(segments: DataFrame) -> DataFrame:
    """``(doc_id, parent, seg_id, text)``: one id for each segment, by a hash of both."""
    return segments.select(F.xxhash64("doc_id", "seg_id").alias("doc_id"), F.col("doc_id").alias("parent"), "seg_id", "text")


def english_topics(spark: SparkSession, sf_dir: str, k: int = 10, iterations: int = 30) -> DataFrame:
    """One row per topic: size, label, top words, and the model's NPMI and diversity."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("lang") == "en"))
    cfg = TopicConfig(num_topics=k, max_iter=iterations, lambda_syntax=0.0, lambda_embed=0.0,
                      vector_backend="none")
    fitted = fit_documents(docs, cfg)
    scores = fitted.evaluate()
    return fitted.topic_info().select(
        "*", F.lit(scores["npmi"]).cast("double").alias("npmi"),
        F.lit(scores["diversity"]).cast("double").alias("diversity"))
