"""Scoring a stream of documents against a frozen model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import nmf
from ..operators.lookup import Words, flat_lists, word_hashes
from ..session import BROADCAST_ROWS, stage_path


def score_stream(docs: DataFrame, vocab: DataFrame, h: np.ndarray, stop, *, n_iter: int = 100,
                 seed: int = 42, divergence: str = "kl") -> DataFrame:
    """``(doc_id, w)`` for a streaming or batch ``docs(doc_id, text)``.

    The transform is stateless: words are looked up in the frozen vocabulary inside the
    row and the weights follow from the row alone, so it runs in append mode with no
    watermark, state store or shuffle. The vocabulary is bounded by ``max_features``.
    """
    if vocab.count() > BROADCAST_ROWS:
        raise ValueError("a stream needs a vocabulary that fits a task")
    known = vocab.sparkSession.sparkContext.broadcast(Words(vocab))

    def encode(batches):
        for rb in batches:
            words, rows = flat_lists(rb.column(1))
            hashes, _ = flat_lists(rb.column(2))
            ids = known.value.ids(words, hashes.to_numpy())
            on = ids >= 0
            code, cnt = np.unique((rows[on].astype(np.int64) << 32) | ids[on], return_counts=True)
            offsets = pa.array(np.searchsorted(code >> 32, np.arange(rb.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.ListArray.from_arrays(offsets, pa.array((code & 0xFFFFFFFF).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(cnt.astype(np.float64)))], names=["doc_id", "ids", "cnts"])

    tokens = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), T.kept_words(F.coalesce("text", F.lit("")), stop).alias("tokens"))
    rows = tokens.select("doc_id", "tokens", word_hashes("tokens").alias("h")).mapInArrow(
        encode, "doc_id bigint, ids array<int>, cnts array<double>")
    return nmf.fold_in(rows, h, n_iter=n_iter, seed=seed, divergence=divergence)


def theta_rows(scored: DataFrame) -> DataFrame:
    """Long form of the scored stream."""
    return scored.select("doc_id", F.posexplode("w").alias("topic", "weight"))


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The files of a table, in batches, as they arrive."""
    schema = spark.read.parquet(path).schema
    # the pattern matches the table whether it is one file or a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def write_scores(scored: DataFrame, out: str, checkpoint: str):
    """Write a scored stream so that a restart neither loses nor repeats a batch.

    A batch goes to a folder named by its number, which replaces what an interrupted attempt
    left there; the checkpoint says which batches are done. Returns the started query.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scored.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_in_stream(spark: SparkSession, path: str, vocab: DataFrame, h: np.ndarray, stop, out: str | None = None,
                   files_per_batch: int = 64, **how) -> DataFrame:
    """``(batch, doc_id, w)``: everything that stands at ``path`` now, scored as a stream.

    Calling it again with the same ``out`` scores only files that are new.
    """
    out = out or stage_path(spark, "scored")
    query = write_scores(score_stream(document_stream(spark, path, files_per_batch), vocab, h, stop, **how), f"{out}/rows", f"{out}/checkpoint")
    query.awaitTermination()
    return spark.read.schema("doc_id bigint, w array<double>, batch int").parquet(f"{out}/rows")
