"""CoNLL-U files as token rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_conllu(spark: SparkSession, path: str, stop: Iterable[str] = ()) -> DataFrame:
    """Token rows from files whose sentences carry ``# sent_id = <document>-<number>``.

    A sentence block is one row of the source, so large files split freely. Comments,
    short rows, multiword ranges and empty nodes are skipped; lemma ``_`` falls back to
    the form, relation ``_`` to the empty string and a non-numeric head to 0.
    """
    stops = sorted(stop)
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    sent = F.regexp_extract("value", r"(?m)^#\s*sent_id\s*=\s*(\S+)\s*$", 1)
    lines = blocks.select(sent.alias("sent"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    c = F.split("line", "\t")
    rows = (
        lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
        .select("sent", c.alias("c")).where(F.size("c") >= 8)
        .where(~F.col("c")[0].rlike(r"[-.]"))
    )
    form, lemma, dep, head = (F.col("c")[i] for i in (1, 2, 7, 6))
    return rows.select(
        F.regexp_extract("sent", r"^(.*)-\d+$", 1).cast("bigint").alias("doc_id"),
        F.regexp_extract("sent", r"-(\d+)$", 1).cast("int").alias("sent_id"),
        F.col("c")[0].cast("int").alias("tok_id"), form.alias("form"),
        F.lower(F.when(lemma == "_", form).otherwise(lemma)).alias("lemma"),
        F.col("c")[3].alias("upos"), F.when(dep == "_", "").otherwise(dep).alias("dep"),
        F.when(head.rlike(r"^-*\d+$"), head.try_cast("int")).otherwise(0).alias("head_id"),
        (F.lower(form).isin(stops) if stops else F.lit(False)).alias("is_stop"),
        form.rlike(r"^\p{L}+$").alias("is_alpha"))
