"""From raw documents to token ids: five stages over the ``documents`` table.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept,
and returns a table that ``run`` writes as Parquet and reads again for the next stage. All
but the last return the columns of ``documents``. Fits and counts are those of the rows a
stage is given; labels and benchmark items come from ``sf_dir``. Empty tables give empty
results. Extra columns pass through; names that start with an underscore, and the result
names of the operators, are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiloom.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from topiloom.llm.tables import table
from topiloom.session import stage_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; those without text score low and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; no document is dropped."""
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away no benchmark item."""
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their count and the digests of ids and decoded text."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

#: A fitted classifier and a tokenizer have no SQL form; the tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = stage_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
