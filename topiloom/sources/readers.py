"""Corpus sources. Every reader returns at least ``(doc_id, text)``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions import text as T


def _with_id(rows: DataFrame) -> DataFrame:
    """Ids that follow the order of files and lines."""
    return rows.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, trimmed, blank lines dropped."""
    rows = spark.read.text(path).select(T.strip("value").alias("text"))
    return _with_id(rows.where(F.col("text") != ""))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One document per block between blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(T.strip("value").alias("text"))
    return _with_id(rows.where(F.col("text") != ""))


def read_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Every text file of a folder as one document, with its name as the order key."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True, pathGlobFilter=pattern)
        .select(F.col("_metadata.file_path").alias("name"), T.strip("value").alias("text"))
        .withColumn("doc_id", F.xxhash64("name"))
    )


def from_table(df: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """The text column of a table as strings, NULLs dropped."""
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col!r} among {df.columns}")
    rows = df.where(F.col(text_col).isNotNull())
    text = F.col(text_col).cast("string").alias("text")
    if id_col is not None:
        return rows.select(F.col(id_col).alias("doc_id"), text)
    return _with_id(rows.select(text))


def from_list(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(str, texts))), "doc_id bigint, text string")


def first_column(columns: Sequence[str], names: Iterable[str], default: str | None = None) -> str:
    """The first column whose trimmed lower-case name is one of ``names``."""
    wanted = set(names)
    for c in columns:
        if c.strip().lower() in wanted:
            return c
    if default is None:
        raise ValueError(f"none of {sorted(wanted)} among {list(columns)}")
    return default


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted text that may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')


def speeches(table: DataFrame, min_words: int = 20, max_docs: int | None = None) -> DataFrame:
    """Text column named text, speech or statement (else the last one), long enough."""
    col = first_column(table.columns, ("text", "speech", "statement"), table.columns[-1])
    rows = table.where(F.col(col).isNotNull() & (T.word_count(col) >= min_words))
    out = _with_id(rows.select(F.col(col).cast("string").alias("text")))
    return out.orderBy("doc_id").limit(max_docs) if max_docs else out


def posts(table: DataFrame, labels: dict[str, int], title: str = "Title", body: str = "Text",
          label: str = "Political Lean", min_words: int = 5) -> DataFrame:
    """Title and body joined, short posts dropped, the label mapped and -1 when unknown."""
    clean = T.strip(F.coalesce(F.col(body).cast("string"), F.lit("")))
    has_body = (clean != "") & (F.lower(clean) != "nan")
    head = T.strip(F.coalesce(F.col(title).cast("string"), F.lit("nan")))
    text = F.when(has_body, T.strip(F.concat_ws(" ", head, clean))).otherwise(head)
    code: Column = F.lit(-1)
    for name, value in labels.items():
        code = F.when(F.col(label) == name, value).otherwise(code)
    return table.select(*[c for c in table.columns if c == "doc_id"], text.alias("text"),
                        code.alias("label")).where(T.word_count("text") >= min_words)


def any_case_text(table: DataFrame, names=("text", "body", "selftext", "content")) -> DataFrame:
    """The first column with one of the names in any case, trimmed, blanks dropped."""
    col = first_column(table.columns, names)
    keep = [c for c in table.columns if c == "doc_id"]
    return table.select(*keep, T.strip(F.col(f"`{col}`")).alias("text")).where(F.col("text") != "")


def debates(table: DataFrame, max_docs: int | None = None, seed: int = 0, min_words: int = 30,
            role: str = "MEP", id_col: str = "doc_id") -> DataFrame:
    """Original-language speeches of one role, long enough, in a seeded sample."""
    rows = table
    if "speaker_role" in table.columns:
        rows = rows.where(F.col("speaker_role") == role)
    if "translated_text" in table.columns:
        tt = F.col("translated_text")
        rows = rows.where(tt.isNull() | (T.strip(tt) == ""))
    rows = rows.where(F.col("text").isNotNull() & (T.word_count("text") >= min_words)).select(
        F.col(id_col).alias("doc_id"), "text")
    if max_docs is None:
        return rows
    return rows.orderBy(seeded.uniform(seed, "doc_id"), "doc_id").limit(max_docs)


# Annotation targets in label priority order; age and disability share one.
TARGETS = ("race", "religion", "gender", "sexuality", "origin", "age", "disability")


def annotations(table: DataFrame, min_tokens: int = 30, order: str | None = None) -> DataFrame:
    """One row per comment from one row per annotator, with the priority label 0..7."""
    first = F.min_by("text", order) if order else F.first("text")
    means = [F.avg(f"target_{t}").alias(t) for t in TARGETS]
    rows = table.groupBy("comment_id").agg(
        first.alias("text"), *means, F.avg("hate_speech_score").alias("score"))
    label = F.when(F.col("score") > 0, 6).otherwise(7)
    label = F.when(F.greatest(F.coalesce("age", F.lit(0.0)), F.coalesce("disability", F.lit(0.0))) >= 0.5,
                   5).otherwise(label)
    for i in range(4, -1, -1):
        label = F.when(F.col(TARGETS[i]) >= 0.5, i).otherwise(label)
    return rows.select(F.col("comment_id").alias("doc_id"), "text", label.alias("label"), "score").where(
        T.word_count("text") >= min_tokens)


def dedup_text(docs: DataFrame) -> DataFrame:
    """The first occurrence of each exact text.

    A hash of the text is the key and the smallest id wins, combined on the map side,
    so any number of copies costs one row per task. The text is compared too.
    """
    return docs.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy(
        F.xxhash64("text").alias("_h"), "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


def pipe_cells(table: DataFrame, column: str, model: str, k: int | Column) -> DataFrame:
    """Pipe-separated cells of one model and K as trimmed rows."""
    rows = table.where((F.col("model") == model) & (F.col("k") == k) & F.col(column).isNotNull())
    keep = [c for c in ("corpus", "model", "k", "topic_id") if c in table.columns]
    return rows.select(*keep, F.explode(F.split(column, r"\|")).alias("item")).withColumn(
        "item", T.strip("item")).where(F.col("item") != "")


def best_k(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """The chosen K per (corpus, model)."""
    return wanted.join(table.select("corpus", "model", "k"), ["corpus", "model"])


def embeddings(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(doc_id, vec)`` from a stored embedding table."""
    return table.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("vec"))


def sample_per_class(rows: DataFrame, n: int, label: str = "label", seed: int | None = 0) -> DataFrame:
    """``n`` documents of each class, in a seeded order or (``seed=None``) the first ids."""
    first = [F.col("doc_id")] if seed is None else [seeded.uniform(seed, "doc_id"), F.col("doc_id")]
    w = Window.partitionBy(label).orderBy(*first)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def filter_labels(rows: DataFrame, below: int, label: str = "label") -> DataFrame:
    """Rows of the frequent classes, those with a code under ``below``."""
    return rows.where(F.col(label) < below)


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def preflight(corpora: dict[str, DataFrame]) -> DataFrame:
    """One row per corpus with its size and whether it is usable."""
    out = None
    for name, docs in corpora.items():
        part = docs.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("corpus"), "n", (F.col("n") > 0).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out
