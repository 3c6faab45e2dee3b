"""Table state: corpus hash, signatures, artefact stores, run records."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
HASH_BUCKET = 1_000


def corpus_hash(docs: DataFrame, bucket: int = HASH_BUCKET) -> DataFrame:
    """``(n_docs, digest)``: order-sensitive, changes with any edited text.

    Texts are hashed in place. A block of ``bucket`` consecutive ids is one digest, and
    blocks are digested the same way until one is left, so a task sees at most
    ``bucket`` short hashes at once.
    """
    def digest(rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy(key.alias("b")).agg(
            F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))),
                                            lambda s: s["h"]), "|")).alias("h"),
            F.sum("n").alias("n"))

    level = docs.select(F.col("doc_id").alias("i"), F.sha1(F.coalesce("text", F.lit(""))).alias("h"),
                        F.lit(1).alias("n"))
    top = docs.agg(F.max(F.abs("doc_id"))).first()[0] or 0
    while True:
        top //= bucket
        level = digest(level, F.floor(F.col("i") / bucket)).select(F.col("b").alias("i"), "h", "n")
        if top < bucket:
            break
    return digest(level, F.lit(0)).select(F.col("n").alias("n_docs"), F.col("h").alias("digest"))


def signature(docs: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """``(key, value)``: the corpus hash and every setting the artefacts depend on."""
    spark = docs.sparkSession
    h = corpus_hash(docs).select(F.lit("corpus_hash").alias("key"), F.col("digest").alias("value"))
    rows = [(k, json.dumps(sorted(v) if isinstance(v, (set, frozenset)) else v))
            for k, v in sorted(config.items())]
    return h.unionByName(spark.createDataFrame(rows, "key string, value string")) if rows else h


def signature_diff(cached: DataFrame, current: DataFrame) -> DataFrame:
    """``(key, old, new)`` for keys whose value changed, appeared or went."""
    a = cached.select("key", F.col("value").alias("old"))
    b = current.select("key", F.col("value").alias("new"))
    return a.join(b, "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def _write_manifest(spark: SparkSession, path: str, manifest: Mapping[str, object]) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/manifest")


def _read_manifest(spark: SparkSession, path: str) -> dict | None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    lines = [r["value"] for r in spark.read.text(f"{path}/manifest").collect()]
    try:
        out = json.loads(lines[0]) if lines else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def save_tables(path: str, kind: str, tables: Mapping[str, DataFrame],
                meta: Mapping[str, object] | None = None) -> None:
    """Write the tables as Parquet and the manifest last, which commits the store."""
    spark = next(iter(tables.values())).sparkSession
    columns = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        columns[name] = df.columns
    _write_manifest(spark, path, {"kind": kind, "format": FORMAT, "tables": columns,
                                  "meta": dict(meta or {})})


def load_tables(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """The committed tables; a missing, foreign, newer or incomplete store is refused."""
    m = _read_manifest(spark, path)
    if m is None:
        raise ValueError(f"{path}: no readable manifest, the store was never committed")
    if m.get("kind") != kind:
        raise ValueError(f"{path}: holds {m.get('kind')!r}, expected {kind!r}")
    if m.get("format", 0) > FORMAT:
        raise ValueError(f"{path}: format {m['format']} is newer than {FORMAT}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in m["tables"]}
    for name, cols in m["tables"].items():
        if tables[name].columns != cols:
            raise ValueError(f"{path}: table {name} has columns {tables[name].columns}, expected {cols}")
    return tables, m["meta"]


def save_parse(path: str, tables: Mapping[str, DataFrame], sig: DataFrame) -> None:
    """Parse artefacts with the signature they were made under."""
    save_tables(path, "parse", tables, {r["key"]: r["value"] for r in sig.collect()})


def load_parse(spark: SparkSession, path: str, sig: DataFrame) -> tuple[dict[str, DataFrame] | None, list[str]]:
    """The stored artefacts, or ``None`` and the reasons they cannot be used."""
    try:
        tables, meta = load_tables(spark, path, "parse")
    except ValueError as exc:
        return None, [str(exc)]
    if not meta:
        return None, ["the store carries no signature"]
    now = {r["key"]: r["value"] for r in sig.collect()}
    why = [f"{k}: {meta.get(k)} -> {now.get(k)}" for k in sorted(set(meta) | set(now))
           if meta.get(k) != now.get(k)]
    return (None, why) if why else (tables, [])


def save_model(path: str, theta: DataFrame, phi: DataFrame, vocab: DataFrame,
               config: Mapping[str, object], docs: DataFrame | None = None) -> None:
    """Fitted-model state; the corpus only on request."""
    tables = {"theta": theta, "phi": phi, "vocab": vocab}
    if docs is not None:
        tables["documents"] = docs
    save_tables(path, "model", tables, {"config": dict(config)})


def load_model(spark: SparkSession, path: str, known: Sequence[str] = ()) -> tuple[dict[str, DataFrame], dict]:
    """Model tables and settings, checked for agreement; unknown settings are dropped."""
    tables, meta = load_tables(spark, path, "model")
    for name in ("theta", "phi", "vocab"):
        if name not in tables:
            raise ValueError(f"{path}: table {name} is missing")
    n_vocab = tables["vocab"].count()
    top = tables["phi"].agg(F.max("term_id"), F.count_distinct("term_id")).first()
    if top[0] is not None and (top[0] >= n_vocab or top[1] > n_vocab):
        raise ValueError(f"{path}: phi has term {top[0]} but the vocabulary {n_vocab} terms")
    config = meta.get("config", {})
    return tables, {k: v for k, v in config.items() if not known or k in known}


RUN_KEY = ("corpus", "model", "seed", "k")


def pending(grid: DataFrame, runs: DataFrame | None, metric: str | None = None) -> DataFrame:
    """Grid points without a finished run; with ``metric`` a run that lacks it is unfinished."""
    if runs is None:
        return grid
    done = runs
    if metric is not None:
        done = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return grid.join(done.select(*RUN_KEY).distinct(), list(RUN_KEY), "left_anti")


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def word_cells(topic_words: DataFrame, mwe: DataFrame) -> DataFrame:
    """One row per topic with pipe-joined words and phrases."""
    def joined(rows, col, name):
        return rows.groupBy("topic").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", col))), lambda s: s[col]), " | ").alias(name))

    return joined(topic_words, "term", "keywords").join(
        joined(mwe, "phrase", "mwe_phrases"), "topic", "left").select(
        (F.col("topic") + 1).alias("topic_id"), "keywords",
        F.coalesce("mwe_phrases", F.lit("")).alias("mwe_phrases"))
