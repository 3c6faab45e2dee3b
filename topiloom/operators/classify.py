"""Downstream classification of documents and the LDA baseline."""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import seeded
from ..functions import text as T
from ..functions.rank import running
from ..session import hold, settle, stage_path
from . import vocab as V


TASK_CELLS = 500_000     # rows times features that a task of a regression should have at least


def compact(data: DataFrame) -> DataFrame:
    """Held rows in as many tasks as their features fill: a regression makes hundreds of passes."""
    n, first = data.count(), data.select("features").first()
    cells = n * (len(first[0]) if first is not None else 0)
    return data.coalesce(max(1, min(data.rdd.getNumPartitions(), -(-cells // TASK_CELLS))))


def folds(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: a seeded order inside each label dealt round-robin, so folds are stratified.

    Ranks inside a seeded bucket of the label keep a frequent label off a single task;
    each bucket is dealt from its own start.
    """
    b = F.floor(seeded.uniform(f"{seed}b", "doc_id") * 64).cast("int")
    w = Window.partitionBy("label", "_b").orderBy(seeded.uniform(seed, "doc_id"), "doc_id")
    return rows.withColumn("_b", b).withColumn(
        "fold", F.pmod(F.row_number().over(w) - 1 + F.col("_b"), F.lit(k)).cast("int")).drop("_b")


def balanced(rows: DataFrame) -> DataFrame:
    """Adds ``weight = n / (K * n_class)``."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(sizes.values()), max(len(sizes), 1)
    w = F.lit(1.0)
    for label, c in sizes.items():
        w = F.when(F.col("label") == label, n / (k * c)).otherwise(w)
    return rows.withColumn("weight", w)


def macro_f1s(pred: DataFrame, group: list[str]) -> dict[tuple, float]:
    """Macro F1 of each group of ``pred(group, label, prediction)``, from its confusion counts."""
    counts: dict[tuple, dict[tuple, int]] = {}
    for r in pred.groupBy(*group, "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(tuple(r[g] for g in group), {})[r["label"], r["prediction"]] = r["n"]
    out = {}
    for key, cm in counts.items():
        scores = []
        for c in {x for pair in cm for x in pair}:
            wrong = sum(n for pair, n in cm.items() if (pair[0] == c) != (pair[1] == c))
            scores.append(2 * cm.get((c, c), 0) / (2 * cm.get((c, c), 0) + wrong))
        out[key] = sum(scores) / len(scores)
    return out


def macro_f1(pred: DataFrame) -> float:
    """Macro F1 of ``pred(label, prediction)``, NaN without rows."""
    return macro_f1s(pred, []).get((), float("nan"))


def aucs(scored: DataFrame, group: list[str]) -> DataFrame:
    """``(group, auc)``: area under the ROC curve of ``scored(group, y, s)`` by average ranks.

    Equal scores are counted first; their ranks run over range partitions, for all groups at
    once. A group of one class has a null area.
    """
    g = settle(scored.groupBy(*group, "s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")), "scores")
    ranked = running(g, ["s"], F.col("n"), "below", group=group).withColumn("r", F.col("below") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*group).agg(F.sum(F.col("r") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * q, F.lit(0.0))
    return sums.select(*group, area.alias("auc"))


def auc(scored: DataFrame) -> float:
    """The area of one set of scores, NaN if it has one class only."""
    r = aucs(scored.withColumn("_all", F.lit(0)), ["_all"]).first()
    return float("nan") if r is None or r["auc"] is None else float(r["auc"])


def _fit(train: DataFrame, seed: int, scale: bool, balance: bool, centre: bool = True, max_iter: int = 200):
    stages = []
    data = balanced(train) if balance else train.withColumn("weight", F.lit(1.0))
    if scale:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=centre, withStd=True).fit(data)
        stages.append(scaler)
        data = scaler.transform(data)
    n = train.count()
    # The penalty is a sum over rows in the usual C = 1 form, hence 1 / n per row here.
    model = LogisticRegression(featuresCol="scaled" if scale else "features", labelCol="label",
                               weightCol="weight", maxIter=max_iter, regParam=1.0 / max(n, 1)).fit(data)
    stages.append(model)
    return stages


def _predict(stages, rows: DataFrame) -> DataFrame:
    for s in stages:
        rows = s.transform(rows)
    return rows


def _features(rows: DataFrame) -> DataFrame:
    """Rows with an array ``vec``, or with ``features`` that are vectors already."""
    return rows.select("doc_id", F.col("label").cast("double").alias("label"),
                       F.col("features") if "features" in rows.columns else array_to_vector("vec").alias("features"))


def holdout_f1(rows: DataFrame, test_share: float = 0.2, seed: int = 42) -> float:
    """Macro F1 of a logistic regression on ``rows(doc_id, label, vec)``, stratified split."""
    parts = max(2, round(1.0 / test_share))
    data = hold(folds(_features(rows), parts, seed))
    stages = _fit(data.where("fold <> 0"), seed, scale=False, balance=False)
    score = macro_f1(_predict(stages, data.where("fold = 0")))
    data.unpersist()
    return score


def cross_validate(rows: DataFrame, k: int = 5, seed: int = 42, max_iter: int = 200) -> dict[str, float]:
    """Stratified k-fold macro F1 and AUC with scaling and balanced class weights.

    More than two classes give the one-vs-rest macro AUC. Sparse ``features`` are scaled without
    being centred, so that they stay sparse.
    """
    centre = "features" not in rows.columns
    held = hold(folds(_features(rows), k, seed))
    data = compact(held)
    classes = sorted(r[0] for r in data.select("label").distinct().collect())

    def scored(f: int) -> DataFrame:
        stages = _fit(data.where(F.col("fold") != f), seed, scale=True, balance=True, centre=centre, max_iter=max_iter)
        return _predict(stages, data.where(F.col("fold") == f)).select(
            "fold", "label", "prediction", vector_to_array("probability").alias("p"))

    with ThreadPool(k) as pool:             # the folds' jobs share the cluster
        parts = pool.map(scored, range(k))
    pred = settle(reduce(DataFrame.unionByName, parts), "predictions")
    held.unpersist()
    f1s = [v for _, v in sorted(macro_f1s(pred, ["fold"]).items())]
    pos = classes[1:] if len(classes) == 2 else classes
    rated = F.explode(F.array(*[F.struct(F.lit(int(c)).alias("c"), (F.col("label") == c).cast("int").alias("y"), F.coalesce(F.get("p", F.lit(int(c))), F.lit(0.0)).alias("s")) for c in pos]))
    each: dict[int, list[float]] = {}
    if pos:
        for r in aucs(pred.select("fold", rated.alias("r")).select("fold", "r.c", "r.y", "r.s"), ["fold", "c"]).collect():
            each.setdefault(r["fold"], []).append(float("nan") if r["auc"] is None else r["auc"])
    areas = [sum(v) / len(v) for _, v in sorted(each.items())]
    ok = [a for a in areas if not math.isnan(a)]

    def mean(v):
        return sum(v) / len(v) if v else float("nan")

    def sd(v):
        return math.sqrt(sum((x - mean(v)) ** 2 for x in v) / len(v)) if v else float("nan")

    return {"f1_macro_mean": mean(f1s), "f1_macro_std": sd(f1s), "auc_mean": mean(ok), "auc_std": sd(ok)}


def downstream(feature_sets: dict[str, DataFrame | None], k: int = 5, seeds=(42,), max_iter: int = 2000) -> DataFrame:
    """``(features, f1_macro, f1_macro_std, auc, auc_std)``: means over seeds, NaN ignored.

    A set without any feature is ``None`` and has null scores.
    """
    spark = next(x for x in feature_sets.values() if x is not None).sparkSession
    out = []
    for name, rows in feature_sets.items():
        if rows is None:
            out.append((name, None, None, None, None))
            continue
        rows = settle(rows, "features")         # the seeds read what is made once
        with ThreadPool(max(1, len(seeds))) as pool:
            runs = pool.map(lambda s, rows=rows: cross_validate(rows, k, s, max_iter), seeds)

        def mean(key, runs=runs):
            v = [r[key] for r in runs if not math.isnan(r[key])]
            return sum(v) / len(v) if v else None

        out.append((name, mean("f1_macro_mean"), mean("f1_macro_std"), mean("auc_mean"), mean("auc_std")))
    return spark.createDataFrame(
        out, "features string, f1_macro double, f1_macro_std double, auc double, auc_std double")


def tfidf_features(labelled: DataFrame, docs: DataFrame, min_df: int = 3, max_features: int = 20_000) -> DataFrame | None:
    """``labelled(doc_id, label)`` with sparse ``features``: the baseline of words and word pairs.

    Words are runs of two or more word characters of the lower-cased ``docs(doc_id, text)``, no
    word is left out; pairs are neighbours. Terms, their numbers of documents and their weights
    are taken from the labelled documents. A document without a term has no entry. ``None`` if
    no term is in ``min_df`` documents.
    """
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD_RUN), F.lit(1)), lambda w: F.length(w) >= 2)
    ids = settle(labelled.select("doc_id").distinct(), "labelled")
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", words.alias("w")).select(
        "doc_id", F.concat("w", T.ngrams("w", 2)).alias("tokens"))
    counts = V.token_counts(texts)
    vocab = settle(V.build_vocab(counts, min_df, max_features), "terms")
    size = vocab.count()
    if size == 0:
        return None
    cells = settle(V.bow(counts, vocab, max_features).select("doc_id", "term_id", "cnt"), "cells")
    rows = V.doc_rows(V.tfidf(cells, ids.count(), max_features).withColumnRenamed("weight", "cnt"))
    empty = F.array().cast("array<double>")
    return sparse_vectors(labelled.select("doc_id", "label").join(rows, "doc_id", "left").select(
        "doc_id", "label", F.coalesce("ids", empty.cast("array<int>")).alias("ids"), F.coalesce("cnts", empty).alias("cnts")), size)


def sparse_vectors(docs: DataFrame, size: int) -> DataFrame:
    """``features`` from ``(ids, cnts)`` with sorted ids, as sparse vectors; other columns stay.

    A vector is stored as a struct of its kind, size, places and values. That struct is written
    and read back under the vector type, so no row passes through Python.
    """
    spark = docs.sparkSession
    path = stage_path(spark, "vectors")
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                     F.col("ids").cast("array<int>").alias("indices"), F.col("cnts").cast("array<double>").alias("values"))
    rest = [f for f in docs.schema if f.name not in ("ids", "cnts")]
    docs.select(*[f.name for f in rest], parts.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([*rest, StructField("features", VectorUDT())])).parquet(path)


def lda(docs: DataFrame, vocab: DataFrame, n_terms: int, k: int, seed: int = 42, max_iter: int = 5,
        top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """LDA baseline on ``docs(doc_id, ids, cnts)``: topic words and document mixtures."""
    rows = sparse_vectors(docs.where(F.size("ids") > 0), n_terms)
    model = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online", featuresCol="features").fit(rows)
    words = (
        model.describeTopics(top_k)
        .select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("p", "t"))
        .select("topic", (F.col("p") + 1).alias("rank"), F.col("t.termIndices").alias("term_id"),
                F.col("t.termWeights").alias("weight"))
        .join(vocab.select("term_id", "term"), "term_id").select("topic", "rank", "term", "weight")
    )
    theta = model.transform(rows).select(
        "doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    return words, theta
