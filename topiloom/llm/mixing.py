"""Mixing sources to target weights, with built-in functions only.

The words of each source are summed, and sources, ordered by code point with null last, get
the weights 5, 2, 1, 5, 2, 1, ... Together they are to give ``share`` times all words. A
source's target is ``level`` times its weight, but at most ``most`` times its own words; what
a source cannot take is shared again by weight until none is above its limit. That raises
``level`` round by round, each round one aggregate over the table of sources:

    level = (share * all words - limits of the full sources) / weights of the others

The repetition rate of a source is its target over its words. A document is emitted
floor(rate) times, and once more if a draw seeded with its id and text falls below the
fraction. A draw depends on nothing else, so reruns and recomputed tasks agree.

Word counts are added up in the task before anything moves, so a hot source costs a number a
task. The table of sources goes to every task only when its counted rows prove it small;
otherwise it is joined in salted copies.

Null or empty texts have size 0 and a null source is a source of its own. Rows that repeat an
id and a text share a draw; a null id draws by its text alone. Without any word all targets
and copies are 0. An empty table gives an empty result. Input columns named like a result
column are replaced by it; names that start with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiloom.functions import seeded
from topiloom.functions.rank import numbered

from .tables import join_side, keep_rest, settle, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = 13
RESULT = ("size", "source_size", "target", "rate", "copies")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_rates(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate) of every source."""
    sizes = docs.select("source", words(F.col("text")).alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_rank")
    sources = settle(ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))).drop("_rank"), "sources")
    limit = most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        held, left = sources.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (share * total - most * (held or 0)) / left if left else level
        if raised <= level:
            break
        level = raised
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with (size, source_size, target, rate, copies): how often the mix takes each row."""
    rates = source_rates(docs, weights, share, most)
    rows = docs.select(*keep_rest(docs, *RESULT), words(F.col("text")).alias("size"))
    out = join_side(rows, rates.drop("weight"), "source", 96, F.xxhash64("doc_id", "text"))
    whole = F.floor("rate")
    draw = seeded.uniform(seed, "doc_id", F.md5(F.col("text")))
    return out.withColumn("copies", (whole + F.when((F.col("rate") > whole) & (draw < F.col("rate") - whole), 1).otherwise(0)).cast("long"))


def emit(planned: DataFrame) -> DataFrame:
    """The mix itself: every row ``copies`` times, numbered by ``copy`` from 1."""
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op13_mixing(spark, sf_dir):
    """Whole ``documents``: size, target of the source, and the words that the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS MATERIALIZED (
  SELECT source, source_size, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
steps AS (
  SELECT source_size, weight, n, (1.5::DOUBLE * all_words - 2 * coalesce(held, 0)) / (all_weights - coalesce(given, 0)) AS level FROM (
    SELECT source_size, weight, row_number() OVER w AS n, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights,
      sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
      sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS given
    FROM src WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST))),
lv AS (SELECT coalesce((SELECT level FROM steps WHERE 2 * source_size > level * weight ORDER BY n LIMIT 1), 0.0::DOUBLE) AS level),
rates AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM (
    SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM src, lv))
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN rate > floor(rate) AND
  CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), md5(text))), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
