"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topiloom.session import settle  # noqa: F401 (also used from here)

from .flat import column, tidied

#: A table may be sent to every executor only below this many bytes, measured first.
SEND_BYTES = 32 << 20
FILE_ROWS = 100_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(col: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of a text in UTF-8."""
    return F.sha2(col.cast("binary"), 256)


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of an id and a text that tells null from empty and where the id ends."""
    part = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (doc_id.cast("string"), text)]
    return F.md5(F.concat(*part))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a staged table for broadcast if its counted rows prove it small."""
    rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= SEND_BYTES else df


def join_side(df: DataFrame, side: DataFrame, key: str, row_bytes: int, spread: Column, salts: int = 64) -> DataFrame:
    """``df`` with the columns of a staged table that has one row for each key, null included.

    The table is sent to every task when its counted rows prove it small. Otherwise it is
    joined in ``salts`` copies, and ``spread`` deals the rows of a hot key over them.
    """
    side = side.withColumnRenamed(key, "_side")
    known = small(side, row_bytes)
    if known is not side:
        return df.join(known, F.col(key).eqNullSafe(F.col("_side")), "left").drop("_side")
    many = side.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    return dealt.join(many, F.col(key).eqNullSafe(F.col("_side")) & (F.col("_salt") == F.col("_of")), "left").drop("_side", "_salt", "_of")


def modest_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, in a session whose Arrow batches hold at most ``BATCH_BYTES``.

    Ten thousand long texts to a batch, the usual limit, would be hundreds of megabytes in
    the executor and again in its Python worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def keep_rest(df: DataFrame, *taken: str) -> list[str]:
    return [c for c in df.columns if c not in taken]


def staged(df: DataFrame, rows: int, name: str = "table") -> DataFrame:
    """``settle`` for a table of at most ``rows`` short rows: a file for each ``FILE_ROWS``.

    Small tables of an iteration would otherwise be spread over as many files as there are
    shuffle partitions, and the next step would start a task for each.
    """
    return settle(df.coalesce(max(1, -(-rows // FILE_ROWS))), name)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Apply ``work`` to each group of bounded size, one after another in a task."""
    def run(batches):
        for group in groups(batches, keys):
            out = work(group)
            if out is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(lambda it: tidied(run(it)), schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, component), component the smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots, and replaces the edges by edges between roots. Every step is an aggregate with
    partial sums or an equi-join whose hot keys Spark can split, and every round is written
    to the shared folder. Nodes without edges do not appear.
    """
    size = edges.count()
    left = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), size, "edges")
    found = None
    while size := left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), size, "roots")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nxt = staged(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), size, "roots")
            release(up)
            moved = not nxt.where("moved").isEmpty()
            up = nxt.drop("moved")
            if not moved:
                break
        at = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = staged(left.join(at, "a").join(to, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), size, "edges")
        release(left)
        left = nxt
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            both = staged(found.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), found.count(), "found")
            release(found, up)
            found = both
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.select("node", F.col("root").alias("component"))
