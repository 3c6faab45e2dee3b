"""Session, checkpoint and broadcast helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast, or brought to the driver, only when its number of
# rows (or matrix cells) is known to stay below these bounds.
BROADCAST_ROWS = 1_000_000
DRIVER_CELLS = 50_000_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("topiloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="topiloom-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table under the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a source that has fewer splits than cores.

    A large table already has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate that later steps read many times, and read it back.

    The result is a plain scan: short plans, real statistics, nothing to recompute
    when an executor is lost, and no memory kept.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def hold(df: DataFrame) -> DataFrame:
    """Keep a reused intermediate; lost blocks are recomputed from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def bounded(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its row bound is known and small, else leave it to AQE."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def by_repeats(rows: DataFrame, key: str = "doc_id") -> tuple[DataFrame | None, DataFrame | None]:
    """``rows`` whose key stands in one row, and those whose key stands in several.

    A part that is known to be empty is ``None``. If the repeated keys are too many to be sent
    to every task, all rows count as repeated.
    """
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_id"))
    several = settle(several, "ids")
    n = several.count()
    if n == 0:
        return rows, None
    if n > BROADCAST_ROWS:
        return None, rows
    known, same = F.broadcast(several), F.col(key).eqNullSafe(F.col("_id"))
    return rows.join(known, same, "left_anti"), rows.join(known, same, "left_semi")


def collect_bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> list:
    """Bring a small report table to the driver; refuse a larger one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"table has more than {limit} rows and must stay distributed")
    return rows
