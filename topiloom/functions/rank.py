"""Exact ranks over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

_BITS = 33  # monotonically_increasing_id keeps the row in these bits and the partition above


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order.

    Rows are dealt to range partitions, sorted there and written once; a row's number is its
    place in its partition plus the rows of the partitions before. Only one count for each
    partition passes through a single task. Equal rows in ``order`` land in one partition, so
    end the order with a column that tells repeated values apart.
    """
    held = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _BITS)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list[str], column: Column, name: str, how: str = "sum", group: list[str] | None = None,
            inclusive: bool = False) -> DataFrame:
    """``df`` with the sum or maximum of ``column`` over the rows before each one, by group.

    The order runs over range partitions of (group, order), so a hot group is spread over many
    tasks: each adds up its own rows, and what the earlier partitions of the group add is one
    value for each partition. Sums start at 0 and maxima at null; ``inclusive`` counts the
    row itself. Rows equal in ``order`` are taken one after another in no fixed sequence.
    """
    group = list(group or [])
    total = {"sum": F.sum, "max": F.max}[how]
    first = F.lit(0) if how == "sum" else F.lit(None)
    held = settle(df.withColumn("_v", column).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "running")
    last = 0 if inclusive else -1
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    parts = held.groupBy(*group, "_part").agg(total("_v").alias("_own"))
    outer = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), total("_own").over(outer).alias("_carry"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = held.withColumn("_in", total("_v").over(inner)).join(carry, same)
    if how == "sum":
        value = F.coalesce("_in", first) + F.coalesce("_carry", first)
    else:
        value = F.greatest("_in", "_carry")
    return out.withColumn(name, value).drop("_v", "_part", "_p", "_own", "_in", "_carry", *[f"_g_{g}" for g in group])
