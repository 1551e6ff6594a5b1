"""Exclusive running sums within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.runtime import cut, shuffle_partitions


def grouped_prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, whole: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come earlier by ``order``; and ``whole``,
    the sum over all rows of the keys, if a name for it is given.

    Rows are range-partitioned by keys and order, summed inside each partition, and shifted by the totals of the
    group's earlier partitions. A group that holds a third of all rows is spread over a third of the partitions; the
    only per-group window is over at most one row per partition. Rows equal in keys and order must be one row.
    Null keys are grouped together. An empty input gives an empty result.
    """
    spark = df.sparkSession
    placed = cut(
        df.repartitionByRange(shuffle_partitions(spark), *keys, *order).withColumn("__part", F.spark_partition_id())
    )
    totals = placed.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__q")).agg(
        F.sum(value).alias("__total")
    )
    earlier = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    every = [F.sum("__total").over(Window.partitionBy(*[f"__k_{k}" for k in keys])).alias("__whole")] if whole else []
    shifts = totals.select(
        *[f"__k_{k}" for k in keys], "__q", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__shift"), *every
    )
    same = F.col("__part") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    local = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(shifts, same, "left")
        .withColumn(out, F.col("__local") + F.col("__shift"))
        .select(*df.columns, out, *([F.col("__whole").alias(whole)] if whole else []))
    )
