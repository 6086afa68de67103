"""Order of arrival, and running statistics over it, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.session import cut, partitions


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """``df`` in ranges of ``order``, numbered by ``_range``; written, since ranges are drawn anew each time."""
    return cut(df.repartitionByRange(partitions(df.sparkSession), order).withColumn("_range", F.spark_partition_id()))


def with_sequence(df: DataFrame, order: str, out: str = "seq") -> DataFrame:
    """``df`` with the number of each row by ``order``, from 1. The values of ``order`` are distinct."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_range").count()  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    within = Window.partitionBy("_range").orderBy(order)
    return rows.join(offsets, "_range").withColumn(out, F.row_number().over(within) + F.col("_offset")).drop("_range", "_offset")


def running_averages(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(order, n, avg_<column>...): over all rows up to each, the number of rows and the averages."""
    rows = _ranged(df.select(order, *columns), order)
    sums = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_n", *[f"_{c}" for c in columns]]
    offsets = F.broadcast(sums.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names]))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(within) + F.col("_n")
    averages = [((F.sum(c).over(within) + F.col(f"_{c}")) / n).alias(f"avg_{c}") for c in columns]
    return rows.join(offsets, "_range").select(order, n.alias("n"), *averages)
