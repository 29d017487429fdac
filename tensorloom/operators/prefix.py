"""Running sums and ranks over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.sources.cut import written


def running(df: DataFrame, order: list[Column | str], value: Column, name: str = "upto") -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one, in the order given, which must tell rows apart.

    Rows are dealt by ranges of the order and written; each range adds the sum of those before it to its own.
    """
    ranged = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # as many rows as there are ranges
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_value", "_inside", "_before")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds the rank from 1 of each row."""
    return running(df, order, F.lit(1).cast("long"), name)
