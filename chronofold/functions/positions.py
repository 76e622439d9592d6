"""Running sums and positions over whole streams, without a window that holds a stream.

Rows first get a `_slice` that rises with their order. Each slice sums for itself and adds what the earlier
slices of its group hold; only the table of slices is windowed per group. A stream that has all rows is so
spread over as many tasks as it has slices.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.shared import checkpoint

#: Rows of a slice where positions are whole numbers.
STEP = 100_000


def in_steps(df: DataFrame, position: str, step: int = STEP) -> DataFrame:
    """Slices of rows ordered by a whole number; lazy. A null position comes first, in a slice of its own."""
    return df.withColumn("_slice", F.coalesce(F.floor(F.col(position) / step), F.lit(-(2**62))))


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Slices of rows by any order (the group's columns first): dealt by ranges, as many as the session has shuffle
    partitions, and written, so that bounds and slices are fixed when they are read twice. Runs a job."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` from the first row of the group up to and with this one; `_slice` stays.
    Null groups are groups. Rows that tie in `order` take their sums one after another, in any order."""
    per = rows.groupBy(*by, "_slice").agg(F.sum(value).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_slice") == F.col("_at"))
    out = rows.withColumn("_inside", inside).join(per, same)
    return out.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... in each group by `order`; the slices go."""
    return running(rows, by, order, F.lit(1).cast("bigint"), name).drop("_slice")
