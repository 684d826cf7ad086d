"""Running aggregates over an order of all rows, without a task that sees all rows.

Rows are dealt out by ranges of the order; each range runs by itself, and what the ranges before it come to, one row a range,
is put on top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """df with a column `out`: the sum (or minimum, maximum) of value over the rows of the same group up to each row."""
    part = "_ordered_part"
    dealt = df.withColumn("_ordered_value", value).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id())
    dealt = scratch.cut(dealt)
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ends = dealt.groupBy(*group, part).agg(total("_ordered_value").alias("_ordered_end"))
    ends = ends.withColumn("_ordered_before", total("_ordered_end").over(before)).drop("_ordered_end")
    both = F.array_compact(F.array(total("_ordered_value").over(inside), "_ordered_before"))
    joined = dealt.join(F.broadcast(ends), [*group, part])
    whole = F.aggregate(both, F.lit(0).cast(joined.schema["_ordered_before"].dataType), lambda a, x: a + x) if total is F.sum else (F.array_min(both) if total is F.min else F.array_max(both))
    return joined.withColumn(out, whole).drop(part, "_ordered_value", "_ordered_before")
