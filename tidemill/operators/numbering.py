"""Numbers in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut


def numbered(rows: DataFrame, *order: Column | str, column: str = "nth", start: int = 0) -> DataFrame:
    """`rows` with their places in `order` from `start` + 1. Rows are dealt by ranges, numbered in each, and ranges shifted by those before.

    The dealt rows are written once: the ranges come from a sample, and another run of the plan could draw others.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("_range"), before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(shifts), "_range").withColumn(column, (nth + F.col("_before") + start).cast("long")).drop("_range", "_before")
