"""Running numbers and sums over a whole table without one task that reads it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few large files dealt to all cores, before work that takes long; otherwise as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _bucket(order: str, size: int) -> Column:
    """The whole quotient, rounded down; exact for all 64-bit numbers, which a division of doubles is not."""
    return F.expr(f"(`{order}` - pmod(`{order}`, {size}L)) div {size}L")


def _starts(totals: DataFrame, bucket: int, levels: int) -> DataFrame:
    """(__bucket, __start) of (__bucket, __total): the sum of the totals of all smaller buckets."""
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return totals.select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    grouped = totals.withColumn("__group", _bucket("__bucket", bucket))
    above = grouped.groupBy("__group").agg(F.sum("__total").alias("__total")).withColumnRenamed("__group", "__bucket")
    above = _starts(above, bucket, levels - 1).withColumnsRenamed({"__bucket": "__group", "__start": "__above"})
    inside = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__above") + F.coalesce(F.sum("__total").over(inside), F.lit(0))
    return grouped.join(above, "__group").select("__bucket", start.alias("__start"))


def running_sum(rows: DataFrame, order: str, value: Column, name: str, bucket: int = BUCKET, levels: int = 2) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``order`` (a unique whole number).

    Rows are summed within buckets of ``bucket`` order values, the totals of buckets within buckets of those, and so on
    for ``levels`` levels. No window holds more than ``bucket`` rows; with the defaults that is so for all 64-bit orders.
    """
    keyed = rows.withColumn("__bucket", _bucket(order, bucket)).withColumn("__value", value)
    starts = _starts(keyed.groupBy("__bucket").agg(F.sum("__value").alias("__total")), bucket, levels)
    inside = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(starts, "__bucket")
        .withColumn(name, (F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).cast("long"))
        .drop("__bucket", "__value", "__start")
    )


def row_numbers(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the 0-based number of each row in the order of a unique whole number."""
    return running_sum(rows, order, F.lit(1), name)
