"""Running sums and numbers in an order, without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import staging


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with name: the sum of value (whole numbers) over the row and those before it in its key. Rows that keys and order don't tell apart follow each other in any order.

    Rows are dealt to ranges of (keys, order), so a large key is cut into many; each range adds what the key's ranges before it sum to. Only these
    sums, a row for each key and range, are put in order together. Null values count as 0; null keys are a key.
    """
    spark = rows.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    dealt = rows.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(many, *by).withColumn("_range", F.spark_partition_id())
    dealt = staging.stage(dealt)  # a range's rows must be the same for its sum and for its rows
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a range goes on with one key at most from the ranges before it, so those with a sum are no more than ranges
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"), F.sum("_sum").over(before).alias("_before")).where("_before <> 0")
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("_within", F.sum("_value").over(within)).join(F.broadcast(sums), same, "left")
    return out.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_within")).alias(name))
