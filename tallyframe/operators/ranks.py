"""Exact middle values of columns of any length, without bringing a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut


def middles(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """One row per group (one in all for none): `lower` and `upper` middle of the values that are not null.

    Equal values are counted first. The counts are dealt by ranges, summed within each range, and a range
    starts where those before it end; only one row per range and group is ever brought together."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = cut(counted.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(*group)
    ranges = dealt.groupBy(*group, "_range").agg(F.sum("_n").alias("_size")).select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_range").alias("_at"),
        F.sum("_size").over(whole).alias("_total"),
        (F.sum("_size").over(whole.orderBy("_range")) - F.col("_size")).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)], F.col("_range") == F.col("_at"))
    within = Window.partitionBy(*group, "_range").orderBy(value)
    placed = dealt.withColumn("_upto", F.sum("_n").over(within)).join(ranges, same)
    end = F.col("_before") + F.col("_upto")

    def at(rank: str):
        return F.max(F.when((end > F.expr(rank)) & (end - F.col("_n") <= F.expr(rank)), F.col(value)))

    return placed.groupBy(*group).agg(at("(_total - 1) div 2").alias("lower"), at("_total div 2").alias("upper"))
