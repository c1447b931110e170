"""Consecutive numbers and running sums over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage


def with_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """Number rows 0, 1, ... in the given order.

    A range-partitioned sort is materialised, then every partition is shifted by the row counts of
    the ones before it; only that table of counts (one row per partition) meets in one task.
    """
    placed = cut_lineage(df.orderBy(*order).withColumns(
        {"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    return shifted(placed, ["_part"], "_seq", name, placed.rdd.getNumPartitions()).drop("_part", "_seq")


SENT = 10_000  # offsets of more partitions than this are joined, not sent to every task


def shifted(placed: DataFrame, part: list[str], seq: str, name: str, parts: int, skipped: Column | None = None) -> DataFrame:
    """Turn per-partition sequence numbers into global ones; ``part`` orders the partitions.

    ``parts`` bounds their number. ``skipped`` says how many rows at the head of a partition drop out.
    """
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    skip = F.lit(0) if skipped is None else skipped
    offsets = (placed.groupBy(*part).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
               .select(*part, "_first", skip.alias("_skip"), F.coalesce(F.sum(F.col("_n") - skip).over(before), F.lit(0)).alias("_before")))
    numbered = placed.join(F.broadcast(offsets) if parts <= SENT else offsets, part)
    at = F.col(seq) - F.col("_first") - F.col("_skip")
    return numbered.where(at >= 0).withColumn(name, at + F.col("_before")).drop("_first", "_skip", "_before")


def running_sum(df: DataFrame, key: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the unique integer ``key``.

    Sums inside key blocks run in parallel; only one total per block is summed in one task.
    """
    blocked = df.withColumn("_block", F.expr(f"{key} div {block}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
              .select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.join(totals, "_block")
            .withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_block", "_before"))
