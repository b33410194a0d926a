"""Metrics over ledgers, attempts and reports: exact aggregates, partial before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(attempts: DataFrame) -> DataFrame:
    """What landed downstream: successes and timeouts, whose answers were lost."""
    return attempts.where(F.col("fault").isin("ok", "timeout"))


def ledger_counts(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicate_effects(counts: DataFrame) -> Column:
    return F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - 1)), F.lit(0)).cast("long")


def percentile(values: DataFrame, value: str, p: float, *groups: str) -> DataFrame:
    """The value at place min(n - 1, floor(p * n)) of each group's sorted values.

    Counting equal values first leaves one row for each distinct value: a group's
    window then holds its distinct values, not its rows.
    """
    counted = values.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*groups).orderBy(value)
    total = F.sum("m").over(Window.partitionBy(*groups))
    place = F.least(total - 1, F.floor(F.lit(p) * total))
    ranked = counted.withColumn("upto", F.sum("m").over(w)).withColumn("place", place)
    return ranked.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("m") <= F.col("place"))).select(*groups, F.col(value).alias(f"p{round(p * 100)}"))


def round4(x: Column) -> Column:
    return F.floor(x * 1e4 + 0.5) / 1e4
