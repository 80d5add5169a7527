"""Batches of inputs: what is still to be done, how a batch went, what is carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that ``done`` (whole outputs, by the same key) does not have."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def summary(log: DataFrame, by: str) -> DataFrame:
    """(by, total, oversized, skipped, succeeded, failed) of a run log with an ``outcome`` for each input."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[n(k) for k in ("oversized", "skipped", "succeeded", "failed")])


def failures(log: DataFrame) -> DataFrame:
    """A row for each input that failed."""
    return log.where("outcome = 'failed'").drop("outcome")


def capped(failed: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` failures of each group, numbered 001, 002 …; the cap is the rule's own."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return failed.withColumn("_n", n).where(F.col("_n") <= most).withColumn("no", F.format_string("%03d", "_n")).drop("_n")


def carried(rows: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null, of this row or one before it."""
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(run))
