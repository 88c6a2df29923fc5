"""Summaries for reports: distributions, histograms of counts, roll-ups, contracts between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """min, median, p95, max, mean of a whole number, per group.

    The median of n values is value n // 2 in order (from 0), p95 the nearest rank, the mean is rounded half even
    to two digits. Both ranks are read from cumulative counts of distinct values, so no list of a group is built.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("c")) if by else df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.where("v IS NOT NULL")
    w = Window.partitionBy(*by)
    run = counts.withColumns({"up": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    at = lambda rank: F.min(F.when(F.col("up") > rank, F.col("v")))
    p95 = F.greatest(F.ceil(F.col("n") * F.lit("0.95").cast("decimal(3,2)")) - 1, F.lit(0))
    mean = F.bround(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 2)
    return run.groupBy(*by).agg(F.min("v").alias("min"), at(F.floor(F.col("n") / 2)).alias("median"), at(p95).alias("p95"), F.max("v").alias("max"), mean.alias("mean"))


def count_histogram(df: DataFrame, key: str) -> DataFrame:
    """(samples, keys): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("samples")).groupBy("samples").agg(F.count(F.lit(1)).alias("keys"))


def totals(df: DataFrame, by: str, *measures: Column) -> DataFrame:
    """One row per value and one for all (null), by a roll-up."""
    return df.rollup(by).agg(*measures)


def scopes(df: DataFrame, scope: str, *measures: Column) -> DataFrame:
    """Overall and per scope in one pass."""
    return df.cube(scope).agg(*measures)


def split_contract(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(train, held_out, shared): distinct keys in train, in the other splits, and in both."""
    k = rows.groupBy(key).agg(F.max((F.col(split) == "train").cast("int")).alias("t"), F.max((F.col(split) != "train").cast("int")).alias("h"))
    return k.agg(F.sum("t").alias("train"), F.sum("h").alias("held_out"), F.sum(F.col("t") * F.col("h")).alias("shared"))


def throughput(records: int, seconds: float) -> float:
    return round(records / seconds, 3) if seconds > 0 else 0.0
