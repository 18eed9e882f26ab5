"""Aggregates over speeches, analyses and logs, each a single pass with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonzero(x: Column, digits: int) -> Column:
    """Rounded; an average of 0 counts as none."""
    return F.when(x != 0, F.round(x, digits))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0).cast("long")), F.lit(0.0))


def histogram(df: DataFrame, by: str) -> DataFrame:
    """Counts by value; null is a value."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Counts of the given values, absent ones with 0."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return every.join(histogram(df, by), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def bins(value: Column, edges: list[float]) -> Column:
    """The lower edge of the bin of ``value``; the last bin has no end."""
    out = F.lit(None).cast("double")
    for e in edges:
        out = F.when(value >= e, F.lit(e)).otherwise(out)
    return out


def cumulative_buckets(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """One row per edge: values up to it."""
    one = df.agg(*(F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)))
    stacked = ", ".join(f"{e}D, b{i}" for i, e in enumerate(edges))
    return one.select(F.expr(f"stack({len(edges)}, {stacked}) AS (le, n)"))


def as_map(df: DataFrame, keys: list[str], name: str, n: str = "n") -> DataFrame:
    """Counts of each key's values gathered into one sorted array of (name, n)."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(name, n))).alias("counts"))
