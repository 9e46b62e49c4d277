"""Exact quantiles and average ranks without a task that sees all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def value_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))


#: Ranges of values that prefix sums are dealt over.
RANGES = 64


def running(df: DataFrame, keys: list[str], column: str, ranges: int = RANGES) -> DataFrame:
    """(keys, v, n, before, total): how many values lie before v, by two levels of prefix sums.

    The counted values are stored: bounds, sums and rows read them, and ``df`` is computed once."""
    return running_counts(stored(value_counts(df, keys, column), "counts"), keys, ranges)


def in_ranges(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Adds ``b``, the range of each v, by bounds from a mergeable sketch of the distinct values.

    The sketch's places are off by 1 / 10,000 of the rows at most, so whatever the values look like no range holds more
    than 2 / ``ranges`` of them (up to 1,000 ranges)."""
    bounds = counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("bounds"))
    return counts.withColumn("__bounds", bounds.scalar()).withColumn("b", F.size(F.filter("__bounds", lambda x: x <= F.col("v")))).drop("__bounds")


def running_counts(counts: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """The same for values that are counted already: (keys, v, n) with one row a value.

    A window runs over the sums of the ranges, another one over the values within each."""
    counts = in_ranges(counts.select(*keys, "v", "n"), ranges)
    buckets = counts.groupBy(*keys, "b").agg(F.sum("n").alias("in_bucket"))
    group = Window.partitionBy(*keys)
    up = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*keys, "b", F.coalesce(F.sum("in_bucket").over(up), F.lit(0)).alias("base"), F.sum("in_bucket").over(group).alias("total"))
    inner = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(buckets, [*keys, "b"])
    return rows.select(*keys, "v", "n", (F.col("base") + F.col("inside")).alias("before"), "total")


def quantiles(df: DataFrame, keys: list[str], column: str, parts: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """(keys, one column for each part): exact quantiles with linear interpolation."""
    return quantiles_of(running(df, keys, column, ranges), keys, parts)


def quantiles_of(rows: DataFrame, keys: list[str], parts: dict[str, float]) -> DataFrame:
    """The same from running counts."""
    out = []
    for name, part in parts.items():
        at = (F.col("total") - 1) * part
        low, high = F.floor(at), F.ceil(at)
        has = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
        a, b = F.max(F.when(has(low), F.col("v"))), F.max(F.when(has(high), F.col("v")))
        share = F.max(at - low)
        out.append((a + (b - a) * share).alias(name))
    return rows.groupBy(*keys).agg(*out)


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the average rank (from 1) of each non-null value."""
    r = running(df, [], column).select(F.col("v").alias("__v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(r, F.col(column).cast("double") == F.col("__v")).drop("__v")
