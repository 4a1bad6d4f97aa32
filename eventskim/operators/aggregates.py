"""Whole-table aggregates: counts, sums, ranges and histograms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_rows(df: DataFrame, out: str = "n") -> DataFrame:
    """Row count as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias(out))


def sum_weights(gen: DataFrame, weight: str = "weight") -> DataFrame:
    """Sum of generator weights, and the number of events it runs over."""
    return gen.agg(F.sum(weight).alias("sum_weight"), F.count(F.lit(1)).alias("n_events"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def column_sums(df: DataFrame, group: str, decimals: int | None = None) -> DataFrame:
    """Sum of every numeric column, one row each: (group, dataset, total).

    All sums come from one pass. Integers are added exactly. With ``decimals`` so are
    the other columns, as fixed-point numbers, and a value that has more digits is an
    error; without, their last digits depend on the order the tasks finish in.
    """
    fields = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]

    def term(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            return value.cast("decimal(20, 0)")
        if decimals is None:
            return value.cast("double")
        fixed = value.cast(f"decimal(28, {decimals})")
        more = F.raise_error(F.lit(f"{f.name} has more than {decimals} decimals")).cast(fixed_type)
        # Beyond the last bits in which a quotient and its decimal differ.
        same = F.abs(fixed.cast("double") - value) <= F.abs(value) * 1e-12
        return F.when(value.isNull() | same, fixed).otherwise(more)

    fixed_type = f"decimal(28, {decimals or 0})"
    sums = df.agg(*[F.sum(term(f)).cast("double").alias(f.name) for f in fields])
    long = sums.unpivot([], [F.col(f"`{f.name}`") for f in fields], "dataset", "total")
    return long.select(F.lit(group).alias("group"), "dataset", "total")


def _with_ends(rows: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``_ends`` to ``rows``: for each column of ``df``, its ``lo`` and ``hi``.

    The values come from a scalar subquery, whose one row becomes a constant.
    """
    ends = [
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
        for c in columns
    ]
    return rows.withColumn("_ends", df.agg(F.struct(*ends)).scalar())


def _bucket(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    unbounded = reduce(or_, [F.isnan(e) | (F.abs(e) == F.lit(float("inf"))) for e in (lo, hi)])
    place = F.floor((x - lo) / (hi - lo) * n).cast("int")
    return (
        F.when(unbounded, F.raise_error(F.lit("histogram of NaN or infinite values")).cast("int"))
        .when(hi > lo, F.least(place, n - 1))
        .otherwise(F.lit(0))
    )


def _edges(bucket: Column, lo: Column, hi: Column, n: Column) -> list[Column]:
    last = (bucket == n - 1) | (lo == hi)
    upper = F.when(last, hi).otherwise(lo + (bucket + 1) * (hi - lo) / n)
    return [(lo + bucket * (hi - lo) / n).alias("bucket_lo"), upper.alias("bucket_hi")]


def histograms(df: DataFrame, buckets: Mapping[str, int]) -> DataFrame:
    """Equal-width histograms of several columns in one pass over ``df``.

    Each runs from its column's minimum to its maximum with the last bucket
    closed. NULL is left out, NaN and infinity raise an error, and a constant
    column has the one bucket. Output: (column, bucket, bucket_lo, bucket_hi, n),
    without empty buckets.
    """
    if any(n < 1 for n in buckets.values()):
        raise ValueError("a histogram needs at least one bucket")
    cols = list(buckets)
    df = df.select(*cols)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).cast("double").alias("x"),
            F.col(f"_ends.{c}.lo").alias("lo"),
            F.col(f"_ends.{c}.hi").alias("hi"),
            F.lit(buckets[c]).alias("buckets"),
        )
        for c in cols
    ]
    long = _with_ends(df, df, cols).select(F.inline(F.array(*entries))).filter("x IS NOT NULL")
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("buckets")
    counted = (
        long.withColumn("bucket", _bucket(F.col("x"), lo, hi, n))
        .groupBy("column", "bucket", "lo", "hi", "buckets")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select("column", "bucket", *_edges(F.col("bucket"), lo, hi, n), "n")


def histogram(df: DataFrame, column: str, buckets: int, dense: bool = False) -> DataFrame:
    """:func:`histograms` of one column, without the name; ``dense`` adds empty buckets."""
    if buckets < 1:
        raise ValueError("a histogram needs at least one bucket")
    df = df.select(F.col(column).cast("double").alias("x"))
    lo, hi, n = F.col("_ends.x.lo"), F.col("_ends.x.hi"), F.lit(buckets)
    counted = (
        _with_ends(df.filter("x IS NOT NULL"), df, ["x"])
        .select(_bucket(F.col("x"), lo, hi, n).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if dense:
        every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        exists = lo.isNotNull() & ((hi > lo) | (F.col("bucket") == 0))
        every = _with_ends(every, df, ["x"]).filter(exists).drop("_ends")
        counted = every.join(counted, "bucket", "left").fillna(0, ["n"])
    out = _with_ends(counted, df, ["x"])
    return out.select("bucket", *_edges(F.col("bucket"), lo, hi, n), "n")
