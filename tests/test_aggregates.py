import math

import pytest
from pyspark.sql import functions as F

from eventskim.operators import (
    column_sums,
    count_rows,
    histogram,
    histograms,
    sum_weights,
    value_range,
)


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


def rows(df):
    return [tuple(r) for r in df.orderBy("bucket").collect()]


def test_histogram_edges(spark):
    got = rows(histogram(values(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "x", 2))
    assert got == [(0, 1.0, 3.0, 2), (1, 3.0, 5.0, 3)]


def test_histogram_constant_and_empty(spark):
    for dense in (False, True):
        assert rows(histogram(values(spark, [2.0, 2.0]), "x", 4, dense)) == [(0, 2.0, 2.0, 2)]
        assert rows(histogram(values(spark, []), "x", 4, dense)) == []
    assert histograms(values(spark, []), {"x": 3}).count() == 0


def test_histogram_dense_and_null(spark):
    got = rows(histogram(values(spark, [0.0, None, 4.0]), "x", 4, dense=True))
    assert got == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 0), (2, 2.0, 3.0, 0), (3, 3.0, 4.0, 1)]


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_histogram_refuses_unbounded_values(spark, bad):
    with pytest.raises(Exception, match="NaN or infinite"):
        histogram(values(spark, [1.0, 2.0, bad]), "x", 2).collect()


def test_histogram_agrees_with_sequential_binning(spark):
    df = spark.range(5000).select((F.abs(F.hash("id")) % 9973 / 7).alias("x"))
    xs = [r["x"] for r in df.collect()]
    lo, hi, n = min(xs), max(xs), 100
    want = [0] * n
    for x in xs:
        want[min(int((x - lo) / (hi - lo) * n), n - 1)] += 1
    assert [r[3] for r in rows(histogram(df, "x", n, dense=True))] == want
    both = histograms(df.withColumn("y", -F.col("x")), {"x": n, "y": 3})
    single = {tuple(r) for r in histogram(df, "x", n).collect()}
    assert {tuple(r)[1:] for r in both.filter("column = 'x'").collect()} == single
    assert both.filter("column = 'y'").agg(F.sum("n")).first()[0] == 5000


def test_histogram_needs_buckets(spark):
    with pytest.raises(ValueError):
        histogram(values(spark, [1.0]), "x", 0)
    with pytest.raises(ValueError):
        histograms(values(spark, [1.0]), {"x": 0})


def test_sums_and_counts(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, -1.5, "b")], "i int, weight double, s string")
    assert sum_weights(df).first().asDict() == {"sum_weight": -1.0, "n_events": 2}
    assert count_rows(df).first()["n"] == 2
    assert tuple(value_range(df, "weight").first()) == (-1.5, 0.5)
    want = {("G", "i", 3.0), ("G", "weight", -1.0)}
    assert {tuple(r) for r in column_sums(df, "G").collect()} == want
    assert {tuple(r) for r in column_sums(df, "G", decimals=2).collect()} == want


def test_exact_sums_refuse_more_decimals(spark):
    df = spark.createDataFrame([(0.25, 2**60), (None, 1), (1234.5678, -1)], "x double, n long")
    sums = {r.dataset: r.total for r in column_sums(df, "G", decimals=4).collect()}
    assert sums == {"x": 1234.8178, "n": float(2**60)}
    with pytest.raises(Exception, match="x has more than 2 decimals"):
        column_sums(df, "G", decimals=2).collect()
