"""Order statistics over whole tables against sorting, and plans without a task that holds all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import order, stats, xsec


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_quantiles_equal_sorted_values(spark, monkeypatch, bins):
    monkeypatch.setattr(order, "BINS", bins)
    random = np.random.default_rng(1)
    tables = [random.normal(size=500), np.repeat([1.0, 2.0, 5.0], [300, 1, 40]), np.array([7.0]), np.array([-1e308, 1e308, 0.0, 1e-300, 5e-324]), np.concatenate([random.normal(size=200), np.full(300, 0.25), [1e12]])]
    for x in tables:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
        qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
        with np.errstate(over="ignore"):
            assert order.nth_values(df, "x", list(range(0, len(x), max(1, len(x) // 6)))) == sorted(x)[:: max(1, len(x) // 6)]
            if abs(x).max() < 1e300:
                assert np.allclose(order.quantiles(df, "x", qs), np.quantile(x, qs), rtol=1e-12)
    assert order.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_positions_and_leasts_equal_one_sorted_list(spark):
    random = np.random.default_rng(2)
    rows = [(k, None if k % 7 == 0 else float(random.integers(0, 20)), float(random.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(5)
    by = [F.col("a").desc_nulls_last(), F.col("k")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r.k: r.place for r in order.positions(df, by, "place", 6).collect()}
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    least = {r.k: r.least for r in order.least_from_here(df, by, F.col("b"), "least", 6).collect()}
    assert least == {r[0]: min(x[2] for x in want[i:]) for i, r in enumerate(want)}
    assert order.positions(df.limit(0), by, "place").count() == 0


def test_no_window_or_percentile_over_all_rows(spark):
    df = spark.range(1000).selectExpr("id AS k", "cast(id % 97 AS double) AS x", "'w' AS week")
    plans = [xsec.clip_above(df, "x", "y"), order.positions(df, [F.col("x"), F.col("k")], "place"), stats.corrections(df.withColumn("t", F.col("x") / 30), "t", ["k"])]
    for plan in plans:
        lines = str(plan._jdf.queryExecution().sparkPlan()).split("\n")
        assert not any("percentile" in x for x in lines)
        assert not any("Window" in x and "_part" not in x for x in lines), lines
    got = {r.k: r.y for r in plans[0].collect()}
    top = np.quantile(np.arange(1000) % 97, 0.99)
    assert all(abs(y - min(k % 97, top)) < 1e-12 for k, y in got.items())


def test_bins_of_few_groups_equal_bins_by_group(spark):
    random = np.random.default_rng(3)
    df = spark.createDataFrame([(int(k % 2), float(random.integers(0, 30))) for k in range(300)] + [(1, None)], "g int, x double")
    cuts = [0.0, 0.3, 0.7, 1.0]
    rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    assert rows(xsec.quantile_bins_of_few(df, "x", "bin", cuts, "g")) == rows(xsec.quantile_bins(df, "x", "bin", cuts, ("g",)))


def test_bins_of_few_groups_leave_rows_where_they_are(spark):
    df = spark.range(0, 4000, 1, 8).select((F.col("id") % 2).alias("g"), F.rand(3).alias("x"))
    binned = xsec.quantile_bins_of_few(df, "x", "bin", [0.0, 0.5, 1.0], "g")
    held = [r["count"] for r in binned.groupBy(F.spark_partition_id()).count().collect()]
    assert held == [500] * 8  # dealt by group, one task would hold 2,000 at least
    assert sorted(map(tuple, binned.groupBy("g", "bin").count().collect())) == [(0, 0, 1000), (0, 1, 1000), (1, 0, 1000), (1, 1, 1000)]
