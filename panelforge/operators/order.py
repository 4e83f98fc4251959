"""Order statistics and positions over all rows of a table, by counting passes and ranges, so that no task holds or sorts all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.session import materialize

BINS = 4096


def nth_values(rows: DataFrame, x: str, ranks: list[int]) -> list[float]:
    """The values of these ranks (from 0) among the known values of x.

    A pass counts values in bins between the bounds of each rank and takes the bin that holds the rank, with its own least and
    greatest value as the next bounds, until they are equal. Bounds part at every pass and a pass divides what is between them
    by ``BINS``, so a few passes do; each sends a row a bin from a task."""
    known = rows.select(F.col(x).cast("double").alias("x")).filter("x is not null")
    lo, hi = known.agg(F.min("x"), F.max("x")).first()
    bounds = {r: (lo, hi, 0) for r in ranks}  # least, greatest, values below the least
    while open_ := sorted({(a, b) for a, b, _ in bounds.values() if a != b}):
        at = (F.col("x") * F.col("f") - F.col("lo") * F.col("f")) / (F.col("hi") * F.col("f") - F.col("lo") * F.col("f")) * BINS
        # Half of very large bounds, as their difference is no double.
        spans = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(0.5 if max(-a, b) > 1e300 else 1.0).alias("f")) for k, (a, b) in enumerate(open_)))
        inside = known.select("x", F.explode(F.filter(spans, lambda s: F.col("x").between(s["lo"], s["hi"]))).alias("s")).select("x", "s.*")
        bins = inside.groupBy("k", F.least(F.floor(at), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found = {k: [] for k in range(len(open_))}
        for r in bins.collect():  # at most BINS for each span
            found[r["k"]].append((r["bin"], r["n"], r["lo"], r["hi"]))
        for rank, (a, b, below) in bounds.items():
            if a != b:
                for _, n, a, b in sorted(found[open_.index((a, b))]):  # noqa: B007
                    if below + n > rank:
                        break
                    below += n
                bounds[rank] = (a, b, below)
    return [bounds[r][0] for r in ranks]


def quantiles(rows: DataFrame, x: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of the known values of x, linear between two; None where no value is known."""
    n = rows.filter(F.col(x).isNotNull()).count()
    if not n:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    value = dict(zip(ranks, nth_values(rows, x, ranks)))
    return [value[int(p)] + (value[min(int(p) + 1, n - 1)] - value[int(p)]) * (p - int(p)) for p in places]


def ranges(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with ``_part``, written: every row of a part stands before all rows of later ones. Rows equal in ``order`` share a part."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def positions(rows: DataFrame, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order: its place within its range, after all rows of the ranges before."""
    dealt = ranges(rows, order, parts)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(sizes, "_part").withColumn(out, F.col("_before") + own).drop("_part", "_before")


def least_from_here(rows: DataFrame, order: list[Column], x: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds the least x of a row and all rows behind it."""
    dealt = ranges(rows.withColumn("_x", x), order, parts)
    later = F.min("_m").over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing))  # a row a range
    leasts = dealt.groupBy("_part").agg(F.min("_x").alias("_m")).select("_part", later.alias("_later"))
    own = F.min("_x").over(W.partitionBy("_part").orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    return dealt.join(leasts, "_part").withColumn(out, reduce(F.least, (own, F.col("_later")))).drop("_part", "_x", "_later")
