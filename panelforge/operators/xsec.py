"""Cross-sections: transforms of a measure among the symbols of a week.

Means, deviations and quantiles are aggregates by week joined back (a row a week), so a week's rows need not meet in one
task; ranks order a week's rows, by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelforge.functions import ratio

from . import order


def zscore(rows: DataFrame, x: str, out: str, flat_to_zero: bool = True, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Adds (x - mean) / sd. Where sd is null or zero: zero ("flat_to_zero") or null."""
    stats = rows.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = ratio(F.col(x) - F.col("_m"), F.col("_s"))
    if flat_to_zero:
        z = F.when(F.col("_s").isNull() | (F.col("_s") <= 0), F.col(x) * 0.0).otherwise(z)
    return rows.join(stats, list(by), "left").withColumn(out, z).drop("_m", "_s")


def zscores(rows: DataFrame, scores: dict[str, tuple[str, bool]], by: tuple[str, ...] = ("week",)) -> DataFrame:
    """As ``zscore`` for several scores, name to (column, flat_to_zero): one aggregate and one join, however many they are."""
    measures = dict.fromkeys(x for x, _ in scores.values())
    stats = rows.groupBy(*by).agg(*(f(x).alias(f"_{k}_{x}") for x in measures for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = rows.join(stats, list(by), "left")
    made = {}
    for out, (x, flat_to_zero) in scores.items():
        m, s = F.col(f"_m_{x}"), F.col(f"_s_{x}")
        z = ratio(F.col(x) - m, s)
        made[out] = F.when(s.isNull() | (s <= 0), F.col(x) * 0.0).otherwise(z) if flat_to_zero else z
    return joined.withColumns(made).drop(*(f"_{k}_{x}" for x in measures for k in "ms"))


def zscore_over(x: str, by: tuple[str, ...] = ("week",)) -> Column:
    """As ``zscore`` with flat groups as zero, in a window over the group."""
    sd = F.stddev_samp(x).over(W.partitionBy(*by))
    return F.when(sd.isNull() | (sd <= 0), F.col(x) * 0.0).otherwise(ratio(F.col(x) - F.avg(x).over(W.partitionBy(*by)), sd))


def winsorize(rows: DataFrame, x: str, out: str, p: float = 0.01, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Adds x clipped to its quantiles p and 1 - p."""
    edges = rows.groupBy(*by).agg(F.percentile(x, [p, 1 - p]).alias("_q"))
    clipped = F.greatest(F.least(F.col(x), F.col("_q")[1]), F.col("_q")[0])
    return rows.join(edges, list(by), "left").withColumn(out, F.when(F.col(x).isNotNull(), clipped)).drop("_q")


def average_rank(x: Column, by: tuple[str, ...] = ("week",)) -> Column:
    """Rank among the known values, ties averaged."""
    over = W.partitionBy(*by, x.isNotNull()).orderBy(x)
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(over) + (ties - 1) / 2)


def percent_rank(x: Column, by: tuple[str, ...] = ("week",)) -> Column:
    return average_rank(x, by) / F.count(x).over(W.partitionBy(*by))


def median_scaled(rows: DataFrame, x: str, out: str, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Adds x over its median."""
    mid = rows.groupBy(*by).agg(F.percentile(x, 0.5).alias("_m"))
    return rows.join(mid, list(by), "left").withColumn(out, ratio(F.col(x), F.col("_m"))).drop("_m")


def medians_scaled(rows: DataFrame, measures: dict[str, str], by: tuple[str, ...] = ("week",)) -> DataFrame:
    """As ``median_scaled`` for several measures (column to its name): one aggregate and one join."""
    mid = rows.groupBy(*by).agg(*(F.percentile(x, 0.5).alias(f"_m_{x}") for x in measures))
    return rows.join(mid, list(by), "left").withColumns({out: ratio(F.col(x), F.col(f"_m_{x}")) for x, out in measures.items()}).drop(*(f"_m_{x}" for x in measures))


def clip_above(rows: DataFrame, x: str, out: str, q: float = 0.99) -> DataFrame:
    """Adds x clipped to its quantile over all rows."""
    (top,) = order.quantiles(rows, x, [q])
    return rows.withColumn(out, F.when(F.col(x).isNotNull(), F.least(x, F.lit(top).cast("double"))))


def quantile_bins(rows: DataFrame, x: str, out: str, cuts: list[float], by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Adds the bin (from 0) of x between its quantiles at ``cuts``; bins are closed on the right and equal edges merge. Edges are
    those of the very rows they part: where an edge is a row's value, one that is added up anew in another order may miss it."""
    return _between(rows.withColumn("_e", F.array_distinct(F.percentile(x, cuts).over(W.partitionBy(*by)))), x, out)


def quantile_bins_of_few(rows: DataFrame, x: str, out: str, cuts: list[float], by: str) -> DataFrame:
    """As ``quantile_bins`` for few large groups (windows, halves): each one's quantiles are counted, not gathered, and go to the
    rows, which stay where they are: dealt by group, a task would hold most of them."""
    groups = [r[0] for r in rows.select(by).distinct().collect()]
    found = [(g, sorted(set(order.quantiles(rows.filter(F.col(by).eqNullSafe(F.lit(g))), x, cuts)))) for g in groups]
    edges = rows.sparkSession.createDataFrame(found, f"{by} {dict(rows.dtypes)[by]}, _e array<double>")
    return _between(rows.join(F.broadcast(edges), by, "left"), x, out)


def _between(rows: DataFrame, x: str, out: str) -> DataFrame:
    below = F.size(F.filter(F.slice(F.col("_e"), 1, F.size("_e")), lambda e: e < F.col(x)))
    label = F.when(F.col(x).isNotNull() & (F.size("_e") > 1), F.greatest(below - 1, F.lit(0)))
    return rows.withColumn(out, label.cast("int")).drop("_e")


def legs(rows: DataFrame, x: str, frac: float = 0.3, floor: int = 3, min_names: int = 10, by: tuple[str, ...] = ("week",), tie: str = "symbol") -> DataFrame:
    """Adds n, k and the position r by x of the rows with a known x, in weeks with enough names.

    k is the half-even rounded fraction of n, at least ``floor``; the low leg is r <= k, the high leg r > n - k."""
    known = rows.filter(F.col(x).isNotNull())
    known = known.withColumn("n", F.count("*").over(W.partitionBy(*by))).filter(F.col("n") >= min_names)
    known = known.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(x, tie)))
    return known.withColumn("k", F.greatest(F.bround(F.col("n") * frac), F.lit(floor)))


def information_coefficient(rows: DataFrame, x: str, y: str, least: int = 10, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Spearman correlation of x and y by week, over rows with both, in weeks with at least so many."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_a", average_rank(F.col(x), by)).withColumn("_b", average_rank(F.col(y), by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic")).filter(F.col("n") >= least)


#: Measures of a row of ``by_week``.
SIDE_BY_SIDE = 32


def by_week(rows: DataFrame, measures: dict[str, str], y: str, run: Callable, schema: str) -> DataFrame:
    """(week, *schema): what ``run`` gives for each week's measures (name to column): it takes some of the names, their values
    (rows by names, in order of symbols), which of these are known, and the rows' y, and yields rows of the schema. A row of the
    table goes to its week once for each ``SIDE_BY_SIDE`` measures."""
    names = list(measures)
    chunks = [names[k : k + SIDE_BY_SIDE] for k in range(0, len(names), SIDE_BY_SIDE)]
    arrays = [F.struct(F.lit(k).alias("chunk"), F.array(*(F.col(measures[f]).cast("double") for f in part)).alias("x")) for k, part in enumerate(chunks)]
    long = rows.select("week", "symbol", F.col(y).cast("double").alias("y"), F.explode(F.array(*arrays)).alias("s")).select("week", "symbol", "y", "s.*")
    out = to_arrow_schema(StructType.fromDDL("week date, " + schema))

    def of_week(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = chunks[key[1].as_py()]
        order = np.argsort(table["symbol"].to_pandas().to_numpy(), kind="stable")
        x = pa.concat_arrays([c.flatten() for c in table["x"].chunks])
        known = x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(part))[order]
        values = x.to_numpy(zero_copy_only=False).reshape(-1, len(part))[order]
        found = [(key[0].as_py(), *r) for r in run(part, values, known, table["y"].to_numpy()[order])]
        return pa.Table.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

    return long.groupBy("week", "chunk").applyInArrow(of_week, "week date, " + schema)


def ranks_of(x: np.ndarray) -> np.ndarray:
    """Ranks, ties averaged."""
    _, which, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[which]


def correlations_of(names: list[str], x: np.ndarray, known: np.ndarray, held: np.ndarray, least: int = 10) -> Iterator[tuple]:
    """(factor, n, ic) of a week's rows."""
    for j, f in enumerate(names):
        use = known[:, j]
        n = int(use.sum())
        if n >= least:
            a, b = ranks_of(x[use, j]) - (n + 1) / 2, ranks_of(held[use]) - (n + 1) / 2
            scale = np.sqrt((a @ a) * (b @ b))
            yield f, n, float(a @ b / scale) if scale else None


def information_coefficients(rows: DataFrame, measures: dict[str, str], y: str, least: int = 10) -> DataFrame:
    """(week, factor, n, ic): as ``information_coefficient`` of many measures (name to column)."""

    def correlate(names: list[str], x: np.ndarray, known: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        return correlations_of(names, x, known, held, least)

    return by_week(rows.filter(F.col(y).isNotNull()), measures, y, correlate, "factor string, n long, ic double")


def group_rank_z(rows: DataFrame, x: str, out: str, group: str) -> DataFrame:
    """Adds the z-score of x's rank within its week and group; a group of one gets zero."""
    ranked = rows.withColumn("_r", average_rank(F.col(x), ("week", group)))
    return zscore(ranked, "_r", out, by=("week", group)).drop("_r")


def leave_one_out(rows: DataFrame, x: str, group: str) -> DataFrame:
    """Adds own (mean of the others of the group), other (mean of the other groups' rows) and relative (x less other)."""
    inner = rows.groupBy("week", group).agg(F.sum(x).alias("_cs"), F.count(x).alias("_cn"))
    week = rows.groupBy("week").agg(F.sum(x).alias("_ws"), F.count(x).alias("_wn"))
    a = rows.join(inner, ["week", group], "left").join(week, "week", "left")
    own = ratio(F.col("_cs") - F.coalesce(x, F.lit(0.0)), F.col("_cn") - F.col(x).isNotNull().cast("int"))
    other = ratio(F.col("_ws") - F.coalesce("_cs", F.lit(0.0)), F.col("_wn") - F.col("_cn"))
    return a.withColumns({"own": own, "other": other, "relative": F.col(x) - other}).drop("_cs", "_cn", "_ws", "_wn")


def network_signals(rows: DataFrame, x: str, group: str) -> DataFrame:
    """Adds within (the z-score of x's rank among its group, zero in a group of one) and relative (x less the mean over the
    other groups), in windows over a week and a group; rows without a group are one."""
    inner, week = W.partitionBy("week", group), W.partitionBy("week")
    a = rows.withColumn("_r", average_rank(F.col(x), ("week", group)))
    sd = F.stddev_samp("_r").over(inner)
    z = F.when(F.coalesce(sd, F.lit(0.0)) <= 0, F.col("_r") * 0.0).otherwise(ratio(F.col("_r") - F.avg("_r").over(inner), sd))
    total, own = F.sum(x).over(week), F.coalesce(F.sum(x).over(inner), F.lit(0.0))
    other = ratio(total - own, F.count(x).over(week) - F.count(x).over(inner))
    return a.withColumns({"within": z, "relative": F.col(x) - other}).drop("_r")


def entropy(labels: DataFrame, group: str) -> DataFrame:
    """Shannon entropy of the group sizes of each week, and the number of groups."""
    sizes = labels.filter(F.col(group).isNotNull()).groupBy("week", group).agg(F.count("*").alias("_n"))
    p = sizes.withColumn("_p", F.col("_n") / F.sum("_n").over(W.partitionBy("week")))
    return p.groupBy("week").agg((-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-12))).alias("entropy"), F.count("*").alias("n_groups"))


def score(rows: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted sum of columns, a null as zero."""
    first, *rest = (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items())
    return sum(rest, first)
