"""Rolling measures of a symbol's weeks: an aggregate over the last n rows, null unless enough of them are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import ratio


def frame(n: int, skip: int = 0, by: tuple[str, ...] = ("symbol",), order: str = "week") -> W:
    """The n rows that end ``skip`` rows before the current one."""
    return W.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1 + skip), -skip)


def gated(value: Column, known: Column, least: int, over: W) -> Column:
    """value over the frame where at least so many rows of it have ``known``."""
    return F.when(F.count(known).over(over) >= least, value.over(over))


def mean(x: Column, n: int, least: int | None = None, **at) -> Column:
    return gated(F.avg(x), x, least or n, frame(n, **at))


def total(x: Column, n: int, least: int | None = None, **at) -> Column:
    return gated(F.sum(x), x, least or n, frame(n, **at))


def sd(x: Column, n: int, least: int | None = None, **at) -> Column:
    return gated(F.stddev_samp(x), x, least or n, frame(n, **at))


def highest(x: Column, n: int, least: int | None = None, **at) -> Column:
    return gated(F.max(x), x, least or n, frame(n, **at))


def lowest(x: Column, n: int, least: int | None = None, **at) -> Column:
    return gated(F.min(x), x, least or n, frame(n, **at))


def compounded(r: Column, n: int, least: int | None = None, **at) -> Column:
    """Product of 1 + r, less 1; null if a row of the frame is null."""
    over = frame(n, **at)
    value = F.exp(F.sum(F.log1p(r)).over(over)) - 1
    return F.when((F.count(r).over(over) >= (least or n)) & (F.count(F.lit(1)).over(over) == F.count(r).over(over)), value)


def up_frequency(r: Column, n: int, **at) -> Column:
    """Share of rows with r above zero; a null counts as not above."""
    over = frame(n, **at)
    return F.when(F.count(F.lit(1)).over(over) >= n, F.avg(F.when(r > 0, 1.0).otherwise(0.0)).over(over))


def skew_adjusted(x: Column, n: int, least: int, **at) -> Column:
    """Bias-corrected skewness; zero where all values are equal."""
    over = frame(n, **at)
    k, g = F.count(x).over(over), F.skewness(x).over(over)
    flat = F.max(x).over(over) == F.min(x).over(over)
    return F.when((k >= least) & (k > 2), F.when(flat, 0.0).otherwise(F.sqrt(k * (k - 1)) / (k - 2) * g))


def beta(y: Column, x: Column, n: int, least: int, **at) -> Column:
    """Sample covariance over sample variance of the rows where both are known."""
    over = frame(n, **at)
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, y), F.when(both, x)
    return F.when(F.count(a).over(over) >= least, ratio(F.covar_samp(a, b).over(over), F.var_samp(b).over(over)))


def beta_mixed(y: Column, x: Column, n: int, **at) -> Column:
    """Population covariance over sample variance, for full frames."""
    over = frame(n, **at)
    cov = F.avg(y * x).over(over) - F.avg(y).over(over) * F.avg(x).over(over)
    return F.when(F.count(y * x).over(over) >= n, ratio(cov, F.var_samp(x).over(over)))


def correlation(y: Column, x: Column, n: int, **at) -> Column:
    over = frame(n, **at)
    return F.when(F.count(y * x).over(over) >= n, F.corr(y, x).over(over))


def zscore_lagged(x: Column, n: int, least: int, by: tuple[str, ...] = (), order: str = "week", lag: int = 1) -> Column:
    """Rolling z-score of a series, as known ``lag`` rows before."""
    over = frame(n, by=by, order=order)
    z = F.when(F.count(x).over(over) >= least, ratio(x - F.avg(x).over(over), F.stddev_samp(x).over(over)))
    return z if not lag else F.lag(z, lag).over(W.partitionBy(*by).orderBy(order))
