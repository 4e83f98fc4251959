"""Statistics of weekly series in long form (name, week, value): errors, moments, dominance, performance, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import normal_cdf, normal_quantile, ratio
from panelforge.session import materialize

from . import order


def newey_west(series: DataFrame, keys: list[str], value: str, lags: int = 4, order: str = "week", least: int = 5) -> DataFrame:
    """n, mean, Newey-West standard error and t of each series; the autocovariance at lag l is the mean of its n - l products.
    A series of fewer than ``least`` values has no t."""
    known = series.filter(F.col(value).isNotNull())
    over = W.partitionBy(*keys)
    e = known.withColumn("_e", F.col(value) - F.avg(value).over(over))
    e = e.withColumns({f"_e{k}": F.col("_e") * F.lag("_e", k).over(over.orderBy(order)) for k in range(1, lags + 1)})
    gammas = [F.avg(F.col("_e") ** 2).alias("_g0"), *(F.avg(f"_e{k}").alias(f"_g{k}") for k in range(1, lags + 1))]
    a = e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *gammas)
    long_run = sum((2 * (1 - k / (lags + 1)) * F.coalesce(f"_g{k}", F.lit(0.0)) for k in range(1, lags + 1)), F.col("_g0"))
    a = a.withColumn("se", F.sqrt(F.when(long_run > 0, long_run) / F.col("n")))
    return a.select(*keys, "n", "mean", "se", F.when(F.col("n") >= least, ratio(F.col("mean"), F.col("se"))).alias("t"))


def plain_t(x: str) -> Column:
    """The mean over its error, of values taken as independent."""
    return ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def adjusted_skew(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def window_stats(series: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """n, annual mean, Sharpe, Newey-West t, population skew and excess kurtosis, and the Jarque-Bera p-value."""
    known = series.filter(F.col(value).isNotNull())
    a = known.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("exkurt"))
    t = newey_west(known, keys, value).filter(F.col("n") >= least)
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("exkurt") ** 2 / 4)
    return t.join(a, keys).select(*keys, "n", (F.col("_m") * 52).alias("ann_mean"), (ratio(F.col("_m"), F.col("_s")) * F.sqrt(F.lit(52.0))).alias("sharpe"), "t", "skew", "exkurt", F.exp(-jb / 2).alias("jb_p"))


def verdict(t_in: Column, t_out: Column, value_in: Column, value_out: Column) -> Column:
    """Weak: |t| under 2 in sample. Robust: out of sample the same sign with |t| of 1. Else in sample only."""
    holds = (F.signum(value_in) == F.signum(value_out)) & (F.abs(t_out) >= 1)
    return F.when(t_in.isNull() | (F.abs(t_in) < 2), "weak").when(holds, "robust").otherwise("in_sample_only")


def drawdown(series: DataFrame, keys: list[str], value: str, order: str = "week") -> DataFrame:
    """Adds wealth (compounded, a null as no return), cumulative sum and drawdown from the highest wealth so far."""
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    a = series.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce(value, F.lit(0.0)))).over(over)))
    return a.withColumns({"cumulative": F.sum(value).over(over), "drawdown": F.col("wealth") / F.max("wealth").over(over) - 1})


def performance(series: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """n, annual return (compounded) and volatility, Sharpe, largest drawdown, Calmar ratio and hit rate."""
    known = drawdown(series.filter(F.col(value).isNotNull()), keys, value)
    a = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.exp(F.sum(F.log1p(value))).alias("_w"), F.stddev_samp(value).alias("_s"), F.avg(value).alias("_m"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    ).filter(F.col("n") >= least)
    a = a.withColumn("ann_return", F.pow("_w", 52 / F.col("n")) - 1).withColumn("ann_vol", F.col("_s") * F.sqrt(F.lit(52.0)))
    sharpe = ratio(F.col("_m"), F.col("_s")) * F.sqrt(F.lit(52.0))
    return a.select(*keys, "n", "ann_return", "ann_vol", sharpe.alias("sharpe"), "max_drawdown", ratio(F.col("ann_return"), -F.col("max_drawdown")).alias("calmar"), "hit_rate")


def univariate_ols(rows: DataFrame, keys: list[str], y: str, x: str, least: int = 10) -> DataFrame:
    """alpha, beta and their t of y on x, by closed forms."""
    both = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    a = both.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.avg(x).alias("_mx"))
    a = a.filter(F.col("n") >= least).withColumn("_v", (F.col("_yy") - F.col("beta") ** 2 * F.col("_xx")) / (F.col("n") - 2))
    return a.select(*keys, "n", "alpha", "beta", ratio(F.col("alpha"), F.sqrt(F.col("_v") * (1 / F.col("n") + F.col("_mx") ** 2 / F.col("_xx")))).alias("t_alpha"), ratio(F.col("beta"), F.sqrt(F.col("_v") / F.col("_xx"))).alias("t_beta"))


def stochastic_dominance(pairs: DataFrame, keys: list[str], x: str, y: str, points: int = 1000, least: int = 10) -> DataFrame:
    """Almost stochastic dominance of x over y: shares eps1, eps2 of the area between distributions (and between their
    integrals) on an even grid that speaks against x. A series' values are counted per grid cell, then summed along it."""
    known = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = known.groupBy(*keys).agg(F.least(F.min(x), F.min(y)).alias("_lo"), F.greatest(F.max(x), F.max(y)).alias("_hi"), F.count("*").alias("n")).filter(F.col("n") >= least)
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    span = span.withColumn("_d", step).filter("_d > 0")
    long = known.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("a"), F.col(x).alias("v")), F.struct(F.lit(-1).alias("a"), F.col(y).alias("v")))).alias("s")).select(*keys, "s.*")
    cell = F.greatest(F.ceil(ratio(F.col("v") - F.col("_lo"), F.col("_d")) - 1e-9), F.lit(0)).cast("int")
    counts = long.join(span, keys).groupBy(*keys, "n", "_d", cell.alias("g")).agg(F.sum("a").alias("c"))
    grid = span.select(*keys, "n", "_d", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    along = W.partitionBy(*keys).orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    a = grid.join(counts, [*keys, "n", "_d", "g"], "left").withColumn("f", F.sum(F.coalesce("c", F.lit(0))).over(along) / F.col("n"))
    a = a.withColumn("s", F.sum(F.col("f") * F.col("_d")).over(along))
    against = lambda c: ratio(F.sum(F.greatest(F.col(c), F.lit(0.0))), F.sum(F.abs(c)))
    return a.groupBy(*keys).agg(F.max("n").alias("n"), against("f").alias("eps1"), against("s").alias("eps2"))


def corrections(tests: DataFrame, t: str, keys: list[str]) -> DataFrame:
    """Adds the two-sided normal p, whether it passes Bonferroni at 5 %, and the Benjamini-Hochberg q."""
    a = materialize(tests.withColumn("p", 2 * (1 - normal_cdf(F.abs(t)))), "tests")
    m, by_p = a.count(), [F.col("p"), *map(F.col, keys)]
    a = order.positions(a, by_p, "_r")
    a = order.least_from_here(a, by_p, F.col("p") * m / F.col("_r"), "_q")
    return a.withColumns({"bonferroni": F.col("p") * m <= 0.05, "q": F.least(F.lit(1.0), "_q")}).drop("_r", "_q")


#: Grades of evidence from strong to none, and the bars of t they are cut at. Fixed values.
GRADES = ("Confirmed", "Priced risk", "Tradable signal", "Suggestive", "Economic-only", "Structure", "Not supported")
PRICED, BORDER, HOLDS = 1.65, 1.3, 1.0


def grade(t_price: Column, ic_in: Column, ic_out: Column, assd: Column, dominated: Column, market: Column, structure: Column) -> Column:
    """The grade of a factor by the t of its premium, the t of its information coefficient in and out of sample, in the
    direction of its bet (null: it has none), second-order dominance over the market, and whether the market dominates it.
    The market's own premium is priced risk, factors that only describe structure are that."""
    at_least = lambda t, bar: F.coalesce(t >= bar, F.lit(False))
    priced = at_least(F.abs(t_price), PRICED)
    border = at_least(F.abs(t_price), BORDER) & ~priced
    strong = at_least(ic_in, PRICED) & at_least(ic_out, HOLDS)
    reverse = at_least(-ic_in, PRICED) & at_least(-ic_out, HOLDS)
    partly = at_least(ic_in, BORDER) | (at_least(ic_in, HOLDS) & at_least(ic_out, HOLDS))
    ranks = strong | reverse
    return (
        F.when(market, "Priced risk").when(structure, "Structure").when(ranks & priced, "Confirmed").when(priced, "Priced risk").when(ranks, "Tradable signal")
        .when(F.coalesce(assd, F.lit(False)) | partly | border, "Suggestive")
        .when(F.coalesce(dominated, F.lit(False)) | (at_least(-ic_in, PRICED) & ~reverse), "Not supported").when(ic_in.isNull(), "Economic-only").otherwise("Not supported")
    )


def dominance_flags(found: DataFrame) -> DataFrame:
    """Adds the shares in the other direction and whether x almost dominates y, or y x, at first and second order. The areas
    of both directions add up to the whole, so the reverse share is one less the share, or both are zero."""
    back = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(1 - F.col(c))
    a = found.withColumns({"rev1": back("eps1"), "rev2": back("eps2"), "eps1": F.coalesce("eps1", F.lit(0.0)), "eps2": F.coalesce("eps2", F.lit(0.0))})
    return a.withColumns({"afsd": F.col("eps1") <= 0.059, "assd": F.col("eps2") <= 0.032, "afsd_by": F.col("rev1") <= 0.059, "assd_by": F.col("rev2") <= 0.032})


def composite(series: DataFrame, names: DataFrame, name: str, value: str, order: str = "week") -> DataFrame:
    """(week, value): the mean over the named series, those unknown in a week left out."""
    return series.join(names.select(name), name, "left_semi").groupBy(order).agg(F.avg(value).alias(value))


def rolling_newey_west(series: DataFrame, keys: list[str], value: str, n: int = 26, lags: int = 4, order: str = "week") -> DataFrame:
    """(keys, week, mean, t) over the n known rows before each; null for the first n. Sums of products of rows and of the
    rows before them are taken over one window, and centred by its mean afterwards."""
    over = W.partitionBy(*keys).orderBy(order)
    a = series.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(over))
    made = {}
    for lag in range(1, lags + 1):
        made[f"_p{lag}"] = F.col(value) * F.lag(value, lag).over(over)
    a = a.withColumns(made)
    prior = over.rowsBetween(-n, -1)
    m = F.avg(value).over(prior)
    total = (F.avg(F.col(value) * F.col(value)).over(prior) - m * m)
    for lag in range(1, lags + 1):
        late = over.rowsBetween(-(n - lag), -1)  # the later rows of the window's pairs
        early = over.rowsBetween(-n, -1 - lag)
        gamma = F.avg(f"_p{lag}").over(late) - m * (F.avg(value).over(late) + F.avg(value).over(early)) + m * m
        total = total + 2 * (1 - lag / (lags + 1)) * gamma
    se = F.sqrt(F.when(total > 0, total) / n)
    enough = F.col("_k") > n
    return a.select(*keys, order, F.when(enough, m).alias("mean"), F.when(enough, ratio(m, se)).alias("t"))


def autocorrelation(series: DataFrame, keys: list[str], value: str, most: int = 12, order: str = "week") -> DataFrame:
    """Correlation of the series with itself k rows before, for k up to ``most``."""
    over = W.partitionBy(*keys).orderBy(order)
    a = series.withColumns({f"_l{k}": F.lag(value, k).over(over) for k in range(1, most + 1)})
    a = a.groupBy(*keys).agg(*(F.corr(value, f"_l{k}").alias(str(k)) for k in range(1, most + 1)))
    return a.unpivot(keys, [str(k) for k in range(1, most + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def histogram(series: DataFrame, keys: list[str], value: str, bins: int = 40) -> DataFrame:
    """Density of each of the even bins between the extremes; the last one is closed."""
    known = series.filter(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return known.join(span, keys).filter("_hi > _lo").groupBy(*keys, b.alias("bin"), "_lo", "_n", width.alias("width")).agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("width")).alias("left_edge"), "n", (F.col("n") / F.col("_n") / F.col("width")).alias("density"))


def correlations(series: DataFrame, name: str, value: str, order: str = "week") -> DataFrame:
    """Pairwise correlation of the named series over their common weeks. Names are few: a row a week and pair."""
    a = series.select(order, F.col(name).alias("a"), F.col(value).alias("x"))
    b = series.select(order, F.col(name).alias("b"), F.col(value).alias("y"))
    return a.join(b, order).filter("a <> b and x is not null and y is not null").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n"))


def nearest(pairs: DataFrame, twin: float = 0.995) -> DataFrame:
    """The most correlated other series of each, and whether it is a twin."""
    best = pairs.filter("rho is not null").groupBy("a").agg(F.min_by(F.struct("b", "rho"), F.struct(-F.abs("rho"), F.col("b"))).alias("m"))
    return best.select("a", F.col("m.b").alias("nearest"), F.col("m.rho").alias("rho"), (F.abs("m.rho") > twin).alias("twin"))


def quantile_points(series: DataFrame, keys: list[str], value: str, order: str = "week") -> DataFrame:
    """(keys, i, value, normal): sorted values beside the normal quantiles at i / (n + 1) of the same mean and deviation."""
    known = series.filter(F.col(value).isNotNull())
    whole = W.partitionBy(*keys)
    a = known.select(*keys, F.col(value).alias("value"), F.row_number().over(whole.orderBy(value, order)).alias("i"), F.count("*").over(whole).alias("n"), F.avg(value).over(whole).alias("m"), F.stddev_samp(value).over(whole).alias("s"))
    return a.select(*keys, "i", "value", (normal_quantile(F.col("i") / (F.col("n") + 1)) * F.col("s") + F.col("m")).alias("normal"))


def leaders(rows: DataFrame, keys: list[str], name: str, loading: str, k: int) -> DataFrame:
    """(keys, leaders): the k names of greatest magnitude, in order, each with the sign of its loading."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.abs(loading).desc(), name))).filter(F.col("_r") <= k)
    item = F.concat(F.col(name).cast("string"), F.when(F.col(loading) >= 0, "+").otherwise("-"))
    return ranked.groupBy(*keys).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("x")))), lambda s: s["x"])).alias("leaders"))
