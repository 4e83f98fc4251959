"""Factors: long-short returns of sorted characteristics, market series and cluster-neutral variants, all in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import ratio

from . import rolling, xsec
from .panel import by_symbol


def long_short(rows: DataFrame, x: str, ret: str = "fwd", frac: float = 0.3, floor: int = 3, min_names: int = 10, long_low: bool = False, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """Mean return of the high leg less that of the low leg (or the reverse), by week."""
    legs = xsec.legs(rows.filter(F.col(ret).isNotNull()), x, frac, floor, min_names, by)
    low, high = F.avg(F.when(F.col("r") <= F.col("k"), F.col(ret))), F.avg(F.when(F.col("r") > F.col("n") - F.col("k"), F.col(ret)))
    return legs.groupBy(*by).agg((low - high if long_low else high - low).alias("ret"), F.max("n").alias("n"))


def zoo(rows: DataFrame, specs: dict[str, tuple[str, bool]], ret: str = "fwd", frac: float = 0.3, floor: int = 3, min_names: int = 10) -> DataFrame:
    """(week, factor, ret, n) of many factors as of ``long_short``; specs: name to (column, long the low leg). A week's rows meet
    once, their measures side by side: no measure makes rows of its own."""

    def sort(names: list[str], x: np.ndarray, known: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        return leg_returns(specs, names, x, known, held, frac, floor, min_names)

    return xsec.by_week(rows.filter(F.col(ret).isNotNull()), {f: c for f, (c, _) in specs.items()}, ret, sort, "factor string, ret double, n long")


def leg_returns(specs: dict[str, tuple[str, bool]], names: list[str], x: np.ndarray, known: np.ndarray, held: np.ndarray, frac: float = 0.3, floor: int = 3, min_names: int = 10) -> Iterator[tuple]:
    """(factor, ret, n) of a week's rows, which stand in order of symbols."""
    for j, f in enumerate(names):
        use = known[:, j]
        n = int(use.sum())
        if n >= min_names:
            back = held[use][np.argsort(x[use, j], kind="stable")]
            k = max(int(np.rint(n * frac)), floor)
            yield f, (back[-k:].mean() - back[:k].mean()) * (-1.0 if specs[f][1] else 1.0), n


def weekly_evidence(rows: DataFrame, specs: dict[str, tuple[str, bool]], rounded_to: int, ret: str = "fwd") -> DataFrame:
    """(week, what, factor, value, n): of each week "ret" as of ``zoo``, "ic" as of ``information_coefficients`` with measures rounded
    to so many places, and "market", the mean return. A week's rows meet once for all of them."""
    if 2 * len(specs) > xsec.SIDE_BY_SIDE:
        raise ValueError("measures and their roundings must fit side by side")
    made = rows.filter(F.col(ret).isNotNull()).select("week", "symbol", ret, *(x.alias(n) for f, (c, _) in specs.items() for n, x in ((f"x_{f}", F.col(c)), (f"y_{f}", F.round(F.col(c).cast("double"), rounded_to)))))

    def run(names: list[str], x: np.ndarray, known: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        own = [f[2:] for f in names[::2]]
        yield from (("ret", f, value, n) for f, value, n in leg_returns(specs, own, x[:, ::2], known[:, ::2], held))
        yield from (("ic", f, value, n) for f, n, value in xsec.correlations_of(own, x[:, 1::2], known[:, 1::2], held))
        yield "market", None, float(held.mean()), len(held)

    return xsec.by_week(made, {n: n for n in made.columns[3:]}, ret, run, "what string, factor string, value double, n long")


def equal_weight_market(rows: DataFrame) -> DataFrame:
    return rows.groupBy("week").agg(F.avg("ret").alias("market"))


def cap_weight_market(rows: DataFrame) -> DataFrame:
    """Returns weighted by the previous row's mcap; null where no weight is positive."""
    known = rows.withColumn("w", F.lag("mcap").over(by_symbol())).filter("w is not null and ret is not null")
    sums = known.groupBy("week").agg(F.sum(F.col("w") * F.col("ret")).alias("a"), F.sum("w").alias("b"))
    return sums.select("week", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("market"))


def market_state(rows: DataFrame, leader) -> DataFrame:
    """Weekly dispersion, mean, and the leader's share of all mcap."""
    return rows.groupBy("week").agg(F.stddev_samp("ret").alias("dispersion"), F.avg("ret").alias("mean_ret"), ratio(F.sum(F.when(F.col("symbol") == leader, F.col("mcap"))), F.sum("mcap")).alias("dominance"))


def cluster_neutral(rows: DataFrame, x: str, group: str, least: int = 4) -> DataFrame:
    """Mean over groups of the upper half's less the lower half's mean return; groups need ``least`` rows."""
    known = rows.filter(F.col(x).isNotNull() & F.col("fwd").isNotNull())
    over = W.partitionBy("week", group)
    a = known.withColumn("n", F.count("*").over(over)).filter(F.col("n") >= least).withColumn("r", F.row_number().over(over.orderBy(x, "symbol")))
    half = F.floor(F.col("n") / 2)
    spread = a.groupBy("week", group).agg((F.avg(F.when(F.col("r") > F.col("n") - half, F.col("fwd"))) - F.avg(F.when(F.col("r") <= half, F.col("fwd")))).alias("s"))
    return spread.groupBy("week").agg(F.avg("s").alias("ret"), F.count("*").alias("n_groups"))


def quintile_returns(rows: DataFrame, x: str, q: int = 5) -> DataFrame:
    """Mean forward return of each quantile bin by week."""
    binned = xsec.quantile_bins(rows.filter(F.col("fwd").isNotNull() & F.col(x).isNotNull()), x, "bin", [k / q for k in range(q + 1)])
    return binned.groupBy("week", "bin").agg(F.avg("fwd").alias("ret"), F.count("*").alias("n"))


def quintile_spread(quintiles: DataFrame) -> DataFrame:
    """Top less bottom bin by week; the labels are the least and greatest bin of all weeks."""
    ends = quintiles.agg(F.max("bin").alias("hi"), F.min("bin").alias("lo"))
    a = quintiles.crossJoin(F.broadcast(ends))  # ends is one row
    return a.groupBy("week").agg((F.max(F.when(F.col("bin") == F.col("hi"), F.col("ret"))) - F.max(F.when(F.col("bin") == F.col("lo"), F.col("ret")))).alias("spread"))


def characteristics(rows: DataFrame) -> DataFrame:
    """Adds the sorting characteristics of rows with ret: momentum, volatility, extremes, reversal, size and ratios."""
    r, p = F.col("ret"), F.col("price")
    return rows.withColumns({
        "mom4": rolling.total(F.log1p(r), 4, 3, skip=1), "mom12": rolling.total(F.log1p(r), 12, 8, skip=1), "mom2c": rolling.compounded(r, 2), "mom4c": rolling.compounded(r, 4, 3),
        "vol4": rolling.sd(r, 4), "max4": rolling.highest(r, 4), "min8": rolling.lowest(r, 8, 6), "absmean4": rolling.mean(F.abs(r), 4), "up8": rolling.up_frequency(r, 8),
        "to_high8": p / rolling.highest(p, 8) - 1, "to_low8": p / rolling.lowest(p, 8) - 1, "mcap_change4": ratio(F.col("mcap"), F.lag("mcap", 4).over(by_symbol())) - 1,
        "log_mcap": F.log("mcap"), "fee_yield": ratio(F.col("fees"), F.col("mcap")), "tvl_ratio": ratio(F.col("tvl"), F.col("mcap")), "turnover": ratio(F.col("volume"), F.col("mcap")),
        "age": F.row_number().over(by_symbol()) - 1,
    })


#: The factors' measures and the sign in which a high score is held long. Fixed values.
SIGNED = {
    "VolC": ("vol4", -1), "MAXRET": ("max4", -1), "CRASH8": ("min8", -1), "BETA26": ("beta26", 1), "TVLC": ("tvl_ratio", -1), "SKEW52": ("skew52", 1), "NEWC": ("age", -1),
    "RMOM1w": ("rmom1", 1), "RMOM2w": ("rmom2", 1), "SMBC": ("log_mcap", -1), "NetRel": ("relative", 1), "MomC": ("mom4c", 1), "NetMom": ("within", 1), "FunC": ("fee_yield", 1),
}


#: The characteristics that ``signed_factors`` reads.
READ = ("ret", "vol4", "max4", "min8", "tvl_ratio", "age", "log_mcap", "mom2c", "mom4c", "fee_yield")


def signed_factors(rows: DataFrame, market: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Adds z_NAME for each signed factor, a flat week as zero. rows are characteristics with a cluster (may be null, a group
    of its own); market (week, market) is the equal-weight return."""
    r = F.col("ret")
    a = rows.join(market, "week", "left")
    a = a.withColumns({"beta26": rolling.beta(r, F.col("market"), 26, 13), "skew52": rolling.skew_adjusted(r, 52, 26), "rmom1": ratio(r, F.col("vol4")), "rmom2": ratio(F.col("mom2c"), F.col("vol4"))})
    a = xsec.network_signals(a, "mom4c", cluster)
    a = a.withColumns({f"_r_{f}": F.col(x).cast("double") * sign for f, (x, sign) in SIGNED.items()})
    # The week's rows are together already, for the ranks; a join of their moments would make all of this twice.
    return a.withColumns({f"z_{f}": xsec.zscore_over(f"_r_{f}") for f in SIGNED}).drop(*(f"_r_{f}" for f in SIGNED))


def cash_flow_yield(rows: DataFrame) -> DataFrame:
    """Adds 52 weeks' worth of fees and half the tvl income, by four-week means, over mcap."""
    fee, income = rolling.mean(F.col("fees"), 4, 2), rolling.mean(F.col("tvl"), 4, 2)
    return rows.withColumn("cash_yield", ratio(52 * fee + 0.5 * 52 * income, F.col("mcap")))


def activity_growth(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds the mean over metrics, nulls skipped, of the z-scores of short over long mean, less 1."""
    for m in metrics:
        rows = rows.withColumn(f"_g_{m}", ratio(rolling.mean(F.col(m), 4, 2), rolling.mean(F.col(m), 16, 6)) - 1)
        rows = xsec.zscore(rows, f"_g_{m}", f"_z_{m}", flat_to_zero=False)
    known = F.filter(F.array(*(f"_z_{m}" for m in metrics)), lambda z: z.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, z: a + z) / F.size(known))
    return rows.withColumn("growth", mean).drop(*(f"_{k}_{m}" for m in metrics for k in "gz"))


def supply_emission(rows: DataFrame, n: int = 12) -> DataFrame:
    """Adds minus the z-score of the n-row change of mcap over price."""
    rows = rows.withColumn("_supply", ratio(F.col("mcap"), F.col("price")))
    rows = rows.withColumn("_e", ratio(F.col("_supply"), F.lag("_supply", n).over(by_symbol())) - 1)
    rows = xsec.zscore(rows, "_e", "_z", flat_to_zero=False)
    return rows.withColumn("emission", -F.col("_z")).drop("_supply", "_e", "_z")


def supply_trend(rows: DataFrame, least: int = 30, low: float = -0.03 / 365, high: float = 0.50 / 365) -> DataFrame:
    """Log-linear trend of mcap over price by day, slope clamped, and the supply it gives for each week, at most the observed maximum."""
    a = rows.filter("mcap > 0 and price > 0").withColumn("_y", F.log(F.col("mcap") / F.col("price")))
    first = a.groupBy("symbol").agg(F.min("week").alias("day0"))
    a = a.join(first, "symbol").withColumn("_t", F.datediff("week", "day0").cast("double"))
    fit = a.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("_y", "_t").alias("b"), F.avg("_y").alias("my"), F.avg("_t").alias("mt"), F.exp(F.max("_y")).alias("most")).filter(F.col("n") >= least)
    fit = fit.withColumn("slope", F.greatest(F.least("b", F.lit(high)), F.lit(low)))
    level = F.exp(F.col("my") + F.col("slope") * (F.col("_t") - F.col("mt")))
    return a.join(fit, "symbol").select("symbol", "week", "slope", F.least(level, "most").alias("supply"))


def reconstruction_error(rows: DataFrame, least: int = 31) -> DataFrame:
    """(years_back, median_abs_pct_err, n_coins): price times the fitted supply against the real mcap, for symbols with
    enough weeks. Years are counted back from the last week of all."""
    fit = supply_trend(rows).join(rows.select("symbol", "week", "price", "mcap"), ["symbol", "week"])
    last = rows.agg(F.max("week").alias("_last"))  # one row
    e = fit.crossJoin(F.broadcast(last)).withColumns({"years_back": F.floor(F.datediff("_last", "week") / 365.25).cast("int"), "ape": F.abs(ratio(F.col("supply") * F.col("price"), F.col("mcap")) - 1)})
    s = e.groupBy("symbol", "years_back").agg(F.median("ape").alias("m"), F.count("*").alias("n"))
    s = s.withColumn("total", F.sum("n").over(W.partitionBy("symbol"))).filter(F.col("total") >= least)
    return s.groupBy("years_back").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("median_abs_pct_err"), F.countDistinct("symbol").alias("n_coins"))
