"""Canonical correlations from sums of products: of two frames of few series, and of many symbols with few series.

Two frames: one aggregate gives all products of their columns. Symbols: what the fit needs of them is the products of each two
weeks, summed over symbols in parts, weeks by weeks whatever their number; each symbol's weight then follows from its own
series alone. So there is no limit on symbols, and no task holds more than one part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import materialize

#: Symbols of a part.
PART = 4000
#: Directions of less than this share of the greatest variance are no directions.
FLAT = 1e-10


def widened(series: DataFrame, name: str, value: str, least: float = 1.0) -> DataFrame:
    """A row a week and a column for each name of series (week, name, value) that is known in at least that share of all weeks.
    Names are chosen by an aggregate, so no other column is ever made."""
    weeks = series.select("week").distinct().count()
    known = series.groupBy(name).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least * weeks)
    names = sorted(r[name] for r in known.select(name).collect())
    return series.filter(F.col(name).isin(names)).groupBy("week").pivot(name, names).agg(F.first(value, ignorenulls=True))


def whitener(squares: np.ndarray) -> np.ndarray:
    """A matrix that makes of columns with these products ones that are orthonormal; flat directions are left out."""
    values, vectors = np.linalg.eigh(squares)
    keep = values > FLAT * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def signed(rows: np.ndarray) -> np.ndarray:
    """Rows turned so that the entry of greatest magnitude is positive."""
    top = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return rows * np.where(top == 0, 1, top)[:, None]


def drivers(names: list[str], weights: np.ndarray, most: int = 3) -> str:
    """The names of greatest weight with their signs."""
    return ", ".join(f"{names[i]}{'+' if weights[i] > 0 else '-'}" for i in np.argsort(-np.abs(weights), kind="stable")[:most] if weights[i])


def canonical_correlations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, rho, n, left_drivers, right_drivers) of two frames with a row a week, over weeks known in all columns: the
    correlations and on either side the three columns of greatest weight, with signs; the greatest on the left is positive."""
    spark = left.sparkSession
    a, b = [c for c in left.columns if c != "week"], [c for c in right.columns if c != "week"]
    x = {f"_x{i}": F.col(c).cast("double") for i, c in enumerate([*a, *b])}
    rows = left.join(right, "week").na.drop(subset=[*a, *b]).select(*(c.alias(k) for k, c in x.items()))
    names = list(x)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(F.count("*"), *(F.avg(c) for c in names), *(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    n, out = found[0], []
    schema = "pair int, rho double, n long, left_drivers string, right_drivers string"
    if n >= len(names) + 2:
        cov = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, found[1 + len(names) :]):
            cov[i, j] = cov[j, i] = v
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(np.where(sd > 0, sd, np.inf), np.where(sd > 0, sd, np.inf))
        p = len(a)
        wa, wb = whitener(corr[:p, :p]), whitener(corr[p:, p:])
        u, rho, v = np.linalg.svd(wa.T @ corr[:p, p:] @ wb, full_matrices=False)
        ca, cb = (wa @ u).T, (wb @ v.T).T
        turn = np.sign(ca[np.arange(len(ca)), np.abs(ca).argmax(1)])[:, None] if len(ca) else 1
        out = [(k, float(min(max(r, 0.0), 1.0)), n, drivers(a, x), drivers(b, y)) for k, (r, x, y) in enumerate(zip(rho, ca * turn, cb * turn))]
    return spark.createDataFrame(out, schema)


def whole_series(returns: DataFrame, weeks: DataFrame) -> DataFrame:
    """(symbol, values) in order of weeks, of the symbols that are known in all of them."""
    inside = returns.filter("ret is not null").join(weeks.select("week").distinct(), "week", "left_semi")
    values = F.transform(F.array_sort(F.collect_list(F.struct("week", "ret"))), lambda x: x["ret"])
    return inside.groupBy("symbol").agg(values.alias("values")).filter(F.size("values") == weeks.select("week").distinct().count())


def _dot(values: Column, other: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, other)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def forward_canonical(returns: DataFrame, market: DataFrame, fit_weeks: DataFrame, k: int = 3) -> DataFrame:
    """(week, component, rho, value): canonical variates of all symbols that have a return in every week of ``fit_weeks``, with
    the market series, fitted on these weeks, scaled by their moments, and applied to every week (an unknown return is zero).
    Weights have unit length, and the greatest is positive."""
    spark, empty = returns.sparkSession, "week date, component int, rho double, value double"
    # Each is read several times; returns are written as they come, the others are a row a week.
    returns, market, fit_weeks = materialize(returns.select("week", "symbol", "ret"), "returns"), materialize(market, "market"), materialize(fit_weeks.select("week"), "fit-weeks")
    fit = fit_weeks.distinct().join(market.select("week").distinct(), "week", "left_semi")
    series = [c for c, t in market.dtypes if t == "double"]
    y = market.join(fit, "week", "left_semi").orderBy("week").select(*series).toPandas().dropna(axis=1).to_numpy(float)  # weeks by series
    mean = _dot(F.col("values"), [1.0 / max(len(y), 1)] * len(y))
    symbols = whole_series(returns, fit).withColumn("mean", mean)
    symbols = symbols.withColumn("sd", F.sqrt(_dot(F.transform("values", lambda v: (v - F.col("mean")) ** 2), [1.0 / max(len(y), 1)] * len(y))))
    symbols = materialize(symbols.withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)).withColumn("z", F.transform("values", lambda v: (v - F.col("mean")) / F.col("sd"))).drop("values"), "symbols")
    n = symbols.count()
    if not n or not y.size:
        return spark.createDataFrame([], empty)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["z"])
        return pd.DataFrame({"i": range(z.shape[1]), "held": list(z.T @ z)})

    parts = -(-n // PART)
    sums = symbols.select("z", F.pmod(F.xxhash64("symbol"), F.lit(parts)).alias("part")).groupBy("part").applyInPandas(products, "i int, held array<double>")
    total = F.aggregate("all", F.transform(F.col("all")[0], lambda x: F.lit(0.0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    gram = np.array([r["held"] for r in sums.groupBy("i").agg(F.collect_list("held").alias("all")).select("i", total.alias("held")).orderBy("i").collect()])  # weeks by weeks
    y = (y - y.mean(0)) / np.where(y.std(0) > 0, y.std(0), 1.0)
    values, vectors = np.linalg.eigh(gram)
    keep = values > FLAT * values.max()
    p, rho, _ = np.linalg.svd(vectors[:, keep].T @ (y @ whitener(y.T @ y)), full_matrices=False)
    k = min(k, len(rho))
    by_week = (vectors[:, keep] / values[keep]) @ p[:, :k]  # a symbol's weight is its series times this
    held = materialize(symbols.select("symbol", "mean", "sd", F.array(*(_dot(F.col("z"), by_week[:, j].tolist()) for j in range(k))).alias("w")), "weights")
    scale = held.agg(*(F.struct(F.sqrt(F.sum(F.col("w")[j] ** 2)).alias("norm"), F.max_by(F.col("w")[j], F.abs(F.col("w")[j])).alias("top"), F.sum(F.col("mean") / F.col("sd") * F.col("w")[j]).alias("lift")) for j in range(k))).first()
    turn = [(1 if r["top"] >= 0 else -1) / r["norm"] if r["norm"] else 0.0 for r in scale]
    known = returns.filter("ret is not null").join(held, "symbol").groupBy("week").agg(*(F.sum(F.col("ret") / F.col("sd") * F.col("w")[j]).alias(f"_v{j}") for j in range(k)))
    every = returns.select("week").distinct().join(known, "week", "left")
    of = F.array(*(F.struct(F.lit(j + 1).alias("component"), F.lit(float(min(rho[j], 1.0))).alias("rho"), ((F.coalesce(f"_v{j}", F.lit(0.0)) - scale[j]["lift"]) * turn[j]).alias("value")) for j in range(k)))
    return every.select("week", F.explode(of).alias("x")).select("week", "x.*")
