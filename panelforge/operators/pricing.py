"""Three-pass risk premia from sums over symbols, for many models at once.

A model is a key (a candidate, a window) with its observed factors. What it needs of the symbols are sums: the products of
residuals of each two weeks, in which hidden factors are found, and products of betas, from which premia and their errors
follow. So symbols are dealt into parts of at most ``PART``, a part is worked through once a pass for all models, and what
leaves it are matrices of weeks by weeks and factors by factors. No task holds more than one part and one such matrix, and
models never copy the panel; where parts are fewer than cores, models are dealt over copies of the parts instead.

Passes: betas on observed factors (residual products, weekly and mean cross-sections); betas on observed and hidden factors;
errors of the premia. The driver holds the models' factors, weeks by factors for each, which do not grow with symbols.

A week counts in a model if any return and any of its factors is known there. Gaps of a factor take its mean, or with
fill="carry" its last value, leading ones the mean. A symbol counts with at least ``least`` returns in the model's weeks and as many as the betas need.
Models of fewer than ``least_weeks`` weeks, or with fewer symbols than factors and three, have no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import discard, materialize

#: Symbols of a part.
PART = 4000
SUMS = "model int, what string, i int, held array<double>"
PREMIA = "factor string, premium double, t double, low double, high double, premium_alone double, t_alone double, fmb_mean double, fmb_t double, n_hidden long, n_assets long"


@dataclass
class Model:
    keys: tuple
    names: list[str]
    weeks: np.ndarray  # places in the list of all weeks
    seen: np.ndarray  # weeks by observed factors
    hidden: np.ndarray | None = None
    alone: np.ndarray | None = None  # premia on observed factors
    full: np.ndarray | None = None

    @property
    def whole(self) -> np.ndarray:
        return np.hstack([self.seen, self.hidden])


def newey_west_se(x: np.ndarray, lags: int = 4) -> float:
    e = x - x.mean()
    g = (e @ e) / len(e) + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / (len(e) - k) for k in range(1, min(lags, len(e) - 1) + 1))
    return float(np.sqrt(max(g, 0.0) / len(e)))


def slopes(y: np.ndarray, known: np.ndarray, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of each row of y (symbols by weeks) on x with an intercept over its known weeks, its mean, its residuals (zero
    where unknown), and which rows these are: those with enough known weeks."""
    n = known.sum(1)
    use = n >= max(x.shape[1] + 2, 8, least)
    y, known, n = np.where(known, y, 0.0)[use], known[use].astype(float), n[use]
    middle, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    a = np.hstack([np.ones((len(x), 1)), (x - middle) / sd])
    k = a.shape[1]
    squares = (known @ (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)).reshape(-1, k, k)
    c = (np.linalg.pinv(squares, rcond=1e-12, hermitian=True) @ (y @ a)[:, :, None])[:, :, 0] if len(y) else np.zeros((0, k))
    return c[:, 1:] / sd, y.sum(1) / np.maximum(n, 1), (y - c @ a.T) * known, use


def products(b: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return (b.T @ b if weights is None else (b.T * weights) @ b).ravel()


def first_sums(model: Model, y: np.ndarray, known: np.ndarray, least: int):
    b, mean, e, use = slopes(y, known, model.seen, least)
    n, k = b.shape
    yield from (("residuals", i, np.append(row, n)) for i, row in enumerate(e.T @ e))
    there = known[use].astype(float)
    pairs = there.T @ (b[:, :, None] * b[:, None, :]).reshape(n, -1)
    yield from (("week", i, np.concatenate([row, v, [m]])) for i, (row, v, m) in enumerate(zip(pairs, np.where(known, y, 0.0)[use].T @ b, there.sum(0))))
    yield "means", 0, np.concatenate([products(b), b.T @ mean, [n]])


def second_sums(model: Model, y: np.ndarray, known: np.ndarray, least: int):
    b, mean, _, _ = slopes(y, known, model.whole, least)
    yield "means", 0, np.concatenate([products(b), b.T @ mean, [len(b)]])
    b, mean, _, _ = slopes(y, known, model.seen, least)
    yield "errors", 0, products(b, (mean - b @ model.alone) ** 2)


def third_sums(model: Model, y: np.ndarray, known: np.ndarray, least: int):
    b, mean, _, _ = slopes(y, known, model.whole, least)
    yield "errors", 0, products(b, (mean - b @ model.full) ** 2)


def over_symbols(symbols: DataFrame, models: list[Model], days: np.ndarray, sums, least: int) -> DataFrame:
    """(model, what, i, held): the models' sums, added up over all parts; days are all weeks, as symbols have them."""
    spark = symbols.sparkSession
    parts = max(1, -(-symbols.count() // PART))
    deals = max(1, min(len(models), spark.sparkContext.defaultParallelism // parts))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.full((len(pdf), len(days)), np.nan)
        for row, held, returns in zip(y, pdf["weeks"], pdf["returns"]):
            row[np.searchsorted(days, held)] = returns
        known, out = ~np.isnan(y), []
        for k in range(int(pdf["deal"].iloc[0]), len(models), deals):
            at = models[k].weeks
            out += [(k, what, i, held) for what, i, held in sums(models[k], y[:, at], known[:, at], least)]
        return pd.DataFrame(out, columns=["model", "what", "i", "held"])

    dealt = symbols.select("weeks", "returns", F.pmod(F.xxhash64("symbol"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    found = dealt.groupBy("part", "deal").applyInPandas(add, SUMS)
    if parts == 1:
        return found
    total = F.aggregate("all", F.transform(F.col("all")[0], lambda x: F.lit(0.0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    return found.groupBy("model", "what", "i").agg(F.collect_list("held").alias("all")).select("model", "what", "i", total.alias("held"))


def solved(held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Premia, the inverse of the betas' products, and the number of symbols, from "means"."""
    inverse = np.linalg.pinv(held[: k * k].reshape(k, k), hermitian=True)
    return inverse @ held[k * k : k * k + k], inverse, int(held[-1])


def hidden_factors(squares: np.ndarray, n: int, most: int) -> np.ndarray:
    """Weeks by the number of components that IC_p2 asks for, of unit deviation, from the residuals' products."""
    t = len(squares)
    values, vectors = np.linalg.eigh(squares)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    penalty = (n + t) / (n * t) * np.log(min(n, t))
    left = values.sum() - np.concatenate([[0.0], np.cumsum(values)])
    scores = [np.log(max(left[k] / (n * t), 1e-12)) + k * penalty for k in range(min(most, n, t) + 1)]
    found = vectors[:, : int(np.argmin(scores))] * np.sqrt(values[: int(np.argmin(scores))])
    sd = found.std(0, ddof=1)
    return found / np.where(sd > 0, sd, 1.0)


def models_of(factors: DataFrame, keys: list[str], shared: DataFrame | None, windows: list[tuple], weeks: pd.DatetimeIndex, fill: str) -> list[Model]:
    wide = {k: g.pivot_table(index="week", columns="factor", values="ret") for k, g in _series(factors, keys).groupby(keys)} if keys else {(): _series(factors, []).pivot_table(index="week", columns="factor", values="ret")}
    beside = _series(shared, []).pivot_table(index="week", columns="factor", values="ret") if shared is not None else None
    out = []
    for key, own in wide.items():
        f = own if beside is None else beside.join(own, how="outer")
        for window, lo, hi in windows:
            part = f if lo is None else f[(f.index >= lo) & (f.index <= hi)]
            part = part[part.index.isin(weeks)].dropna(how="all")
            part = (part.ffill() if fill == "carry" else part).pipe(lambda x: x.fillna(x.mean())).dropna(axis=1)
            if part.shape[1]:
                out.append(Model((*key, *(() if lo is None else (window,))), list(part.columns), weeks.get_indexer(part.index), part.to_numpy(float)))
    return out


def _series(df: DataFrame, keys: list[str]) -> pd.DataFrame:
    found = df.filter("ret is not null").select(*keys, "week", "factor", "ret").toPandas()
    return found.assign(week=pd.to_datetime(found["week"]))


def premia(returns: DataFrame, factors: DataFrame, keys: list[str] = (), shared: DataFrame | None = None, windows: list[tuple] = (), fill: str = "mean", least: int = 24, least_weeks: int = 30, most_hidden: int = 7) -> DataFrame:
    """Risk premia of observed factors, alone and beside hidden ones, and week by week, for each key and window.

    returns (week, symbol, ret); factors (keys, week, factor, ret), beside which every key has the ``shared`` ones (week,
    factor, ret); windows of (name, first, last), which add a column ``window``. Rows of a week and symbol are one."""
    spark, keys, windows = returns.sparkSession, list(keys), list(windows) or [("", None, None)]
    known = returns.filter("ret is not null").select("week", "symbol", "ret")
    # The panel is read once, and written as a row a symbol.
    series = known.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_date("week").alias("day"), "ret")).alias("x"))
    symbols = materialize(series.select("symbol", F.col("x.day").alias("weeks"), F.col("x.ret").alias("returns")), "symbols")
    days = np.array(sorted(r["day"] for r in symbols.select(F.explode("weeks").alias("day")).distinct().collect()), np.int64)
    weeks = pd.DatetimeIndex(days.astype("datetime64[D]"))
    windows = [(w, *(x if x is None else pd.Timestamp(x) for x in ends)) for w, *ends in windows]
    models = [m for m in models_of(factors, keys, shared, windows, weeks, fill) if len(m.weeks) >= least_weeks]
    kinds = dict(factors.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(["window string"] if windows[0][1] is not None else []), PREMIA])

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        model = models[pdf["model"].iloc[0]]
        held = {what: g.sort_values("i")["held"] for what, g in pdf.groupby("what")}
        k, squares = len(model.names), np.stack(held["residuals"])
        alone, inverse, n = solved(np.asarray(held["means"].iloc[0]), k)
        if n < k + 3:
            return pd.DataFrame({c.split(" ")[0]: [] for c in BEGUN.split(", ")}, dtype=object)
        hidden = hidden_factors(squares[:, :-1], n, most_hidden)
        weekly = np.array([np.linalg.pinv(x[: k * k].reshape(k, k), hermitian=True) @ x[k * k : -1] for x in held["week"] if x[-1] >= k + 2]).reshape(-1, k)
        mean = weekly.mean(0) if len(weekly) else np.full(k, np.nan)
        se = np.array([newey_west_se(x) if len(x) > 1 else np.nan for x in weekly.T])
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "n_hidden": [hidden.shape[1]], "hidden": [hidden.ravel()], "alone": [alone], "inverse": [inverse.ravel()], "mean": [mean], "t": [over(mean, se)]})

    def summed(chosen: list[Model], sums) -> DataFrame:
        return over_symbols(symbols, chosen, days, sums, least)

    rows = []
    begun = summed(models, first_sums).groupBy("model").applyInPandas(begin, BEGUN).orderBy("model").collect() if models else []
    chosen = [models[r["model"]] for r in begun]
    for m, r in zip(chosen, begun):
        m.hidden, m.alone = np.array(r["hidden"]).reshape(len(m.weeks), r["n_hidden"]), np.array(r["alone"])
    second = {(r["model"], r["what"]): np.array(r["held"]) for r in summed(chosen, second_sums).collect()} if chosen else {}
    inverses = []
    for k, m in enumerate(chosen):
        m.full, *found = solved(second[k, "means"], m.whole.shape[1])
        inverses.append(found)
    third = {r["model"]: np.array(r["held"]) for r in summed(chosen, third_sums).collect()} if chosen else {}
    for k, (m, r, (inverse, n_assets)) in enumerate(zip(chosen, begun, inverses)):
        n = len(m.names)
        error = white(inverse, third[k])[:n]
        full = m.full[:n]
        columns = [full, over(full, error), full - 1.96 * error, full + 1.96 * error, m.alone, over(m.alone, white(np.array(r["inverse"]).reshape(n, n), second[k, "errors"])), np.array(r["mean"], float), np.array(r["t"], float)]
        rows += [(*m.keys, name, *(None if np.isnan(x) else float(x) for x in values), r["n_hidden"], n_assets) for name, *values in zip(m.names, *columns)]
    discard(symbols)
    return spark.createDataFrame(rows, schema)


BEGUN = "model int, n_hidden int, hidden array<double>, alone array<double>, inverse array<double>, mean array<double>, t array<double>"


def over(x: np.ndarray, error: np.ndarray) -> np.ndarray:
    return np.divide(x, error, out=np.full(len(x), np.nan), where=error > 0)


def white(inverse: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Errors of premia from the inverse and the products weighted by squared residuals."""
    return np.sqrt(np.maximum(np.diag(inverse @ held.reshape(inverse.shape) @ inverse), 0.0))
