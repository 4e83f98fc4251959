"""Candidate search: a grid of rolling characteristics in both directions, sorted, tested, screened and priced at once.

Candidates are a key of one long table, so each step is one job over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from panelforge.functions import ratio
from panelforge.session import materialize

from . import factors, pricing, stats

#: The name of a candidate among the factors of its model.
CANDIDATE = "(candidate)"


#: Rows of the frames of each measure. Fixed values.
WINDOWS, RISK_WINDOWS, ATTENTION = (1, 2, 3, 4, 8, 12, 26, 52), (8, 12, 26, 52), (1, 2, 4, 8)
NAMES = [
    *(f"{m}_{n}w" for n in WINDOWS for m in ("ret", "vol", "maxret", "minret", "skew", "absret", "up", "tohigh", "tolow", "dmcap")),
    *(f"{m}_{n}w" for n in RISK_WINDOWS for m in ("beta", "corr_mkt", "upvol", "downvol", "volratio")), "age", "log_mcap", *(f"idvol_{n}w" for n in RISK_WINDOWS), *(f"attention_{n}w" for n in ATTENTION),
]
#: Symbols whose weeks are worked through side by side.
PART = 200


class Frames:
    """Measures of symbols side by side (symbols by rows, unknown values and rows that are not there NaN), over frames of the last n
    rows that must be known throughout: a frame is added up row by row, for all symbols and their rows at once."""

    def __init__(self, ret: np.ndarray, price: np.ndarray, mcap: np.ndarray, market: np.ndarray, days: np.ndarray):
        self.ret, self.price, self.mcap, self.market, self.days = ret, price, mcap, market, days

    @staticmethod
    def back(x: np.ndarray, k: int) -> np.ndarray:
        """x of k rows before."""
        return np.hstack([np.full((len(x), min(k, x.shape[1])), np.nan), x[:, : max(x.shape[1] - k, 0)]])

    def total(self, x: np.ndarray, n: int) -> np.ndarray:
        return sum((self.back(x, k) for k in range(1, n)), x.copy())

    def moment(self, x: np.ndarray, n: int, power: int) -> np.ndarray:
        """Sum of powers of what is over the mean."""
        middle = self.total(x, n) / n
        return sum(((self.back(x, k) - middle) ** power for k in range(n)), 0.0)

    def sd(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.sqrt(self.moment(x, n, 2) / (n - 1)) if n > 1 else np.full(x.shape, np.nan)

    def extreme(self, x: np.ndarray, n: int, which: Callable) -> np.ndarray:
        return reduce(which, (self.back(x, k) for k in range(n)))

    @staticmethod
    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.full(a.shape, np.nan), where=(b != 0))

    def skew(self, n: int) -> np.ndarray:
        """Bias-corrected; zero where all values are equal."""
        if n < 3:
            return np.full(self.ret.shape, np.nan)
        g = self.over(np.sqrt(n) * self.moment(self.ret, n, 3), self.moment(self.ret, n, 2) ** 1.5)
        top, least = (self.extreme(self.ret, n, f) for f in (np.maximum, np.minimum))
        return np.where(top == least, 0.0, np.sqrt(n * (n - 1)) / (n - 2) * g)

    def beta(self, n: int) -> np.ndarray:
        """Population covariance over sample variance."""
        r, m = self.ret, np.where(np.isnan(self.ret), np.nan, self.market)
        cov = self.total(r * m, n) / n - self.total(r, n) / n * (self.total(m, n) / n)
        return self.over(cov, self.moment(m, n, 2) / (n - 1))

    def correlation(self, n: int) -> np.ndarray:
        r, m = self.ret, np.where(np.isnan(self.ret), np.nan, self.market)
        rm, mm = self.total(r, n) / n, self.total(m, n) / n
        both = sum(((self.back(r, k) - rm) * (self.back(m, k) - mm) for k in range(n)), 0.0)
        return self.over(both, np.sqrt(self.moment(r, n, 2) * self.moment(m, n, 2)))

    def measure(self, name: str) -> np.ndarray:
        r, p = self.ret, self.price
        if name == "age":
            return (self.days - self.days[:, :1]) / 7
        if name == "log_mcap":
            return np.log(self.mcap, out=np.full(p.shape, np.nan), where=self.mcap > 0)
        kind, n = name[:-1].rsplit("_", 1)
        n = int(n)
        if kind in ("upvol", "downvol", "volratio"):
            up, down = np.where(r > 0, r, np.nan), np.where(r < 0, r, np.nan)
            return self.sd(up, n) if kind == "upvol" else self.sd(down, n) if kind == "downvol" else self.over(self.sd(down, n), self.sd(up, n))
        return {
            "ret": lambda: self.over(p, self.back(p, n)) - 1, "vol": lambda: self.sd(r, n), "maxret": lambda: self.extreme(r, n, np.maximum), "minret": lambda: self.extreme(r, n, np.minimum), "skew": lambda: self.skew(n),
            "absret": lambda: self.total(np.abs(r), n) / n, "up": lambda: self.total(np.where(r > 0, 1.0, 0.0), n) / n, "tohigh": lambda: self.over(p, self.extreme(p, n, np.maximum)) - 1,
            "tolow": lambda: self.over(p, self.extreme(p, n, np.minimum)) - 1, "dmcap": lambda: self.over(self.mcap, self.back(self.mcap, n)) - 1, "beta": lambda: self.beta(n), "corr_mkt": lambda: self.correlation(n),
            "idvol": lambda: self.sd(r - self.beta(n) * self.market, n),
        }[kind]()


def measured(rows: DataFrame, names: list[str], market: str = "market") -> DataFrame:
    """rows with a column for each of the named measures of ``NAMES``. Symbols are dealt into groups of about ``PART``; window functions
    would add up each frame of each row anew, value by value.

    Attention is the mean absolute return over its median among the week's symbols. Only these measures go to their week for it; the
    medians, a row a week, are written, and come to the rows."""
    attention = {x: f"absret_{x[10:]}" for x in names if x.startswith("attention_")}
    made = list(dict.fromkeys([*(x for x in names if x not in attention), *attention.values()]))
    parts = max(1, -(-rows.select("symbol").distinct().count() // PART))
    schema = StructType([*rows.schema.fields, *(StructField(x, DoubleType()) for x in made)])
    out_schema = to_arrow_schema(schema)

    def of_symbols(table: pa.Table) -> pa.Table:
        table = table.drop_columns("_g").sort_by([("symbol", "ascending"), ("week", "ascending")]).combine_chunks()
        symbol = table["symbol"].to_pandas().to_numpy()
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbol))))
        at = np.arange(len(symbol)) - first[own]
        side = lambda x: (lambda held: (held.__setitem__((own, at), x), held)[1])(np.full((len(first), at.max() + 1), np.nan))
        values = [side(table[c].to_numpy()) for c in ("ret", "price", "mcap", market)]
        frames = Frames(*values, side(table["week"].cast(pa.int32()).to_numpy()))
        with np.errstate(invalid="ignore", over="ignore"):
            found = [pa.array(frames.measure(x)[own, at], pa.float64(), from_pandas=True) for x in made]
        return pa.Table.from_arrays([*table.columns, *found], schema=out_schema)

    found = rows.withColumn("_g", F.pmod(F.xxhash64("symbol"), F.lit(parts))).groupBy("_g").applyInArrow(of_symbols, schema)
    if attention:
        middle = measured(rows.select("week", "symbol", "ret", "price", "mcap", market), list(attention.values()), market).repartition("week").groupBy("week")
        middle = materialize(middle.agg(*(F.percentile(x, 0.5).alias(f"_{x}") for x in attention.values())), "medians", free=True)
        found = found.join(middle, "week", "left").withColumns({x: ratio(F.col(a), F.col(f"_{a}")) for x, a in attention.items()})
    return found.select(*rows.columns, *names)


def grid(rows: DataFrame, market: str = "market") -> tuple[DataFrame, list[str]]:
    """rows with a column for each measure and window, and the columns' names."""
    return measured(rows, NAMES, market), NAMES


def candidates(rows: DataFrame, names: list[str], **how) -> DataFrame:
    """(week, factor, ret, n) of each characteristic, long its high leg (name+) and long its low leg (name-)."""
    high = factors.zoo(rows, {c: (c, False) for c in names}, **how)
    both = F.explode(F.array(F.struct(F.lit("+").alias("d"), F.lit(1.0).alias("s")), F.struct(F.lit("-").alias("d"), F.lit(-1.0).alias("s"))))
    return high.select("week", "factor", "ret", "n", both.alias("x")).select("week", F.concat("factor", "x.d").alias("factor"), (F.col("ret") * F.col("x.s")).alias("ret"), "n")


#: Characteristics whose values are on their way to their weeks at once.
AT_ONCE = 16


def all_candidates(rows: DataFrame) -> DataFrame:
    """As ``candidates`` of all measures of rows, which are written. Their values would be the panel many times over: they are made and go
    to their weeks ``AT_ONCE`` at a time, and what the disk held for these is freed before the next."""
    parts = [NAMES[k : k + AT_ONCE] for k in range(0, len(NAMES), AT_ONCE)]
    return reduce(DataFrame.unionByName, (materialize(candidates(measured(rows, part).select("week", "symbol", "fwd", *part), part), "legs", free=True) for part in parts))


def screened(series: DataFrame, least: int = 30) -> DataFrame:
    """Newey-West t of each candidate with its corrected p-values."""
    tests = stats.newey_west(series, ["factor"], "ret").filter((F.col("n") >= least) & F.col("t").isNotNull())
    return stats.corrections(tests, "t", ["factor"])


def unlike(base: DataFrame, series: DataFrame, twin: float = 0.995) -> DataFrame:
    """candidate, nearest base factor and its correlation, of the candidates that are no twin of a base factor."""
    own = series.select(F.col("factor").alias("candidate"), "week", F.col("ret").alias("x")).filter("x is not null")
    pairs = own.join(base.select("week", F.col("factor").alias("base"), F.col("ret").alias("y")), "week").groupBy("candidate", "base").agg(F.corr("x", "y").alias("rho")).filter("rho is not null")
    best = pairs.groupBy("candidate").agg(F.max_by(F.struct("base", "rho"), F.struct(F.abs("rho"), "base")).alias("m"))
    return best.select("candidate", F.col("m.base").alias("nearest"), F.col("m.rho").alias("rho")).filter(F.abs("rho") <= twin)


def priced(returns: DataFrame, base: DataFrame, series: DataFrame, windows: DataFrame, least: int = 80, fill: str = "mean") -> DataFrame:
    """Premia of each candidate beside the base factors in each window (window, lo, hi), with the nearest base factor; of the
    candidates with enough returns that are no twin of a base factor.

    A characteristic's two directions are one fit, as the premium and its t only change their sign."""
    high = series.filter(F.col("factor").endswith("+"))
    enough = high.groupBy("factor").agg(F.count("ret").alias("_n")).filter(F.col("_n") >= least).select("factor")
    keys = materialize(unlike(base, high.join(enough, "factor", "left_semi")), "candidates")
    own = high.withColumnRenamed("factor", "candidate").join(keys, "candidate", "left_semi").select("candidate", "week", F.lit(CANDIDATE).alias("factor"), "ret")
    spans = [(r["window"], r["lo"], r["hi"]) for r in windows.select("window", "lo", "hi").collect()]
    found = pricing.premia(returns, own, ["candidate"], base, spans, fill).filter(F.col("factor") == CANDIDATE).drop("factor").join(keys, "candidate")
    turned = ("premium", "t", "premium_alone", "t_alone", "fmb_mean", "fmb_t", "rho")
    low = found.withColumns({"candidate": F.regexp_replace("candidate", r"\+$", "-"), "low": -F.col("high"), "high": -F.col("low"), **{c: -F.col(c) for c in turned}})
    return found.unionByName(low)


def tested(series: DataFrame, prices: DataFrame, strict: float = 2.0, bar: float = 1.65) -> DataFrame:
    """What the search reports of each priced candidate: its return and the Newey-West t of that, its yearly premia and their
    t by each method, whether the t beside hidden factors passes the bars, and p-values of that t corrected for all tests."""
    own = stats.newey_west(series, ["factor"], "ret").select(F.col("factor").alias("candidate"), "n", F.col("t").alias("t_ret"))
    moments = series.groupBy(F.col("factor").alias("candidate")).agg((F.avg("ret") * 52).alias("ann_ret"), (ratio(F.avg("ret"), F.stddev("ret")) * 52**0.5).alias("sharpe"))
    yearly = {"premium_full": "premium", "premium_obs": "premium_alone", "premium_fmb": "fmb_mean"}
    found = prices.select("candidate", *((F.col(c) * 52).alias(a) for a, c in yearly.items()), F.col("t").alias("t_full"), F.col("t_alone").alias("t_obs"), F.col("fmb_t").alias("t_fmb"), "n_hidden", "nearest", "rho")
    found = own.join(moments, "candidate").join(found, "candidate").filter("t_full is not null")
    found = found.withColumns({"passes_strict": F.abs("t_full") >= strict, "passes": F.abs("t_full") >= bar})
    return stats.corrections(found, "t_full", ["candidate"])


def shortlist(series: DataFrame, tests: DataFrame, k: int, twin: float = 0.995) -> list[str]:
    """The k candidates of greatest |t_full|, in the direction that is paid, none a near twin of one before it.

    Candidates are a fixed grid, so their correlations are a table that does not grow with the data."""
    own = series.filter("ret is not null").select("factor", "week", "ret")
    pairs = own.join(own.select(F.col("factor").alias("other"), "week", F.col("ret").alias("y")), "week").filter("factor < other").groupBy("factor", "other").agg(F.corr("ret", "y").alias("rho"))
    twins = {frozenset((r["factor"], r["other"])) for r in pairs.filter(F.abs("rho") > twin).collect()}
    chosen: list[str] = []
    for r in tests.filter("t_full > 0").orderBy(F.desc("t_full"), "candidate").select("candidate").collect():
        if len(chosen) < k and not any(frozenset((r["candidate"], c)) in twins for c in chosen):
            chosen.append(r["candidate"])
    return chosen


def joint(returns: DataFrame, base: DataFrame, series: DataFrame, chosen: list[str], windows: DataFrame) -> DataFrame:
    """Premia of the base factors and the chosen candidates in one model for each window. Gaps of a factor are its mean in the
    whole sample (the first window by name "Full"), and its last value in the parts of it."""
    picked = base.select("week", "factor", "ret").unionByName(series.filter(F.col("factor").isin(chosen)).select("week", "factor", "ret"))
    spans = [(r["window"], r["lo"], r["hi"]) for r in windows.select("window", "lo", "hi").collect()]
    whole, parts = [x for x in spans if x[0] == "Full"], [x for x in spans if x[0] != "Full"]
    found = [pricing.premia(returns, picked, windows=x, fill=fill) for x, fill in ((whole, "mean"), (parts, "carry")) if x]
    return reduce(DataFrame.unionByName, found).withColumn("selected", F.col("factor").isin(chosen))
