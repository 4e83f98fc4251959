"""Market regimes: causal features, labels by terciles, class probabilities by boosted trees, and the weekly spine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import finite
from panelforge.session import materialize

from . import rolling

CLASSES = ("RiskOff", "Neutral", "RiskOn")
#: Weekly observables, and the features that are their scores of the week before.
OBSERVED = ("dispersion", "d_dominance", "entropy", "mom", "dominance", "vol")
FEATURES = tuple(f"z_{c}" for c in OBSERVED)
WINDOW, LEAST = 52, 12


def observables(market: DataFrame, entropy: DataFrame | None = None) -> DataFrame:
    """Adds four-week momentum, eight-week volatility and the four-week change of dominance to market (week, mean_ret,
    dominance, dispersion), one row a week, and entropy (week, entropy), unknown if not given."""
    by = W.orderBy("week")
    a = market.join(entropy.select("week", "entropy"), "week", "left") if entropy is not None else market.withColumn("entropy", F.lit(None).cast("double"))
    return a.withColumns({"mom": rolling.total(F.col("mean_ret"), 4, 2, by=()), "vol": rolling.sd(F.col("mean_ret"), 8, 4, by=()), "d_dominance": F.col("dominance") - F.lag("dominance", 4).over(by)})


def _z(c: str, lag: int) -> Column:
    return rolling.zscore_lagged(F.col(c), WINDOW, LEAST, lag=lag)


def features(observed: DataFrame) -> DataFrame:
    """(week, z_...): scores over 52 weeks as known a week before; an unknown entropy is no information, zero."""
    made = {c: _z(c, 1) for c in OBSERVED}
    made["entropy"] = F.coalesce(made["entropy"], F.lit(0.0))
    return observed.select("week", *(x.alias(f"z_{c}") for c, x in made.items()))


def labels(observed: DataFrame) -> DataFrame:
    """(week, score, label): the score of momentum less half that of dispersion and a quarter of that of the change of
    dominance, of the same week, cut at its terciles over all weeks; at 0.35 either side with fewer than 12 scores. Weeks
    without a score are neutral."""
    a = observed.select("week", (_z("mom", 0) - 0.5 * _z("dispersion", 0) - 0.25 * _z("d_dominance", 0)).alias("score"))
    a = materialize(a, "scores")  # a row a week; added up anew in another order, a score at a tercile would miss it
    edges = a.agg(F.percentile("score", [1 / 3, 2 / 3]).alias("_q"), F.count("score").alias("_n"))
    a = a.crossJoin(F.broadcast(edges))  # edges is one row
    low, high = (F.when(F.col("_n") >= LEAST, F.col("_q")[i]).otherwise(d) for i, d in ((0, -0.35), (1, 0.35)))
    label = F.when(F.col("score") <= low, "RiskOff").when(F.col("score") >= high, "RiskOn").otherwise("Neutral")
    return a.select("week", "score", label.alias("label"))


def boosted_probabilities(x: np.ndarray, y: np.ndarray, ask: np.ndarray, rounds: int = 120, rate: float = 0.05, share: float = 0.85, penalty: float = 3.0, seed: int = 42) -> np.ndarray:
    """Class probabilities at ``ask`` of gradient-boosted trees of two levels over a softmax, with second-order leaves,
    each tree on a share of the rows and of the columns."""
    random = np.random.default_rng(seed)
    k = int(y.max()) + 1
    margin, asked = np.zeros((len(x), k)), np.zeros((len(ask), k))

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
        best = (1e-9, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + penalty)
        for c in columns:
            order = rows[np.argsort(x[rows, c], kind="stable")]
            v, gl, hl = x[order, c], np.cumsum(g[order]), np.cumsum(h[order])
            gain = gl**2 / (hl + penalty) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + penalty) - whole
            gain[:-1][(v[1:] <= v[:-1]) | (hl[:-1] < 1) | (hl[-1] - hl[:-1] < 1)] = -np.inf  # as least weight of a leaf 1
            gain[-1] = -np.inf
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (int(c), (v[at] + v[at + 1]) / 2))
        return best[1]

    def grow(rows: np.ndarray, mine: np.ndarray, others: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, cls: int, all_rows: np.ndarray) -> None:
        cut = split(rows, g, h, columns) if depth and len(rows) > 1 else None
        if cut is None:
            leaf = -rate * g[rows].sum() / (h[rows].sum() + penalty)
            margin[all_rows, cls] += leaf
            asked[others, cls] += leaf
            return
        c, at = cut
        for side in (True, False):
            grow(rows[(x[rows, c] < at) == side], mine, others[(ask[others, c] < at) == side], g, h, columns, depth - 1, cls, all_rows[(x[all_rows, c] < at) == side])

    onehot = np.eye(k)[y]
    for _ in range(rounds):
        p = np.exp(margin - margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rows = np.flatnonzero(random.random(len(x)) < share)
        for cls in range(k):
            columns = np.sort(random.permutation(x.shape[1])[: max(1, int(share * x.shape[1]))])
            grow(rows, rows, np.arange(len(ask)), p[:, cls] - onehot[:, cls], 2 * p[:, cls] * (1 - p[:, cls]), columns, 2, cls, np.arange(len(x)))
    p = np.exp(asked - asked.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def probabilities(known: DataFrame, targets: DataFrame, first_out: str | None = None, least: int = 30) -> DataFrame:
    """(week, p_RiskOff, p_Neutral, p_RiskOn, target, split): boosted trees trained on the weeks before ``first_out`` (or the
    first seven tenths) of those whose features are known, asked about all of these. With too few weeks or classes every
    week is neutral. One row a week, so the series is one group by its nature."""
    whole = [c for c in FEATURES if c != "z_entropy"]
    clean = known.dropna(subset=whole).select("week", *(F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in FEATURES)).join(targets.select("week", "label"), "week")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        first = pd.Timestamp(first_out).date() if first_out else pdf["week"].iloc[int(len(pdf) * 0.7)] if len(pdf) else None
        x, y = pdf[list(FEATURES)].to_numpy(float), pdf["label"].map(CLASSES.index).to_numpy(int)
        train = np.array([w < first for w in pdf["week"]], bool)
        enough = train.sum() >= least and len(set(y[train])) == len(CLASSES)
        p = boosted_probabilities(x[train], y[train], x) if enough else np.tile([0.0, 1.0, 0.0], (len(x), 1))
        return pd.DataFrame({"week": pdf["week"], **{f"p_{c}": p[:, i] for i, c in enumerate(CLASSES)}, "target": pdf["label"], "split": np.where(train, "train", "test")})

    return clean.groupBy().applyInPandas(fit, "week date, p_RiskOff double, p_Neutral double, p_RiskOn double, target string, split string")


def on_weeks(weeks: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each week: its probabilities, or neutral where there are none, and the likeliest regime (the first of equals)."""
    a = weeks.select("week").distinct().join(known, "week", "left")
    p = [F.coalesce(f"p_{c}", F.lit(0.0)) for c in CLASSES]
    none = p[0] + p[1] + p[2] == 0
    off, neutral, on = p[0], F.when(none, 1.0).otherwise(p[1]), p[2]
    label = F.when((off >= neutral) & (off >= on), "RiskOff").when(neutral >= on, "Neutral").otherwise("RiskOn")
    return a.select("week", off.alias("p_RiskOff"), neutral.alias("p_Neutral"), on.alias("p_RiskOn"), label.alias("regime"))
