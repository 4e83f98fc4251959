"""Portfolios: weights, backtests, allocations between books, variants and benchmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelforge.functions import leg_count, ratio
from panelforge.session import materialize


def turnover(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of absolute weight changes of each week against the one before; in the first week against nothing.

    A week's weights are shifted to the next week of the calendar and meet it in one aggregation by symbol."""
    weeks = weights.select(*keys, "week").distinct().withColumn("next", F.lead("week").over(W.partitionBy(*keys).orderBy("week")))
    ahead = weights.join(weeks, [*keys, "week"]).filter("next is not null").select(*keys, F.col("next").alias("week"), "symbol", (-F.col("w")).alias("w"))
    change = weights.select(*keys, "week", "symbol", "w").unionByName(ahead).groupBy(*keys, "week", "symbol").agg(F.abs(F.sum("w")).alias("d"))
    return change.groupBy(*keys, "week").agg((F.sum("d") / 2).alias("turnover"))


def backtest(weights: DataFrame, returns: DataFrame, keys: list[str], cost_bps: float = 10.0) -> DataFrame:
    """Weekly gross and net profit, turnover, cost and exposures; a missing forward return earns nothing."""
    held = weights.join(returns.select("week", "symbol", "fwd"), ["week", "symbol"], "left")
    a = held.groupBy(*keys, "week").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.sum(F.greatest("w", F.lit(0.0))).alias("long"), F.sum(F.least("w", F.lit(0.0))).alias("short"), F.count_if(F.col("w") != 0).alias("names"))
    cost = F.col("turnover") * cost_bps / 1e4
    return a.join(turnover(weights, keys), [*keys, "week"]).select(*keys, "week", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"), "long", "short", "names")


def combined_backtest(weights: DataFrame, allocation: DataFrame, returns: DataFrame, variants: list[str], books: list[str], cost_bps: float = 10.0) -> DataFrame:
    """As ``backtest`` by variant of ``combine`` by variant, but no variant makes rows: a name's weights of a week stand side by side, a
    book beside the other, with those of the week before, and all variants' sums are taken of them in one pass. ``allocation`` has a row
    for each variant, week and book; it is written side by side, a row a week, with the shares of the week before."""
    at = {(v, b): f"_s{i}_{j}" for i, v in enumerate(variants) for j, b in enumerate(books)}
    shares = allocation.groupBy("week").agg(*(F.sum(F.when((F.col("variant") == v) & (F.col("book") == b), F.col("share"))).alias(c) for (v, b), c in at.items()))
    weeks = weights.select("week").distinct().join(shares, "week")
    over = W.orderBy("week")  # a row a week
    weeks = materialize(weeks.withColumns({"next": F.lead("week").over(over), **{f"{c}_": F.lag(c).over(over) for c in at.values()}}), "shares", free=True)
    now = weights.select("week", "symbol", *(F.when(F.col("book") == b, F.col("w")).alias(f"_w{j}") for j, b in enumerate(books)), *(F.lit(None).cast("double").alias(f"_p{j}") for j in range(len(books))), F.lit(None).cast("double").alias("fwd"))
    past = weights.join(weeks.select("week", "next"), "week").filter("next is not null")
    past = past.select(F.col("next").alias("week"), "symbol", *(F.lit(None).cast("double").alias(f"_w{j}") for j in range(len(books))), *(F.when(F.col("book") == b, F.col("w")).alias(f"_p{j}") for j, b in enumerate(books)), F.lit(None).cast("double").alias("fwd"))
    ahead = returns.filter("fwd is not null").select("week", "symbol", *(F.lit(None).cast("double").alias(f"_{k}{j}") for k in "wp" for j in range(len(books))), "fwd")
    sides = [f"_{k}{j}" for k in "wp" for j in range(len(books))]
    rows = now.unionByName(past).unionByName(ahead).groupBy("week", "symbol").agg(*(F.sum(c).alias(c) for c in (*sides, "fwd"))).join(weeks, "week")
    total = lambda v, k, tail: sum((F.coalesce(F.col(f"_{k}{j}") * F.col(f"{at[v, b]}{tail}"), F.lit(0.0)) for j, b in enumerate(books)), F.lit(0.0))
    rows = rows.select("week", "fwd", *(total(v, "w", "").alias(f"_c{i}") for i, v in enumerate(variants)), *(total(v, "p", "_").alias(f"_b{i}") for i, v in enumerate(variants)))
    sums = {}
    for i in range(len(variants)):
        w = F.col(f"_c{i}")
        sums |= {f"gross{i}": F.sum(w * F.coalesce("fwd", F.lit(0.0))), f"turnover{i}": F.sum(F.abs(w - F.col(f"_b{i}"))) / 2, f"long{i}": F.sum(F.greatest(w, F.lit(0.0))), f"short{i}": F.sum(F.least(w, F.lit(0.0))), f"names{i}": F.count_if(w != 0)}
    found = rows.groupBy("week").agg(*(x.alias(c) for c, x in sums.items()))
    made = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), *(F.col(f"{c}{i}").alias(c) for c in ("gross", "turnover", "long", "short", "names"))) for i, v in enumerate(variants))))
    cost = F.col("turnover") * cost_bps / 1e4
    return found.select("week", made.alias("v")).select("v.variant", "week", "v.gross", "v.turnover", "v.long", "v.short", "v.names").select("variant", "week", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"), "long", "short", "names")


def combine(weights: DataFrame, allocation: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over books of weight times allocation; allocation (by, week, book, share)."""
    return weights.join(allocation, ["week", "book"]).groupBy(*by, "week", "symbol").agg(F.sum(F.col("w") * F.col("share")).alias("w"))


def trailing_score(net: DataFrame, lookback: int = 26, least: int = 8) -> DataFrame:
    """Adds score: the positive part of the prior rows' mean over deviation, times one plus their worst drawdown; null
    where fewer than ``least`` rows are prior. Rows count whether their net is known or not."""
    over = W.partitionBy("book").orderBy("week").rowsBetween(-lookback, -1)
    a = net.withColumn("_h", F.collect_list("net").over(over)).withColumn("_n", F.count(F.lit(1)).over(over))
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("dd"))

    def fold(s: Column, r: Column) -> Column:
        w = s["w"] * (1 + r)
        top = F.greatest(s["top"], w)
        return F.struct(w.alias("w"), top.alias("top"), F.least(s["dd"], w / top - 1).alias("dd"))

    dd = F.aggregate("_h", zero, fold, lambda s: s["dd"])
    sharpe = ratio(F.avg("net").over(over), F.stddev_samp("net").over(over))
    value = F.greatest(F.coalesce(sharpe, F.lit(0.0)), F.lit(0.0)) * (1 + F.least(dd, F.lit(0.0)))
    return a.withColumn("score", F.when(F.col("_n") >= least, value)).drop("_h", "_n")


#: Multipliers of a book: constant, and what the probabilities of risk-on and risk-off weeks add. Fixed values.
TILTS = {"mispricing": (1.0, 0.25, -0.10), "core_rank": (1.0, 0.0, 0.35), "priced_tilt": (0.55, 0.35, 0.0)}


def regime_tilt(book: Column, p_off: Column, p_neutral: Column, p_on: Column) -> Column:
    """Multiplier of a book by the probabilities of a week's regimes, times half of one plus the largest of them."""
    confidence = 0.5 + 0.5 * F.greatest(p_off, p_neutral, p_on)
    tilt = F.lit(1.0)
    for name, (level, on, off) in TILTS.items():
        tilt = F.when(book == name, confidence * (level + on * p_on + off * p_off)).otherwise(tilt)
    return tilt


def allocate(scored: DataFrame, base: Column, by: tuple[str, ...] = ("week",), blend: float = 0.65, capped: str = "priced_tilt", cap: Column | float = 0.18) -> DataFrame:
    """(by, book, share) of rows (by, book, score, tilt): base shares until the books have scores, then a blend of base and
    raw scores (base for scores that are all zero); tilted; one book held to ``cap`` of the raw total; then divided by the
    total. Where nothing is left, base shares over their sum."""
    over = W.partitionBy(*by)
    a = scored.withColumn("_b", base).withColumn("_t", F.sum("score").over(over)).withColumn("_k", F.count("score").over(over) == F.count(F.lit(1)).over(over))
    mixed = F.when(~F.col("_k"), F.col("_b")).when(F.col("_t") > 0, (1 - blend) * F.col("_b") + blend * F.col("score")).otherwise(F.col("_b"))
    a = a.withColumn("_raw", mixed * F.col("tilt")).withColumn("_sum", F.sum("_raw").over(over))
    a = a.withColumn("_raw", F.greatest(F.when(F.col("book") == capped, F.least(F.col("_raw"), cap * F.col("_sum"))).otherwise(F.col("_raw")), F.lit(0.0)))
    total = F.sum("_raw").over(over)
    return a.select(*by, "book", F.when(total > 0, F.col("_raw") / total).otherwise(ratio(F.col("_b"), F.sum("_b").over(over))).alias("share"))


def share_of(shares: dict[str, float]) -> Column:
    """The named share of a row's book, zero for books without one."""
    return F.coalesce(F.create_map(*(x for b, s in shares.items() for x in (F.lit(b), F.lit(s))))[F.col("book")], F.lit(0.0))


def fixed_shares(weeks: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(week, book, share) of shares clipped at zero and normalised, for every week."""
    clipped = {b: max(0.0, s) for b, s in shares.items()}
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("book"), F.lit(s / sum(clipped.values())).alias("share")) for b, s in clipped.items())))
    return weeks.select("week", rows.alias("s")).select("week", "s.*")


def benchmarks(returns: DataFrame, leader) -> DataFrame:
    """Forward returns of the equal-weight market and of the leader alone."""
    a = returns.filter("fwd is not null").groupBy("week").agg(F.avg("fwd").alias("equal_weight"), F.max(F.when(F.col("symbol") == leader, F.col("fwd"))).alias("leader"))
    return a.unpivot("week", ["equal_weight", "leader"], "name", "ret").filter("ret is not null")


def capped_allocation(rows: DataFrame, by: list[str], score: str, target: str, cap: Column | float, out: str, tie: str = "symbol") -> DataFrame:
    """Adds each row's part of its group's ``target``: by score, at most ``cap``; what capped rows cannot take goes to the
    others by score, or evenly where their scores are all zero. A target that all caps together don't reach is cut to them.

    In order of score the first rows are capped, and the rest share what is left in proportion; the first row whose share
    stays under the cap ends the capped ones. So one window with sums from the end replaces repeated passes. It runs from the
    least score up, as Spark adds up a frame that ends with its group anew for each row."""
    over, cap = W.partitionBy(*by), cap if isinstance(cap, Column) else F.lit(cap)
    worst = over.orderBy("_s", F.col(tie).desc()).rowsBetween(W.unboundedPreceding, 0)
    a = rows.withColumn("_s", F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)))
    a = a.withColumns({"_n": F.count(F.lit(1)).over(over), "_k": F.row_number().over(worst), "_rest": F.sum("_s").over(worst)})
    a = a.withColumn("_before", F.col("_n") - F.col("_k"))
    left = F.greatest(F.least(F.col(target), cap * F.col("_n")) - cap * F.col("_before"), F.lit(0.0))
    part = F.when(F.col("_rest") > 0, left * F.col("_s") / F.col("_rest")).otherwise(left / (F.col("_n") - F.col("_before")))
    a = a.withColumns({"_left": left, "_part": part})
    free = F.when(F.col("_part") < cap - 1e-12, F.struct("_before", "_left", "_rest"))
    a = a.withColumn("_free", F.min(free).over(over))  # the first row that is not capped
    own = F.when(F.col("_free._rest") > 0, F.col("_free._left") * F.col("_s") / F.col("_free._rest")).otherwise(F.col("_free._left") / (F.col("_n") - F.col("_free._before")))
    value = F.when(F.col("_free").isNull() | (F.col("_before") < F.col("_free._before")), F.least(cap, F.col(target))).otherwise(own)
    return a.withColumn(out, F.when(F.col(target) > 0, value).otherwise(0.0)).drop("_s", "_n", "_k", "_before", "_rest", "_left", "_part", "_free")


@dataclass(frozen=True)
class Rules:
    """How a book's weights are built from signals; the defaults are fixed values."""

    min_names: int = 14
    long_cap: float = 0.20
    short_cap: float = 0.065
    long_power: float = 1.8
    short_power: float = 1.1
    least_vol: float = 0.05
    most_turnover: float = 0.45


#: The long leg's share of gross in each regime. Fixed values.
LONG_SHARE = {"RiskOn": 0.90, "Neutral": 0.75, "RiskOff": 0.70}
#: Books: weights of factors, fraction of names in a leg, and gross exposure in risk-on, neutral and risk-off weeks. Fixed values.
BOOKS = {
    "mispricing": ({"RMOM1w": 0.25, "RMOM2w": 0.25, "SMBC": 0.25, "NetRel": 0.25}, 0.25, (0.90, 0.72, 0.52)),
    "core_rank": ({"VolC": 0.55, "MAXRET": 0.45}, 0.25, (0.72, 0.64, 0.58)),
    "priced_tilt": ({"CRASH8": 0.20, "BETA26": 0.20, "TVLC": 0.25, "SKEW52": 0.20, "NEWC": 0.15}, 0.20, (0.55, 0.42, 0.25)),
}


def exposures(regimes: DataFrame) -> DataFrame:
    """(week, book, frac, gross, long_share) of weekly probabilities (week, p_RiskOff, p_Neutral, p_RiskOn)."""
    on, neutral, off = F.col("p_RiskOn"), F.col("p_Neutral"), F.col("p_RiskOff")
    books = F.explode(F.array(*(F.struct(F.lit(b).alias("book"), F.lit(frac).alias("frac"), (g[0] * on + g[1] * neutral + g[2] * off).alias("gross")) for b, (_, frac, g) in BOOKS.items())))
    share = LONG_SHARE["RiskOn"] * on + LONG_SHARE["Neutral"] * neutral + LONG_SHARE["RiskOff"] * off
    return regimes.select("week", share.alias("long_share"), books.alias("b")).select("week", "b.*", "long_share")


def target_weights(signals: DataFrame, exposure: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(book, week, symbol, signal, side, w) from signals (book, week, symbol, signal, vol) and ``exposures``: weights
    before any limit on turnover. Weeks with fewer than ``min_names`` signals have none.

    The last names by signal are long, the first are short, and a name in both legs is short. A leg's raw weight is the
    distance from its weakest signal, to a power, over volatility (unknown: the week's median; at least ``least_vol``)."""
    week = W.partitionBy("book", "week")
    a = signals.filter("signal is not null").withColumn("_n", F.count(F.lit(1)).over(week)).filter(F.col("_n") >= rules.min_names).join(exposure, ["book", "week"])
    a = a.withColumn("_long", F.col("gross") * F.col("long_share")).withColumn("_short", F.col("gross") * (1 - F.col("long_share")))
    a = a.withColumn("_r", F.row_number().over(week.orderBy("signal", "symbol")))
    longs, shorts = leg_count(F.col("_n"), F.col("frac"), F.col("_long"), rules.long_cap), leg_count(F.col("_n"), F.col("frac"), F.col("_short"), rules.short_cap)
    a = a.withColumn("side", F.when(F.col("_r") <= shorts, -1).when(F.col("_r") > F.col("_n") - longs, 1).otherwise(0))
    vol = F.greatest(F.coalesce("vol", F.median("vol").over(week)), F.lit(rules.least_vol))
    leg = W.partitionBy("book", "week", "side")
    above, below = F.col("signal") - F.min("signal").over(leg) + 1e-6, F.max("signal").over(leg) - F.col("signal") + 1e-6
    a = a.withColumn("_raw", F.when(F.col("side") == 1, F.pow(above, rules.long_power) / vol).when(F.col("side") == -1, F.pow(below, rules.short_power) / vol))
    long = F.col("side") == 1
    a = a.withColumn("_goal", F.when(long, F.col("_long")).when(F.col("side") == -1, F.col("_short")).otherwise(0.0))
    a = capped_allocation(a, ["book", "week", "side"], "_raw", "_goal", F.when(long, rules.long_cap).otherwise(rules.short_cap), "_w")
    return a.select("book", "week", "symbol", "signal", "side", (F.col("_w") * F.col("side")).alias("w"))


#: Names of a row that goes to the fold: few enough that a batch of rows is some tens of megabytes.
SIDE_BY_SIDE = 256


def limit_turnover(targets: DataFrame, most: float = 0.45) -> DataFrame:
    """(book, week, symbol, w) of target weights, each week moved from the last one's weights only as far as turnover stays
    within ``most``; names without a target that week are dropped.

    Weeks depend on one another, books don't. A week's names are put in order and side by side in its own group, all weeks at once;
    what a book's task sorts and reads is a row for ``SIDE_BY_SIDE`` of them. It holds one week and the weights held before, never
    the history, and meets them by position, as both are in order."""
    kind = dict(targets.dtypes)["symbol"]
    schema = f"book string, week date, part int, symbol array<{kind}>, w array<double>"
    packed, made = to_arrow_schema(StructType.fromDDL(schema)), to_arrow_schema(StructType.fromDDL(f"book string, week date, symbol {kind}, w double"))

    def pack(week: pa.Table) -> pa.Table:
        week = week.sort_by("symbol").combine_chunks()
        n = len(week)
        at = pa.array([*range(0, n, SIDE_BY_SIDE), n], pa.int32())
        arrays = [pa.ListArray.from_arrays(at, week[c].combine_chunks()) for c in ("symbol", "w")]
        rows = len(arrays[0])
        return pa.Table.from_arrays([week["book"].slice(0, 1).take(pa.array([0] * rows)), week["week"].take(pa.array([0] * rows)), pa.array(range(rows), pa.int32()), *arrays], names=packed.names).cast(packed)

    def step(names: np.ndarray, new: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        if held is not None:
            past = np.zeros(len(names))
            if len(held[0]):
                at = np.minimum(np.searchsorted(held[0], names), len(held[0]) - 1)
                past = np.where(held[0][at] == names, held[1][at], 0.0)
            gone = np.abs(held[1]).sum() - np.abs(past).sum()  # of names without a target
            moved = 0.5 * (np.abs(new - past).sum() + gone)
            if moved > most:
                new = past + most / moved * (new - past)
        return names[new != 0], new[new != 0]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weeks() -> Iterator[tuple]:
            at, parts = None, []
            for batch in batches:
                for k, key in enumerate(zip(batch["book"].to_pylist(), batch["week"].to_pylist())):
                    if key != at and parts:
                        yield at, parts
                        parts = []
                    at = key
                    parts.append((batch["symbol"][k].values, batch["w"][k].values))
            if parts:
                yield at, parts

        book, held = None, None
        for (name, week), parts in weeks():
            names, new = (pa.concat_arrays(x).to_numpy(zero_copy_only=False) for x in zip(*parts))
            held = step(names, new, held if name == book else None)
            book, n = name, len(held[0])
            yield from pa.Table.from_arrays([pa.array([name] * n, pa.string()), pa.array([week] * n, pa.date32()), pa.array(held[0], made.field("symbol").type), pa.array(held[1])], schema=made).to_batches(max_chunksize=100_000)

    rows = targets.select("book", "week", "symbol", "w").groupBy("book", "week").applyInArrow(pack, schema)
    ordered = rows.repartition("book").sortWithinPartitions("book", "week", "part")
    return ordered.mapInArrow(fold, f"book string, week date, symbol {kind}, w double")
