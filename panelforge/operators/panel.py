"""The long panel (week, symbol, measures): weekly buckets, spines, reshaping, joins, coverage and universe rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import ratio


def week_of(ts: Column | str) -> Column:
    """The Monday of a timestamp's week."""
    return F.date_trunc("week", ts).cast("date")


def by_symbol(order: str = "week") -> W:
    return W.partitionBy("symbol").orderBy(order)


def weekly_panel(lineitem: DataFrame, entity: str = "l_suppkey") -> DataFrame:
    """week, symbol, price, mcap, fees, tvl and volume of each entity's line items."""
    paid, units = F.col("l_extendedprice"), F.col("l_quantity")
    a = lineitem.groupBy(week_of("l_shipdate").alias("week"), F.col(entity).alias("symbol"))
    return a.agg(ratio(F.sum(paid), F.sum(units)).alias("price"), F.sum(paid).alias("mcap"), F.sum(paid * F.col("l_discount")).alias("fees"), F.sum(paid * F.col("l_tax")).alias("tvl"), F.sum(units).alias("volume"))


def last_in_week(rows: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of each (keys, week) by ``order``: one aggregation, no sort of a group."""
    at = F.struct(*order)
    return rows.groupBy(*keys, week_of(ts).alias("week")).agg(*(F.max_by(v, at).alias(v) for v in values))


def last_known_in_week(rows: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str]) -> DataFrame:
    """As ``last_in_week``, but each column's last value that is not null."""
    at = F.struct(*order)
    return rows.groupBy(*keys, week_of(ts).alias("week")).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))


def week_spine(panel: DataFrame) -> DataFrame:
    """Every week from each symbol's first to its last."""
    span = panel.groupBy("symbol").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    return span.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))


def on_spine(panel: DataFrame, zero: tuple[str, ...] = ()) -> DataFrame:
    """The panel with a row for each week of a symbol's span; the named measures are zero in empty weeks, others null."""
    joined = week_spine(panel).join(panel, ["symbol", "week"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero}) if zero else joined


def with_returns(panel: DataFrame, fill: str = "none") -> DataFrame:
    """Adds ret, to the previous row ("none") or, on the week spine, with prices carried over gaps ("pad"), and fwd, the next ret."""
    if fill == "pad":
        panel = on_spine(panel).withColumn("price", F.last("price", ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0)))
    panel = panel.withColumn("ret", ratio(F.col("price"), F.lag("price").over(by_symbol())) - 1)
    return panel.withColumn("fwd", F.lead("ret").over(by_symbol()))


def prefer(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """left with each column replaced by right's value where right has one."""
    r = right.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return left.join(r, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def splice(sources: list[tuple[str, DataFrame]], keys: list[str], value: str) -> DataFrame:
    """One row a key from sources in order of priority, with the name of the source it came from."""
    ranked = [s.filter(F.col(value).isNotNull()).select(*keys, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("source"), F.col(value).alias("v")).alias("s")) for k, (name, s) in enumerate(sources)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    return union.groupBy(*keys).agg(F.min_by("s", "s.rank").alias("s")).select(*keys, F.col("s.v").alias(value), F.col("s.source").alias("source"))


def best_candidate(candidates: DataFrame, keys: list[str], exact: Column, order: list[Column], value: str) -> DataFrame:
    """For each key the exact candidate, else the sole one, else none; ``order`` breaks ties between exact ones."""
    at = F.struct(*order)
    return candidates.groupBy(*keys).agg(F.min_by(value, F.when(exact, at)).alias("exact"), F.min(value).alias("any"), F.count("*").alias("n")).select(*keys, F.coalesce("exact", F.when(F.col("n") == 1, F.col("any"))).alias(value))


def first_by_priority(rows: DataFrame, keys: list[str], name: str, priority: list[str]) -> DataFrame:
    """The row of each key whose name stands first in the priority list; names beside it are dropped."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(name))
    return rows.withColumn("_p", rank).filter("_p > 0").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_p"))).filter("_r = 1").drop("_p", "_r")


def coverage(panel: DataFrame, value: str) -> DataFrame:
    """First and last week, count, span, share missing, years, staleness and longest run of consecutive weeks of each symbol."""
    seen = panel.filter(F.col(value).isNotNull()).select("symbol", "week").distinct()
    island = seen.withColumn("island", F.date_sub("week", (7 * F.row_number().over(by_symbol())).cast("int")))
    runs = island.groupBy("symbol", "island").agg(F.count("*").alias("run"), F.min("week").alias("a"), F.max("week").alias("b"))
    a = runs.groupBy("symbol").agg(F.min("a").alias("first_week"), F.max("b").alias("last_week"), F.sum("run").alias("n_weeks"), F.max("run").alias("longest_run"))
    last = seen.agg(F.max("week").alias("latest"))
    span = F.datediff("last_week", "first_week") / 7 + 1
    return a.crossJoin(F.broadcast(last)).select("symbol", "first_week", "last_week", "n_weeks", "longest_run", span.alias("span_weeks"), (1 - F.col("n_weeks") / span).alias("missing"), (F.datediff("last_week", "first_week") / 365.25).alias("years"), F.datediff("latest", "last_week").alias("days_stale"))


def backbone(cover: DataFrame, years: float = 5, weeks: int = 200) -> DataFrame:
    return cover.filter((F.col("years") >= years) & (F.col("n_weeks") >= weeks))


def chronological_split(panel: DataFrame, share: float = 0.7) -> DataFrame:
    """week, position and window (IS or OOS) of the weeks from the last first week of any symbol on; the split is at the index int(n * share)."""
    start = panel.groupBy("symbol").agg(F.min("week").alias("a")).agg(F.max("a").alias("start"))
    weeks = panel.select("week").distinct().crossJoin(F.broadcast(start)).filter("week >= start")
    numbered = weeks.withColumn("position", F.row_number().over(W.orderBy("week")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    return numbered.select("week", "position", F.when(F.col("position") < F.floor(F.col("n") * share), "IS").otherwise("OOS").alias("window"))


def eligible(panel: DataFrame, value: str, least: int = 12) -> DataFrame:
    """Adds how many values a symbol has had up to each week and whether they are enough."""
    n = F.count(value).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))
    return panel.withColumn("n_seen", n).withColumn("eligible", n >= least)


def fill_past_then_mean(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``filled``: the last known value, and before the first one the mean of all."""
    past = F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("filled", F.coalesce(past, F.avg(value).over(W.partitionBy(*keys))))


def to_wide(long: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    """A column for each of the names, which are given, so that no pass over the data looks for them."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))


def to_long(wide: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], name, value)


def symmetric_turnover(members: DataFrame) -> DataFrame:
    """Share of names that changed against the previous week: half the symmetric difference over the previous size.

    members (week, symbol); weeks without members are not weeks. Names meet by a join on symbol and adjacent weeks."""
    sizes = members.groupBy("week").agg(F.count("*").alias("n")).withColumn("prev", F.lag("week").over(W.orderBy("week"))).withColumn("n_prev", F.lag("n").over(W.orderBy("week")))
    sizes = sizes.filter("prev is not null")
    before = members.select(F.col("week").alias("prev"), "symbol")
    stay = members.join(sizes.select("week", "prev"), "week").join(before, ["prev", "symbol"]).groupBy("week").agg(F.count("*").alias("stay"))
    return sizes.join(stay, "week", "left").select("week", ((F.col("n") + F.col("n_prev") - 2 * F.coalesce("stay", F.lit(0))) / (2 * F.col("n_prev"))).alias("turnover"))


def excluded(rows: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is not in the exclusion set, and those whose key is."""
    return rows.join(names.select(key), key, "left_anti"), rows.join(names.select(key), key, "left_semi")


def mapping_status(candidate: Column, exact: Column) -> Column:
    """How a name was found: by exact match, by a sole candidate, or not at all."""
    return F.when(candidate.isNull(), "unmapped").when(exact, "mapped_exact_name").otherwise("mapped_single_candidate")


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the names that are columns of df, in their order."""
    return [n for n in names if n in df.columns]


def last_by_slug_then_sum(observed: DataFrame, slugs: DataFrame, ts: str, order: list[str], value: str) -> DataFrame:
    """(symbol, week, value): symbols and slugs match many to many; of each symbol, slug and week the last value, then
    their sum, null where none is known."""
    last = last_in_week(observed.join(slugs, "slug"), ["symbol", "slug"], ts, order, [value])
    return last.groupBy("symbol", "week").agg(F.sum(value).alias(value))


def chain_totals(rows: DataFrame, values: list[str], day: str = "day") -> DataFrame:
    """(week, values): each week's last day of the rows of chain ALL, or where there is no such row at all, of sums over chains."""
    whole = F.upper("chain") == "ALL"
    by_day = rows.groupBy(day).agg(*(F.sum(F.when(whole, F.col(v))).alias(f"_a_{v}") for v in values), *(F.sum(v).alias(v) for v in values), F.count_if(whole).alias("_n"))
    there = rows.agg(F.coalesce(F.bool_or(whole), F.lit(False)).alias("_any"))  # one row
    a = by_day.crossJoin(F.broadcast(there)).filter("not _any or _n > 0").withColumns({v: F.when(F.col("_any"), F.col(f"_a_{v}")).otherwise(F.col(v)) for v in values})
    return a.groupBy(week_of(day).alias("week")).agg(*(F.max_by(v, day).alias(v) for v in values))


def cascade(assets: DataFrame, skip: DataFrame, overrides: DataFrame, protocols: DataFrame, allowed: list[str]) -> DataFrame:
    """(symbol, slug, source) of assets (symbol, gecko_id) by the first rule that applies: symbols to skip; a slug set by
    hand (null: none); of the protocols with the asset's gecko_id and an allowed category that of the largest tvl; none."""
    fits = F.lower("category").isin(*allowed)
    best = protocols.filter("gecko_id is not null").groupBy("gecko_id").agg(F.max_by("slug", F.when(fits, F.struct(F.coalesce("tvl", F.lit(0.0)).alias("t"), F.col("slug")))).alias("_best"), F.count_if(fits).alias("_fit"))
    a = assets.join(skip.select("symbol", F.lit(True).alias("_skip")).distinct(), "symbol", "left")
    a = a.join(overrides.select("symbol", F.col("slug").alias("_own"), F.lit(True).alias("_set")), "symbol", "left").join(best, "gecko_id", "left")
    source = (
        F.when(F.col("_skip"), "skipped").when(F.col("_set") & F.col("_own").isNull(), "override_skip").when(F.col("_set"), "override")
        .when(F.col("_fit").isNull(), "unmapped").when(F.col("_fit") == 0, "fallback_filtered_out").when(F.col("_best").isNull(), "unmapped").otherwise("gecko_id_fallback")
    )
    slug = F.when(F.col("source") == "override", F.col("_own")).when(F.col("source") == "gecko_id_fallback", F.col("_best"))
    return a.withColumn("source", source).select("symbol", slug.alias("slug"), "source")


def closed_windows(split: DataFrame) -> DataFrame:
    """(window, lo, hi): first and last week of the windows of ``chronological_split``, and of both as Full."""
    both = split.select("week", "window").unionByName(split.select("week", F.lit("Full").alias("window")))
    return both.groupBy("window").agg(F.min("week").alias("lo"), F.max("week").alias("hi"))


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows once for each window whose closed interval holds their week; three windows at most."""
    return rows.join(F.broadcast(windows), F.col("week").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
