"""Flattening of nested provider payloads into rows, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import number, truthy

TEXTS = "map<string,string>"
DATES, VALUES, DIMENSIONS = ("date", "timestamp", "time"), ("val", "value"), ("dimension", "chain", "category", "protocol", "version")


def _listed(text: Column) -> Column:
    """The items of a JSON list as texts, null for other values."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _named(text: Column) -> Column:
    """The entries of a JSON object as texts, null for other values."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, TEXTS))


def _first(entries: Column, names: tuple[str, ...]) -> Column:
    """The first of the named entries that is not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(entries, F.lit(n)), F.lit("")) for n in names))


def metric_series(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """(symbol, metric, date, dimension, value) of payloads {data: {dates, symbols: {SYMBOL: {metric: series}}}}, or of lists of
    them; data may be left out. A series is a list along the dates, an object of such lists by dimension, or one value,
    which has no date. Items past the dates' end may bring their own date, and items may be objects that hold the value."""
    one = payloads.select(F.explode(F.coalesce(_listed(F.col(text)), F.array(text))).alias("_t")).select(_named(F.col("_t")).alias("_p"))
    pick = lambda m, n: F.try_element_at(m, F.lit(n))
    one = one.withColumn("_d", F.coalesce(_named(pick(F.col("_p"), "data")), F.col("_p")))
    dates = F.coalesce(_listed(pick(F.col("_d"), "dates")), _listed(pick(F.col("_d"), "timestamps")), _listed(pick(F.col("_p"), "dates")))
    symbols = F.coalesce(_named(pick(F.col("_d"), "symbols")), _named(pick(F.col("_p"), "symbols")))
    a = one.select(dates.alias("dates"), F.explode(symbols).alias("symbol", "_m")).select("dates", "symbol", F.explode(_named(F.col("_m"))).alias("metric", "raw"))
    part = lambda dimension, raw: F.struct(dimension.cast("string").alias("dimension"), raw.alias("raw"))
    parts = F.when(F.ltrim("raw").startswith("{"), F.transform(F.map_entries(_named(F.col("raw"))), lambda e: part(e["key"], e["value"]))).otherwise(F.array(part(F.lit(None), F.col("raw"))))
    a = a.select("dates", "symbol", "metric", F.explode(parts).alias("p")).select("dates", "symbol", "metric", "p.*")
    a = a.withColumn("along", F.coalesce(F.ltrim("raw").startswith("["), F.lit(False)))
    a = a.select("dates", "symbol", "metric", "dimension", "along", F.posexplode(F.coalesce(_listed(F.col("raw")), F.array("raw"))).alias("k", "item"))
    own = F.when(F.col("along"), _named(F.col("item")))
    date = F.when(F.col("along"), F.coalesce(F.get("dates", F.col("k")), _first(own, DATES)))
    held = [F.when(F.map_contains_key(own, F.lit(n)), F.struct(pick(own, n).alias("v"))) for n in VALUES]  # an entry may hold null
    value = F.coalesce(*held, F.struct(F.col("item").alias("v")))["v"]
    return a.select(F.upper("symbol").alias("symbol"), "metric", F.substring(date, 1, 10).alias("date"), F.coalesce("dimension", _first(own, DIMENSIONS)).alias("dimension"), number(value).alias("value"))


def merged_ticks(charts: DataFrame) -> DataFrame:
    """(symbol, ts, price, mcap, volume) of three parallel lists of [ts, value]."""
    parts = None
    for name, column in (("price", "prices"), ("mcap", "market_caps"), ("volume", "total_volumes")):
        one = charts.select("symbol", F.explode(column).alias("x")).select("symbol", F.timestamp_millis(F.col("x")[0].cast("long")).alias("ts"), F.lit(name).alias("name"), F.col("x")[1].alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("symbol", "ts").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("price", "mcap", "volume")))


def klines(rows: DataFrame, column: str = "k") -> DataFrame:
    """Open time and prices of positional bars; bars with fewer than nine fields are dropped."""
    k = F.col(column)
    a = rows.filter(F.size(k) >= 9)
    return a.select("symbol", F.timestamp_millis(k[0].cast("long")).alias("open_time"), *(number(k[i]).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (5, "volume"))))


def tvl_value(total: Column, tvl: Column) -> Column:
    """The total, or the other field where it is missing or zero."""
    return truthy(total, tvl)


def stable_point(date: Column, supply: Column) -> tuple[Column, Column]:
    """(day, supply) of a stablecoin point: the date as an ISO or Unix text, the supply as the sum of a map's values."""
    unix = number(date)
    day = F.when(unix.isNotNull(), F.timestamp_seconds(unix.cast("long")).cast("date")).otherwise(F.try_to_timestamp(date).cast("date"))
    return day, F.aggregate(F.map_values(supply), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def match_by_slug_or_name(left: DataFrame, protocols: DataFrame, order: str) -> DataFrame:
    """Rows of left (slug, name) that a protocol (slug, name) matches, with ``matched``: the row's own slug if it is one of
    them whatever its case, else the slug of the last protocol by ``order`` with the same name, case and outer blanks ignored."""
    slug = protocols.filter("slug is not null").select(F.lower("slug").alias("_slug"), F.lit(True).alias("_known")).distinct()
    name = protocols.filter("slug is not null and name is not null").groupBy(F.trim(F.lower("name")).alias("_name")).agg(F.max_by("slug", order).alias("_by_name"))
    a = left.withColumns({"_slug": F.lower("slug"), "_name": F.trim(F.lower("name"))}).join(slug, "_slug", "left").join(name, "_name", "left")
    return a.withColumn("matched", F.when(F.col("_known"), F.col("slug")).otherwise(F.col("_by_name"))).filter("matched is not null").drop("_slug", "_name", "_known", "_by_name")


def unlock_share(row: dict[str, Column]) -> Column:
    """Amount unlocked over the largest supply, the amount under the first of its names that is known."""
    return F.try_divide(F.coalesce(*(row[n] for n in ("amount", "tokens", "value") if n in row)), row["max_supply"])
