"""What the registered queries share: the weekly panel of line items in Spark and in SQL, and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import factors, panel
from panelforge.sources import table

#: CTEs over the driver's tables: p (panel), r (returns), f (forward returns).
PANEL = """p AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_suppkey AS symbol, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) AS mcap,
         sum(l_extendedprice * l_discount) AS fees, sum(l_extendedprice * l_tax) AS tvl, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY week) - 1 AS ret FROM p),
f AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY week) AS fwd FROM r)"""


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return panel.weekly_panel(table(spark, d, "lineitem"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_returns(weekly(spark, d))


def sorted_panel(spark: SparkSession, d: str) -> DataFrame:
    return factors.characteristics(returns(spark, d))


def rd(x: Column | str, places: int) -> Column:
    """x rounded; a small addition keeps exact halves on one side in either engine."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-8, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(rd(c, places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def r6(*columns: str, places: int = 6) -> str:
    """SQL for rounded columns."""
    return ", ".join(f"round({c} + 1e-8, {places}) AS {c}" for c in columns)


def ols_sql(source: str, by: str, y: str, xs: list[str], name: str) -> str:
    """CTEs for least squares with an intercept by group over the rows of ``source``, which are known in y and xs: each
    regressor in turn takes out of the later ones and of y what it explains. ``name`` has by, n, intercept, beta1, beta2, ...,
    r2. A flat regressor has the slope zero."""
    k, over = len(xs), f"OVER (PARTITION BY {by})"
    share = lambda a, e: f"coalesce(sum({a} * {e}) {over} / nullif(CASE WHEN sum({e} * {e}) {over} > 1e-18 THEN sum({e} * {e}) {over} END, 0), 0)"
    means = ", ".join([f"avg({y}) {over} AS my", *(f"avg({x}) {over} AS m{j}" for j, x in enumerate(xs, 1))])
    parts = [f"{name}_0 AS (SELECT *, {y} - my AS y_, {', '.join(f'{x} - m{j} AS e{j}' for j, x in enumerate(xs, 1))} FROM (SELECT {by}, {y}, {', '.join(xs)}, {means} FROM {source}))", f"{name}_y0 AS (SELECT *, y_ AS y0 FROM {name}_0)"]
    last = f"{name}_y0"
    for j in range(1, k + 1):
        shares = ", ".join([f"{share('y_', f'e{j}')} AS c{j}", *(f"{share(f'e{l}', f'e{j}')} AS b{l}_{j}" for l in range(j + 1, k + 1))])
        rest = ", ".join([f"y_ - c{j} * e{j} AS y_", *(f"e{l} - b{l}_{j} * e{j} AS e{l}" for l in range(j + 1, k + 1))])
        parts.append(f"{name}_{j} AS (SELECT * REPLACE ({rest}) FROM (SELECT *, {shares} FROM {last}))")
        last = f"{name}_{j}"
    columns = ", ".join([*(f"any_value(c{j}) AS c{j}" for j in range(1, k + 1)), *(f"any_value(b{l}_{j}) AS b{l}_{j}" for j in range(1, k + 1) for l in range(j + 1, k + 1)), "any_value(my) AS my", *(f"any_value(m{j}) AS m{j}" for j in range(1, k + 1))])
    parts.append(f"{name}_k AS (SELECT {by}, count(*) AS n, 1 - sum(y_ * y_) / nullif(sum(y0 * y0), 0) AS r2, {columns} FROM {last} GROUP BY {by})")
    last = f"{name}_k"
    for j in range(k, 0, -1):
        parts.append(f"{name}_b{j} AS (SELECT *, c{j}{''.join(f' - b{l}_{j} * beta{l}' for l in range(j + 1, k + 1))} AS beta{j} FROM {last})")
        last = f"{name}_b{j}"
    return ", ".join([*parts, f"{name} AS (SELECT {by}, n, my{''.join(f' - beta{j} * m{j}' for j in range(1, k + 1))} AS intercept, {', '.join(f'beta{j}' for j in range(1, k + 1))}, r2 FROM {last})"])
