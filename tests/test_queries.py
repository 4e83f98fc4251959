"""Queries against their SQL in DuckDB over the smallest tables."""

import datetime as dt
import glob
import math

import duckdb
import pytest

from panelforge.plans import ORACLE_SQL, QUERIES

#: On the smallest tables no week has enough names for these; they are held to SQL at a larger scale.
NAMES = sorted(set(ORACLE_SQL) - {"histogram", "acf"})


def canonical(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool):
            return x
        if hasattr(x, "isoformat"):
            return str(x)[:10]
        return float(f"{float(x):.9g}") if not isinstance(x, str) else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


def test_a_factor_without_drawdown_divides_as_sql(spark, duck, sf, monkeypatch):
    """Returns that are never negative: the ratio to the drawdown is that of the query's SQL, minus infinity."""
    from panelforge.plans import factor_queries

    series = spark.createDataFrame([(f, dt.date(2024, 1, 1) + dt.timedelta(7 * k), s * (1.0 + k % 3), 10) for f, s in (("UP", 0.1), ("FLAT", 0.0)) for k in range(8)], "factor string, week date, ret double, n long")
    monkeypatch.setattr(factor_queries, "zoo_of", lambda *_: series)
    got = {r.factor: r.calmar for r in factor_queries.perf_metrics(spark, sf).collect()}
    assert got == {"UP": -math.inf, "FLAT": None}  # and zero by zero is no number


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert canonical(got.select(*columns).collect()) == canonical(want)
