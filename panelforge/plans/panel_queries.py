"""Queries of the panel, its reshaping, joins, coverage and rolling measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import evidence_tier, ratio
from panelforge.operators import factors, panel, rolling, xsec
from panelforge.session import materialize
from panelforge.sources import table

from .common import PANEL, r6, rd, returns, rounded, sorted_panel, weekly

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {PANEL} SELECT week, symbol, {r6('price', 'mcap', 'fees', 'tvl', places=4)} FROM p")
def weekly_panel(spark, d):
    return rounded(weekly(spark, d).select("week", "symbol", "price", "mcap", "fees", "tvl"), 4)


@query("""
SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
FROM orders GROUP BY 1, 2""")
def weekly_last(spark, d):
    a = panel.last_in_week(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_orderstatus"])
    return a.select("o_custkey", "week", F.col("o_totalprice").alias("last_price"), F.col("o_orderstatus").alias("last_status"))


@query("""
WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, arg_max(v, (o_orderdate, o_orderkey)) FILTER (v IS NOT NULL) AS last_known FROM o GROUP BY 1, 2""")
def weekly_last_known(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")))
    return panel.last_known_in_week(o, ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey"], ["v"]).select("o_custkey", "week", F.col("v").alias("last_known"))


@query(f"""
WITH {PANEL}, s AS (SELECT symbol, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM p GROUP BY symbol)
SELECT s.symbol, s.week, round(coalesce(mcap, 0) + 1e-8, 4) AS mcap, round(price + 1e-8, 4) AS price FROM s LEFT JOIN p USING (symbol, week)""")
def weekly_resample_spine(spark, d):
    return rounded(panel.on_spine(weekly(spark, d).select("symbol", "week", "mcap", "price"), ("mcap",)), 4)


@query(f"""
WITH {PANEL}, s AS (SELECT symbol, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM p GROUP BY symbol),
q AS (SELECT s.symbol, s.week, last_value(price IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.week ROWS UNBOUNDED PRECEDING) AS price FROM s LEFT JOIN p USING (symbol, week)),
t AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY week) - 1 AS ret FROM q)
SELECT symbol, week, round(ret + 1e-8, 6) AS ret, round(lead(ret) OVER (PARTITION BY symbol ORDER BY week) + 1e-8, 6) AS fwd FROM t""")
def returns_pad(spark, d):
    return rounded(panel.with_returns(weekly(spark, d).select("week", "symbol", "price"), "pad").select("symbol", "week", "ret", "fwd"))


@query(f"""
WITH {PANEL} SELECT week, symbol, round(ret + 1e-8, 6) AS ret, round(ln(price / lag(price) OVER w) + 1e-8, 6) AS log_ret, round(price / lag(price, 4) OVER w - 1 + 1e-8, 6) AS ret4, round(fwd + 1e-8, 6) AS fwd, round(price - lag(price) OVER w + 1e-8, 4) AS diff
FROM f WINDOW w AS (PARTITION BY symbol ORDER BY week)""")
def returns_row(spark, d):
    w = panel.by_symbol()
    a = returns(spark, d)
    return a.select("week", "symbol", rd("ret", 6).alias("ret"), rd(F.log(F.col("price") / F.lag("price").over(w)), 6).alias("log_ret"), rd(ratio(F.col("price"), F.lag("price", 4).over(w)) - 1, 6).alias("ret4"), rd("fwd", 6).alias("fwd"), rd(F.col("price") - F.lag("price").over(w), 4).alias("diff"))


def _g(expr: str, n: int, least: int, skip: int = 0, x: str = "ret") -> str:
    over = f"(PARTITION BY symbol ORDER BY week ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) OVER {over} >= {least} THEN {expr} OVER {over} END"


@query(f"""
WITH {PANEL} SELECT week, symbol, round({_g('sum(ln(1 + ret))', 4, 3, 1)} + 1e-8, 6) AS mom4, round({_g('sum(ln(1 + ret))', 12, 8, 1)} + 1e-8, 6) AS mom12,
  round(exp({_g('sum(ln(1 + ret))', 2, 2)}) - 1 + 1e-8, 6) AS mom2c, round({_g('avg(ret)', 4, 4)} / nullif({_g('stddev_samp(ret)', 4, 4)}, 0) + 1e-8, 4) AS sharpe4, round(ret / nullif({_g('stddev_samp(ret)', 4, 4)}, 0) + 1e-8, 4) AS rmom
FROM r""")
def momentum(spark, d):
    a = sorted_panel(spark, d)
    return a.select("week", "symbol", rd("mom4", 6).alias("mom4"), rd("mom12", 6).alias("mom12"), rd("mom2c", 6).alias("mom2c"), rd(ratio(rolling.mean(F.col("ret"), 4), F.col("vol4")), 4).alias("sharpe4"), rd(ratio(F.col("ret"), F.col("vol4")), 4).alias("rmom"))


@query(f"""
WITH {PANEL} SELECT week, symbol, round({_g('stddev_samp(ret)', 4, 4)} + 1e-8, 6) AS vol4, round({_g('max(ret)', 4, 4)} + 1e-8, 6) AS max4, round({_g('min(ret)', 8, 6)} + 1e-8, 6) AS min8, round({_g('avg(abs(ret))', 4, 4)} + 1e-8, 6) AS absmean4,
  round({_g('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 8, 8, x='*')} + 1e-8, 6) AS up8, round(price / {_g('max(price)', 8, 8, x='price')} - 1 + 1e-8, 6) AS to_high8, round(price / {_g('min(price)', 8, 8, x='price')} - 1 + 1e-8, 6) AS to_low8,
  round(mcap / lag(mcap, 4) OVER (PARTITION BY symbol ORDER BY week) - 1 + 1e-8, 6) AS mcap_change4, CAST(row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS INT) AS age,
  round({_g('stddev_samp(CASE WHEN ret > 0 THEN ret END)', 8, 4, x='CASE WHEN ret > 0 THEN ret END')} + 1e-8, 6) AS upvol8
FROM r""")
def rolling_measures(spark, d):
    a = sorted_panel(spark, d).withColumn("upvol8", rolling.sd(F.when(F.col("ret") > 0, F.col("ret")), 8, 4))
    return rounded(a.select("week", "symbol", "vol4", "max4", "min8", "absmean4", "up8", "to_high8", "to_low8", "mcap_change4", "age", "upvol8"))


@query(f"WITH {PANEL} SELECT week, symbol, round({_g('skewness(ret)', 52, 26)} + 1e-8, 4) AS skew52 FROM r")
def rolling_skew_adj(spark, d):
    return rounded(returns(spark, d).select("week", "symbol", rolling.skew_adjusted(F.col("ret"), 52, 26).alias("skew52")), 4)


_B = "(PARTITION BY symbol ORDER BY week ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)"
_P = "(PARTITION BY symbol ORDER BY week ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)"


@query(f"""
WITH {PANEL}, e AS (SELECT week, avg(ret) AS ew FROM r GROUP BY week),
v AS (SELECT week, CASE WHEN sum(w) > 0 THEN sum(w * ret) / sum(w) END AS vw FROM (SELECT week, ret, lag(mcap) OVER (PARTITION BY symbol ORDER BY week) AS w FROM r) WHERE w IS NOT NULL AND ret IS NOT NULL GROUP BY week),
m AS (SELECT r.*, ew, CASE WHEN ret IS NOT NULL THEN vw END AS vw, CASE WHEN vw IS NOT NULL THEN ret END AS rv, CASE WHEN ret IS NOT NULL THEN ew END AS e1 FROM r LEFT JOIN e USING (week) LEFT JOIN v USING (week))
SELECT week, symbol, round(CASE WHEN count(ret) OVER {_B} >= 13 THEN covar_samp(ret, e1) OVER {_B} / nullif(var_samp(e1) OVER {_B}, 0) END + 1e-8, 4) AS beta_ew,
  round(CASE WHEN count(rv) OVER {_P} >= 13 THEN covar_samp(rv, vw) OVER {_P} / nullif(var_samp(vw) OVER {_P}, 0) END + 1e-8, 4) AS beta_prior,
  round(CASE WHEN count(ret * ew) OVER {_B} >= 26 THEN corr(ret, ew) OVER {_B} END + 1e-8, 4) AS corr_ew
FROM m""")
def rolling_beta(spark, d):
    a = returns(spark, d)
    a = a.join(factors.equal_weight_market(a).withColumnRenamed("market", "ew"), "week", "left").join(factors.cap_weight_market(a).withColumnRenamed("market", "vw"), "week", "left")
    r = F.col("ret")
    return rounded(a.select("week", "symbol", rolling.beta(r, F.col("ew"), 26, 13).alias("beta_ew"), rolling.beta(r, F.col("vw"), 26, 13, skip=1).alias("beta_prior"), rolling.correlation(r, F.col("ew"), 26).alias("corr_ew")), 4)


@query(f"""
WITH {PANEL}, m AS (SELECT week, avg(ret) AS x FROM r GROUP BY week),
z AS (SELECT week, CASE WHEN count(x) OVER w >= 8 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z FROM m WINDOW w AS (ORDER BY week ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
SELECT week, round(z + 1e-8, 4) AS z, round(lag(z) OVER (ORDER BY week) + 1e-8, 4) AS z_lagged FROM z""")
def ts_zscore_lagged(spark, d):
    m = factors.equal_weight_market(returns(spark, d))
    z = lambda lag: rolling.zscore_lagged(F.col("market"), 26, 8, lag=lag)
    return rounded(m.select("week", z(0).alias("z"), z(1).alias("z_lagged")), 4)


@query(f"""
WITH {PANEL} SELECT week, symbol, round(CASE WHEN coalesce(stddev_samp(ret) OVER w, 0) <= 0 THEN ret * 0 ELSE (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w END + 1e-8, 5) AS z_zero,
  round((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) + 1e-8, 5) AS z_null FROM r WINDOW w AS (PARTITION BY week)""")
def xs_zscore(spark, d):
    a = xsec.zscores(returns(spark, d).select("week", "symbol", "ret"), {"z_zero": ("ret", True), "z_null": ("ret", False)})
    return rounded(a.drop("ret"), 5)


@query(f"""
WITH {PANEL}, q AS (SELECT week, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi, quantile_cont(price, 0.5) AS mid FROM r GROUP BY week),
g AS (SELECT quantile_cont(mcap, 0.99) AS top FROM r)
SELECT week, symbol, CASE WHEN ret IS NOT NULL THEN round(greatest(least(ret, hi), lo) + 1e-8, 6) END AS clipped, round(price / mid + 1e-8, 5) AS to_median, round(least(mcap, top) + 1e-8, 3) AS capped FROM r JOIN q USING (week), g""")
def winsorize(spark, d):
    rows = materialize(returns(spark, d).select("week", "symbol", "ret", "price", "mcap"), "returns")
    a = xsec.winsorize(rows, "ret", "clipped")
    a = xsec.clip_above(xsec.median_scaled(a, "price", "to_median"), "mcap", "capped")
    return a.select("week", "symbol", rd("clipped", 6).alias("clipped"), rd("to_median", 5).alias("to_median"), rd("capped", 3).alias("capped"))


@query(f"""
WITH {PANEL}, x AS (SELECT week, symbol, floor(tvl / 500) AS v FROM p)
SELECT week, symbol, rank() OVER (PARTITION BY week ORDER BY v) + (count(*) OVER (PARTITION BY week, v) - 1) / 2.0 AS avg_rank,
  round((rank() OVER (PARTITION BY week ORDER BY v) + (count(*) OVER (PARTITION BY week, v) - 1) / 2.0) / count(*) OVER (PARTITION BY week) + 1e-8, 6) AS pct_rank,
  CAST(row_number() OVER (PARTITION BY week ORDER BY v, symbol) AS INT) AS first_rank FROM x""")
def ranks(spark, d):
    from pyspark.sql import Window as W

    a = weekly(spark, d).select("week", "symbol", F.floor(F.col("tvl") / 500).alias("v"))
    return a.select("week", "symbol", xsec.average_rank(F.col("v")).alias("avg_rank"), rd(xsec.percent_rank(F.col("v")), 6).alias("pct_rank"), F.row_number().over(W.partitionBy("week").orderBy("v", "symbol")).alias("first_rank"))


@query(f"""
WITH {PANEL}, e AS (SELECT week, list_distinct(list_sort(quantile_cont(mcap, [0.0, 0.3, 0.7, 1.0]))) AS u FROM p GROUP BY week),
s AS (SELECT week, list_sort(u) AS e FROM e)
SELECT week, symbol, CASE WHEN len(e) > 1 THEN CAST(greatest(len(list_filter(e, lambda v: v < mcap)) - 1, 0) AS INT) END AS bin FROM p JOIN s USING (week)""")
def qcut_bins(spark, d):
    return xsec.quantile_bins(weekly(spark, d).select("week", "symbol", "mcap"), "mcap", "bin", [0.0, 0.3, 0.7, 1.0]).drop("mcap")


@query(f"""
WITH {PANEL}, i AS (SELECT symbol, week, week - CAST(7 * row_number() OVER (PARTITION BY symbol ORDER BY week) AS INT) AS g FROM p),
k AS (SELECT symbol, g, count(*) AS run, min(week) AS a, max(week) AS b FROM i GROUP BY 1, 2),
c AS (SELECT symbol, min(a) AS first_week, max(b) AS last_week, CAST(sum(run) AS BIGINT) AS n_weeks, max(run) AS longest_run FROM k GROUP BY 1)
SELECT symbol, first_week, last_week, n_weeks, longest_run, (last_week - first_week) / 7 + 1.0 AS span_weeks, round(1 - n_weeks / ((last_week - first_week) / 7 + 1) + 1e-8, 6) AS missing,
  round((last_week - first_week) / 365.25 + 1e-8, 6) AS years, CAST((SELECT max(week) FROM p) - last_week AS INT) AS days_stale FROM c""")
def coverage_report(spark, d):
    return rounded(panel.coverage(weekly(spark, d), "price"))


@query(f"""
WITH {PANEL}, s AS (SELECT max(a) AS start FROM (SELECT min(week) AS a FROM p GROUP BY symbol)), w AS (SELECT DISTINCT week FROM p, s WHERE week >= start)
SELECT week, CAST(row_number() OVER (ORDER BY week) - 1 AS INT) AS position, CASE WHEN row_number() OVER (ORDER BY week) - 1 < floor((SELECT count(*) FROM w) * 0.7) THEN 'IS' ELSE 'OOS' END AS "window" FROM w""")
def common_start_split(spark, d):
    return panel.chronological_split(weekly(spark, d))


@query(f"WITH {PANEL} SELECT week, symbol, count(ret) OVER w AS n_seen, count(ret) OVER w >= 12 AS eligible FROM r WINDOW w AS (PARTITION BY symbol ORDER BY week ROWS UNBOUNDED PRECEDING)")
def eligibility_pit(spark, d):
    return panel.eligible(returns(spark, d), "ret").select("week", "symbol", "n_seen", "eligible")


@query("""
WITH e AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY ALL),
u AS (SELECT symbol, day, v, 0 AS k, 'purchase' AS source FROM e WHERE event_type = 'purchase' AND v IS NOT NULL UNION ALL SELECT symbol, day, v, 1, 'click' FROM e WHERE event_type = 'click' AND v IS NOT NULL UNION ALL SELECT symbol, day, v, 2, 'view' FROM e WHERE event_type = 'view' AND v IS NOT NULL)
SELECT symbol, day, arg_min(v, k) AS v, arg_min(source, k) AS source FROM u GROUP BY 1, 2""")
def source_splice(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("v"))
    return panel.splice([(t, e.filter(F.col("event_type") == t)) for t in ("purchase", "click", "view")], ["symbol", "day"], "v")


@query("""
SELECT p_brand, CASE WHEN count(*) FILTER (p_type LIKE '%STEEL%') > 0 THEN arg_min(p_name, (p_retailprice, p_partkey)) FILTER (p_type LIKE '%STEEL%') WHEN count(*) = 1 THEN min(p_name) END AS p_name FROM part GROUP BY 1""")
def priority_candidate(spark, d):
    return panel.best_candidate(table(spark, d, "part"), ["p_brand"], F.col("p_type").like("%STEEL%"), [F.col("p_retailprice"), F.col("p_partkey")], "p_name")


@query("""
SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS r FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'], o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k > 0) WHERE r = 1""")
def priority_join(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return panel.first_by_priority(a, ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query(f"""
WITH {PANEL} SELECT week, symbol, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY week ROWS UNBOUNDED PRECEDING), avg(x) OVER (PARTITION BY symbol)) + 1e-8, 4) AS filled
FROM (SELECT *, CASE WHEN tvl > 900 THEN tvl END AS x FROM p)""")
def ffill_then_mean(spark, d):
    a = weekly(spark, d).select("week", "symbol", F.when(F.col("tvl") > 900, F.col("tvl")).alias("x"))
    return rounded(panel.fill_past_then_mean(a, ["symbol"], "week", "x").drop("x"), 4)


@query(f"""
WITH {PANEL}, l AS (SELECT week, CAST(symbol AS VARCHAR) AS symbol, unnest(['price', 'mcap', 'fees', 'tvl']) AS measure, unnest([price, mcap, fees, tvl]) AS v FROM p)
SELECT week, symbol, measure, round(v + 1e-8, 4) AS v FROM l WHERE measure <> 'mcap'""")
def unpivot_pivot(spark, d):
    """All measures in long form, pivoted by measure, one dropped, and unpivoted again."""
    p = weekly(spark, d).withColumn("symbol", F.col("symbol").cast("string"))
    long = panel.to_long(p.select("week", "symbol", "price", "mcap", "fees", "tvl"), ["week", "symbol"], "measure", "v")
    wide = panel.to_wide(long, ["week", "symbol"], "measure", "v", ["price", "mcap", "fees", "tvl"]).drop("mcap")
    return rounded(panel.to_long(wide, ["week", "symbol"], "measure", "v"), 4)


@query(f"""
WITH {PANEL}, a AS (SELECT week, symbol, price AS v FROM p WHERE volume > 50), b AS (SELECT week, symbol, price * 2 AS v FROM p WHERE fees > 1500)
SELECT p.week, p.symbol, round(coalesce(b.v, a.v) + 1e-8, 4) AS v,
  CASE WHEN a.v IS NOT NULL THEN '1_real_mcap' WHEN b.v IS NOT NULL THEN '2_price_x_realsupply' WHEN tvl > 900 THEN '3_price_x_anchor' ELSE 'none' END AS tier
FROM p LEFT JOIN a USING (week, symbol) LEFT JOIN b USING (week, symbol)""")
def prefer_and_tier(spark, d):
    """A source for weeks of large volume, one for weeks of high fees that is preferred, and how each week's value is known."""
    p = weekly(spark, d).select("week", "symbol", "price", "volume", "fees", "tvl")
    a = p.filter("volume > 50").select("week", "symbol", F.col("price").alias("v"))
    b = p.filter("fees > 1500").select("week", "symbol", (F.col("price") * 2).alias("v"))
    base = p.join(a, ["week", "symbol"], "left").withColumn("own", F.col("v"))
    got = panel.prefer(base, b, ["week", "symbol"], ["v"])
    return got.select("week", "symbol", rd("v", 4).alias("v"), evidence_tier(F.col("own"), F.when(F.col("fees") > 1500, 1), F.when(F.col("tvl") > 900, 1), F.col("price")).alias("tier"))


@query(f"""
WITH {PANEL}, m AS (SELECT DISTINCT week, symbol FROM f WHERE mcap > 20000), n AS (SELECT week, count(*) AS n FROM m GROUP BY 1),
q AS (SELECT week, n, lag(week) OVER (ORDER BY week) AS prev, lag(n) OVER (ORDER BY week) AS np FROM n),
s AS (SELECT m.week, count(*) AS stay FROM m JOIN q USING (week) JOIN m AS b ON b.week = q.prev AND b.symbol = m.symbol GROUP BY 1)
SELECT week, round((n + np - 2 * coalesce(stay, 0)) / (2.0 * np) + 1e-8, 6) AS turnover FROM q LEFT JOIN s USING (week) WHERE prev IS NOT NULL""")
def membership_turnover(spark, d):
    return rounded(panel.symmetric_turnover(weekly(spark, d).filter("mcap > 20000").select("week", "symbol")))


@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, sha256(props) AS digest FROM events""")
def json_props_flatten(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.sha2("props", 256).alias("digest"))


@query("""
WITH c AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, sum(value) AS v, count(DISTINCT user_id) AS users, count(*) FILTER (value > 0) AS positive FROM events GROUP BY 1, 2)
SELECT week, event_type, round(v + 1e-8, 4) AS v, users, positive FROM c""")
def weekly_activity(spark, d):
    a = table(spark, d, "events").groupBy(panel.week_of("ts").alias("week"), "event_type").agg(F.sum("value").alias("v"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 0).alias("positive"))
    return rounded(a, 4)
