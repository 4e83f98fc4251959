"""Queries of evidence on factors: windows in and out of sample, dominance, grades, and the datasets behind dashboards, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.operators import canonical, factors, graph, matrix, panel, rolling, search, stats, xsec
from panelforge.session import materialize

from .common import PANEL, r6, rd, returns, rounded, sorted_panel, weekly
from .factor_queries import CHARS, SERIES, SPECS, zoo_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: CTE wn (window, lo, hi): first and last weeks in sample, out of sample, and of both.
WINDOWS = """sw AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM p WHERE week >= (SELECT max(a) FROM (SELECT min(week) AS a FROM p GROUP BY symbol)))),
wl AS (SELECT week, CASE WHEN i < floor(n * 0.7) THEN 'IS' ELSE 'OOS' END AS "window" FROM sw), wn AS (SELECT "window", min(week) AS lo, max(week) AS hi FROM (SELECT * FROM wl UNION ALL SELECT week, 'Full' FROM wl) GROUP BY 1)"""


def nw_sql(rows: str, keys: str, x: str, name: str) -> str:
    """CTEs that end in ``name`` (keys, n, mean, se): Newey-West errors with four lags."""
    return f"""{name}e AS (SELECT {keys}, week, {x}, {x} - avg({x}) OVER (PARTITION BY {keys}) AS e FROM {rows} WHERE {x} IS NOT NULL),
{name}l AS (SELECT *, e * lag(e, 1) OVER w AS e1, e * lag(e, 2) OVER w AS e2, e * lag(e, 3) OVER w AS e3, e * lag(e, 4) OVER w AS e4 FROM {name}e WINDOW w AS (PARTITION BY {keys} ORDER BY week)),
{name} AS (SELECT {keys}, count(*) AS n, avg({x}) AS mean, sqrt(greatest(avg(e * e) + 2 * (0.8 * coalesce(avg(e1), 0) + 0.6 * coalesce(avg(e2), 0) + 0.4 * coalesce(avg(e3), 0) + 0.2 * coalesce(avg(e4), 0)), 0) / count(*)) AS se FROM {name}l GROUP BY {keys})"""


def windows_of(spark, d):
    return panel.closed_windows(panel.chronological_split(weekly(spark, d)))


@query(f'WITH {PANEL}, {WINDOWS} SELECT "window", lo, hi FROM wn')
def sample_windows(spark, d):
    return windows_of(spark, d)


#: CTE ic (factor, week, ic): Spearman correlations of the zoo's measures with the next return.
ICS = "ic AS (" + " UNION ALL ".join(f"""SELECT '{f}' AS factor, week, corr(a, b) AS ic FROM (SELECT week, rank() OVER (PARTITION BY week ORDER BY round({x}, 9)) + (count(*) OVER (PARTITION BY week, round({x}, 9)) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY week ORDER BY fwd) + (count(*) OVER (PARTITION BY week, fwd) - 1) / 2.0 AS b FROM c WHERE {x} IS NOT NULL AND fwd IS NOT NULL) GROUP BY week HAVING count(*) >= 10""" for f, (x, _) in SPECS.items()) + ")"


def ics_of(spark, d):
    """(factor, week, n, ic): all factors in one pass. Measures are rounded to nine places, as sums in another order would make
    ties or part them. A row a week and factor, written, as statistics read it more than once."""
    rows = sorted_panel(spark, d).select("week", "symbol", "fwd", *(F.round(F.col(x).cast("double"), 9).alias(f) for f, (x, _) in SPECS.items()))
    return materialize(xsec.information_coefficients(rows, {f: f for f in SPECS}, "fwd"), "ics")


DIRECTION = "CASE WHEN factor IN ('LOWVOL', 'SIZE') THEN -1 ELSE 1 END"
#: CTEs up to cp (factor, window, statistics of returns and of correlations).
COMPARED = SERIES + f", {ICS}, {WINDOWS}, zw AS (SELECT factor, \"window\", week, ret FROM z, wn WHERE week BETWEEN lo AND hi), iw AS (SELECT factor, \"window\", week, ic FROM ic, wn WHERE week BETWEEN lo AND hi), {nw_sql('zw', 'factor, \"window\"', 'ret', 'nr')}, {nw_sql('iw', 'factor, \"window\"', 'ic', 'ni')}" + """,
mo AS (SELECT factor, "window", avg(ret) * 52 AS ann_mean, avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe FROM zw GROUP BY 1, 2),
cp AS (SELECT nr.factor, nr."window", nr.n, ann_mean, sharpe, nr.mean / nullif(nr.se, 0) AS t, CASE WHEN ni.n >= 5 THEN ni.mean END AS ic, CASE WHEN ni.n >= 5 THEN ni.mean / nullif(ni.se, 0) END AS ic_t FROM nr JOIN mo USING (factor, "window") LEFT JOIN ni USING (factor, "window") WHERE nr.n >= 5)"""


def compared(spark, d):
    windows = materialize(windows_of(spark, d), "windows")
    r = stats.window_stats(panel.in_windows(zoo_of(spark, d), windows), ["factor", "window"], "ret").select("factor", "window", "n", "ann_mean", "sharpe", "t")
    i = stats.newey_west(panel.in_windows(ics_of(spark, d), windows), ["factor", "window"], "ic").filter("n >= 5").select("factor", "window", F.col("mean").alias("ic"), F.col("t").alias("ic_t"))
    return r.join(i, ["factor", "window"], "left")


@query(f'WITH {COMPARED} SELECT factor, "window", n, {r6("ann_mean", "sharpe", places=5)}, round(t + 1e-8, 4) AS t, round(ic + 1e-8, 5) AS ic, round(ic_t + 1e-8, 4) AS ic_t FROM cp')
def is_oos_comparison(spark, d):
    a = compared(spark, d)
    return a.select("factor", "window", "n", *(rd(c, k).alias(c) for c, k in (("ann_mean", 5), ("sharpe", 5), ("t", 4), ("ic", 5), ("ic_t", 4))))


#: One row a factor: statistics in and out of sample side by side.
SIDES = """sd AS (SELECT i.factor, i.t AS t_in, o.t AS t_out, i.ann_mean AS m_in, o.ann_mean AS m_out, i.ic_t AS ic_in, o.ic_t AS ic_out FROM cp AS i LEFT JOIN cp AS o ON o.factor = i.factor AND o."window" = 'OOS' WHERE i."window" = 'IS')"""


def sides(spark, d):
    a = materialize(compared(spark, d), "compared")  # a row a factor and window
    one = lambda w, tail: a.filter(F.col("window") == w).select("factor", F.col("t").alias(f"t_{tail}"), F.col("ann_mean").alias(f"m_{tail}"), F.col("ic_t").alias(f"ic_{tail}"))
    return one("IS", "in").join(one("OOS", "out"), "factor", "left")


@query(f"WITH {COMPARED}, {SIDES} SELECT factor, CASE WHEN t_in IS NULL OR abs(t_in) < 2 THEN 'weak' WHEN sign(m_in) = sign(m_out) AND abs(t_out) >= 1 THEN 'robust' ELSE 'in_sample_only' END AS verdict FROM sd")
def verdicts(spark, d):
    return sides(spark, d).select("factor", stats.verdict(F.col("t_in"), F.col("t_out"), F.col("m_in"), F.col("m_out")).alias("verdict"))


#: CTEs up to df (factor, eps1, eps2, rev1, rev2): stochastic dominance of each factor over the equal-weight market.
DOMINANCE = """mk AS (SELECT week, avg(fwd) AS m FROM f WHERE fwd IS NOT NULL GROUP BY week), x AS (SELECT factor, ret AS a, m AS b FROM z JOIN mk USING (week)),
sp AS (SELECT factor, least(min(a), min(b)) AS lo, greatest(max(a), max(b)) AS hi, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 10), dd AS (SELECT factor, lo, (hi - lo) / 999 AS d, n FROM sp),
cn AS (SELECT factor, CAST(greatest(ceil((v - lo) / d - 1e-9), 0) AS INT) AS g, sum(k) AS c FROM (SELECT factor, a AS v, 1 AS k FROM x UNION ALL SELECT factor, b, -1 FROM x) JOIN dd USING (factor) GROUP BY 1, 2),
gr AS (SELECT factor, n, d, unnest(range(0, 1000)) AS g FROM dd),
y AS (SELECT gr.factor, n, d, gr.g, sum(coalesce(c, 0)) OVER (PARTITION BY gr.factor ORDER BY gr.g) / n AS f FROM gr LEFT JOIN cn ON cn.factor = gr.factor AND cn.g = gr.g), q AS (SELECT *, sum(f * d) OVER (PARTITION BY factor ORDER BY g) AS s FROM y),
df AS (SELECT factor, sum(greatest(f, 0)) / sum(abs(f)) AS eps1, sum(greatest(s, 0)) / sum(abs(s)) AS eps2, sum(greatest(-f, 0)) / sum(abs(f)) AS rev1, sum(greatest(-s, 0)) / sum(abs(s)) AS rev2 FROM q GROUP BY factor)"""


def dominance(spark, d):
    m = returns(spark, d).filter("fwd is not null").groupBy("week").agg(F.avg("fwd").alias("m"))
    pairs = materialize(zoo_of(spark, d).join(m, "week"), "pairs")  # a row a week and factor, read twice
    return stats.dominance_flags(stats.stochastic_dominance(pairs, ["factor"], "ret", "m"))


@query(f"WITH {SERIES}, {DOMINANCE} SELECT factor, {r6('eps1', 'eps2', 'rev1', 'rev2', places=5)}, eps1 <= 0.059 AS afsd, eps2 <= 0.032 AS assd, rev1 <= 0.059 AS afsd_by, rev2 <= 0.032 AS assd_by FROM df")
def dominance_flags(spark, d):
    return rounded(dominance(spark, d).drop("n"), 5)


@query(f"WITH {SERIES}, {DOMINANCE} SELECT week, round(avg(ret) + 1e-8, 6) AS ret FROM z WHERE factor IN (SELECT factor FROM df WHERE eps1 <= 0.35 OR eps2 <= 0.35) GROUP BY week")
def dominant_composite(spark, d):
    """The mean return of the factors that dominate the market (here: to within 0.35, as none does to within the usual bars)."""
    names = dominance(spark, d).filter("eps1 <= 0.35 or eps2 <= 0.35")
    return rounded(stats.composite(zoo_of(spark, d), names, "factor", "ret"))


@query(f"""
WITH {COMPARED}, {SIDES}, {DOMINANCE}, g AS (SELECT factor, {DIRECTION} * ic_in AS a, {DIRECTION} * ic_out AS b, abs(coalesce(t_in, 0)) AS tp, eps2 <= 0.032 AS assd, rev1 <= 0.059 AS dom FROM sd JOIN df USING (factor)),
h AS (SELECT *, tp >= 1.65 AS priced, tp >= 1.3 AND tp < 1.65 AS border, coalesce(a >= 1.65 AND b >= 1, false) AS strong, coalesce(a <= -1.65 AND b <= -1, false) AS rev, coalesce(a >= 1.3, false) OR coalesce(a >= 1 AND b >= 1, false) AS partly FROM g)
SELECT factor, round(a + 1e-8, 4) AS signed_ic_in, round(b + 1e-8, 4) AS signed_ic_out, CASE WHEN factor = 'SIZE' THEN 'Structure' WHEN (strong OR rev) AND priced THEN 'Confirmed' WHEN priced THEN 'Priced risk' WHEN strong OR rev THEN 'Tradable signal' WHEN assd OR partly OR border THEN 'Suggestive'
  WHEN dom OR (coalesce(a <= -1.65, false) AND NOT rev) THEN 'Not supported' WHEN a IS NULL THEN 'Economic-only' ELSE 'Not supported' END AS grade FROM h""")
def evidence_grades(spark, d):
    """Grades of the factors, their in-sample t as that of the premium; correlations are turned in the direction of the bet."""
    low = [f for f, (_, long_low) in SPECS.items() if long_low]
    sign = F.when(F.col("factor").isin(*low), -1).otherwise(1)
    a = sides(spark, d).join(dominance(spark, d).select("factor", "assd", "afsd_by"), "factor").withColumns({"a": sign * F.col("ic_in"), "b": sign * F.col("ic_out")})
    found = stats.grade(F.col("t_in"), F.col("a"), F.col("b"), F.col("assd"), F.col("afsd_by"), F.lit(False), F.col("factor") == "SIZE")
    return a.select("factor", rd("a", 4).alias("signed_ic_in"), rd("b", 4).alias("signed_ic_out"), found.alias("grade"))


@query(f"""
WITH {CHARS}, {ICS}, k AS (SELECT factor, week, ic, row_number() OVER (PARTITION BY factor ORDER BY week) AS i FROM ic WHERE ic IS NOT NULL),
j AS (SELECT k.factor, k.week, o.i, o.ic - avg(o.ic) OVER w AS e, avg(o.ic) OVER w AS m FROM k JOIN k AS o ON o.factor = k.factor AND o.i BETWEEN k.i - 26 AND k.i - 1 WHERE k.i > 26 WINDOW w AS (PARTITION BY k.factor, k.week)),
l AS (SELECT *, e * lag(e, 1) OVER w AS e1, e * lag(e, 2) OVER w AS e2, e * lag(e, 3) OVER w AS e3, e * lag(e, 4) OVER w AS e4 FROM j WINDOW w AS (PARTITION BY factor, week ORDER BY i)),
t AS (SELECT factor, week, any_value(m) AS mean, any_value(m) / sqrt(CASE WHEN avg(e * e) + 2 * (0.8 * avg(e1) + 0.6 * avg(e2) + 0.4 * avg(e3) + 0.2 * avg(e4)) > 1e-6 THEN avg(e * e) + 2 * (0.8 * avg(e1) + 0.6 * avg(e2) + 0.4 * avg(e3) + 0.2 * avg(e4)) END / 26) AS t FROM l GROUP BY 1, 2)
SELECT factor, week, round(mean + 1e-8, 5) AS mean, round(t + 1e-8, 3) AS t FROM t""")
def rolling_ic(spark, d):
    """Mean and Newey-West t of the 26 correlations before each week; t is null where they have next to no variance."""
    a = stats.rolling_newey_west(ics_of(spark, d), ["factor"], "ic").filter("mean is not null")
    return a.select("factor", "week", rd("mean", 5).alias("mean"), rd(F.when(F.pow(F.try_divide("mean", "t"), 2) * 26 > 1e-6, F.col("t")), 3).alias("t"))


# Terciles


TERCILES = CHARS + """, te AS (SELECT week, list_sort(list_distinct(quantile_cont(vol4, [0.0, 1.0 / 3, 2.0 / 3, 1.0]))) AS e FROM c WHERE vol4 IS NOT NULL AND fwd IS NOT NULL GROUP BY week HAVING count(*) >= 6),
tb AS (SELECT week, symbol, fwd, vol4, CAST(greatest(len(list_filter(e, lambda v: v < vol4)) - 1, 0) AS INT) AS bin FROM c JOIN te USING (week) WHERE vol4 IS NOT NULL AND fwd IS NOT NULL AND len(e) = 4),
tp AS (SELECT week, avg(fwd) FILTER (bin = 0) / 20 AS low, avg(fwd) FILTER (bin = 1) / 20 AS middle, avg(fwd) FILTER (bin = 2) / 20 AS high, avg(vol4) FILTER (bin = 0) AS vol_low, avg(vol4) FILTER (bin = 2) AS vol_high FROM tb GROUP BY week)"""


def terciles(spark, d):
    """(week, low, middle, high, vol_low, vol_high): mean next returns (a twentieth, as the tables' are large) and volatility of thirds by volatility."""
    known = sorted_panel(spark, d).filter("fwd is not null and vol4 is not null")
    known = known.withColumn("_n", F.count("*").over(W.partitionBy("week"))).filter("_n >= 6")
    a = xsec.quantile_bins(known, "vol4", "bin", [0.0, 1 / 3, 2 / 3, 1.0]).withColumn("_top", F.max("bin").over(W.partitionBy("week"))).filter("_top = 2")
    third = lambda k, c: F.avg(F.when(F.col("bin") == k, F.col(c)))
    return a.groupBy("week").agg(*((third(k, "fwd") / 20).alias(n) for k, n in enumerate(("low", "middle", "high"))), third(0, "vol4").alias("vol_low"), third(2, "vol4").alias("vol_high"))


@query(f"""
WITH {TERCILES}, {WINDOWS}, u AS (SELECT week, unnest(['low', 'middle', 'high', 'spread']) AS tercile, unnest([low, middle, high, low - high]) AS ret FROM tp WHERE low IS NOT NULL AND middle IS NOT NULL AND high IS NOT NULL)
SELECT tercile, "window", count(*) AS n, CASE WHEN min(ret) > -1 THEN round(power(exp(sum(ln(greatest(1 + ret, 1e-300)))), 52.0 / count(*)) - 1 + 1e-8, 5) END AS ann_return FROM u, wn WHERE week BETWEEN lo AND hi GROUP BY 1, 2""")
def tercile_windows(spark, d):
    """Annualised returns of thirds and of their spread in and out of sample; null where a week loses all or more."""
    a = terciles(spark, d).dropna(subset=["low", "middle", "high"]).withColumn("spread", F.col("low") - F.col("high"))
    long = panel.in_windows(a.unpivot("week", ["low", "middle", "high", "spread"], "tercile", "ret"), windows_of(spark, d))
    return rounded(long.groupBy("tercile", "window").agg(F.count("*").alias("n"), F.when(F.min("ret") > -1, F.pow(F.exp(F.sum(F.log1p("ret"))), 52 / F.count("*")) - 1).alias("ann_return")), 5)


@query(f"""
WITH {TERCILES}, g AS (SELECT week, coalesce(low, 0) AS low, coalesce(middle, 0) AS middle, coalesce(high, 0) AS high FROM tp)
SELECT week, round(exp(sum(ln(1 + low / 10)) OVER o) + 1e-8, 5) AS low, round(exp(sum(ln(1 + middle / 10)) OVER o) + 1e-8, 5) AS middle, round(exp(sum(ln(1 + high / 10)) OVER o) + 1e-8, 5) AS high, round(exp(sum(ln(1 + (low - high) / 10)) OVER o) + 1e-8, 5) AS spread FROM g WINDOW o AS (ORDER BY week ROWS UNBOUNDED PRECEDING)""")
def tercile_cumulative(spark, d):
    """Growth of one unit in each third and in their spread, an empty third as no return (a tenth of the returns)."""
    over = W.orderBy("week").rowsBetween(W.unboundedPreceding, 0)
    a = terciles(spark, d).fillna(0.0, ["low", "middle", "high"]).withColumn("spread", F.col("low") - F.col("high"))
    return rounded(a.select("week", *(F.exp(F.sum(F.log1p(F.col(c) / 10)).over(over)).alias(c) for c in ("low", "middle", "high", "spread"))), 5)


@query(f"""
WITH {TERCILES} SELECT week, round(CASE WHEN count(vol_low) OVER o >= 4 THEN avg(vol_low) OVER o END + 1e-8, 5) AS low, round(CASE WHEN count(vol_high) OVER o >= 4 THEN avg(vol_high) OVER o END + 1e-8, 5) AS high, round(CASE WHEN count(vol_high - vol_low) OVER o >= 4 THEN avg(vol_high - vol_low) OVER o END + 1e-8, 5) AS spread
FROM tp WINDOW o AS (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def volatility_spread(spark, d):
    """Four-week means of the volatility of the outer thirds and of their difference."""
    a = terciles(spark, d).withColumn("spread", F.col("vol_high") - F.col("vol_low"))
    return rounded(a.select("week", *(rolling.mean(F.col(c), 4, by=()).alias(n) for c, n in (("vol_low", "low"), ("vol_high", "high"), ("spread", "spread")))), 5)


@query(f"""
WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY ret, week) AS place FROM z) SELECT factor, week, round(ret + 1e-8, 6) AS ret, place FROM k WHERE place <= 5""")
def worst_weeks(spark, d):
    """The five worst weeks of each factor, by rank: a report of fixed length."""
    place = F.row_number().over(W.partitionBy("factor").orderBy("ret", "week"))
    return rounded(zoo_of(spark, d).select("factor", "week", "ret", place.alias("place")).filter("place <= 5"))


@query(f"""
WITH {CHARS}, {WINDOWS}, k AS (SELECT week, symbol, fwd, (rank() OVER (PARTITION BY week ORDER BY max4) + (count(*) OVER (PARTITION BY week, max4) - 1) / 2.0) / count(*) OVER (PARTITION BY week) AS x FROM c WHERE max4 IS NOT NULL AND fwd IS NOT NULL),
h AS (SELECT k.*, "window" FROM k, wn WHERE week BETWEEN lo AND hi AND "window" <> 'Full'), e AS (SELECT "window", list_sort(list_distinct(quantile_cont(x, [{', '.join(f'{i} / 20.0' for i in range(21))}]))) AS e FROM h GROUP BY 1),
b AS (SELECT h.*, CAST(greatest(len(list_filter(e, lambda v: v < x)) - 1, 0) AS INT) AS bin FROM h JOIN e USING ("window"))
SELECT "window", bin, count(*) AS n, round(avg(x) + 1e-8, 4) AS x, round(avg(fwd) + 1e-8, 4) AS y FROM b GROUP BY 1, 2""")
def reversal_bins(spark, d):
    """Mean next return in twenty bins of the rank of the greatest return, in and out of sample."""
    a = sorted_panel(spark, d).filter("max4 is not null and fwd is not null").select("week", "symbol", "fwd", xsec.percent_rank(F.col("max4")).alias("x"))
    a = materialize(panel.in_windows(a, windows_of(spark, d).filter("window <> 'Full'")), "windows")
    binned = xsec.quantile_bins_of_few(a, "x", "bin", [i / 20 for i in range(21)], "window")
    return rounded(binned.groupBy("window", "bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("fwd").alias("y")), 4)


@query(f"""
WITH {SERIES}, {ICS}, i AS (SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS ic_n FROM ic GROUP BY 1), l AS (SELECT factor, avg(ret) AS ls_mean, stddev_samp(ret) AS ls_std, count(ret) AS ls_n FROM z WHERE factor <> 'FEE' GROUP BY 1),
m AS (SELECT week, avg(fwd) AS mk FROM f WHERE fwd IS NOT NULL GROUP BY week), a AS (SELECT factor, regr_intercept(ret, mk) AS alpha, regr_slope(ret, mk) AS beta FROM z JOIN m USING (week) WHERE factor <> 'MOM' GROUP BY 1 HAVING count(*) >= 10)
SELECT factor, round(ic_mean + 1e-8, 5) AS ic_mean, round(ic_mean / nullif(ic_std, 0) + 1e-8, 5) AS ic_ir, ic_n, round(ls_mean + 1e-8, 5) AS ls_mean, round(ls_mean / nullif(ls_std, 0) * sqrt(52) + 1e-8, 5) AS ls_sharpe, ls_n, round(alpha + 1e-8, 5) AS alpha, round(beta + 1e-8, 5) AS beta
FROM i FULL OUTER JOIN l USING (factor) FULL OUTER JOIN a USING (factor)""")
def model_summary(spark, d):
    """Correlations, long-short returns (not of FEE here) and alphas (not of MOM) of each factor, outer-joined."""
    # All three are read off one pass over the panel; a row a week and factor, written.
    found = materialize(factors.weekly_evidence(sorted_panel(spark, d), SPECS, 9), "evidence")
    z = found.filter("what = 'ret'").select("week", "factor", F.col("value").alias("ret"))
    i = found.filter("what = 'ic'").withColumnRenamed("value", "ic").groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), F.count("ic").alias("ic_n"))
    ls = z.filter("factor <> 'FEE'").groupBy("factor").agg(F.avg("ret").alias("ls_mean"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(52.0))).alias("ls_sharpe"), F.count("ret").alias("ls_n"))
    m = found.filter("what = 'market'").select("week", F.col("value").alias("mk"))
    a = stats.univariate_ols(z.filter("factor <> 'MOM'").join(m, "week"), ["factor"], "ret", "mk").select("factor", "alpha", "beta")
    return rounded(i.join(ls, "factor", "full_outer").join(a, "factor", "full_outer"), 5)


# Rolling variants


def _o(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY week ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _gate(x: str, expr: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_o(n)} >= {n} THEN {expr} OVER {_o(n)} END"


_UP, _DOWN = "CASE WHEN ret > 0 THEN ret END", "CASE WHEN ret < 0 THEN ret END"


@query(f"""
WITH {PANEL}, m AS (SELECT week, avg(ret) AS mk FROM r GROUP BY week), a AS (SELECT r.*, mk, CASE WHEN count(ret * mk) OVER {_o(8)} >= 8 THEN (avg(ret * mk) OVER {_o(8)} - avg(ret) OVER {_o(8)} * avg(mk) OVER {_o(8)}) / nullif(var_samp(mk) OVER {_o(8)}, 0) END AS beta8 FROM r JOIN m USING (week)),
b AS (SELECT *, ret - beta8 * mk AS e FROM a)
SELECT week, symbol, round(CASE WHEN count(ret) OVER {_o(4)} >= 3 AND count(*) OVER {_o(4)} = count(ret) OVER {_o(4)} THEN exp(sum(ln(1 + ret)) OVER {_o(4)}) - 1 END + 1e-8, 5) AS mom4c, round(beta8 + 1e-8, 4) AS beta8, round({_gate('ret * mk', 'corr(ret, mk)', 8)} + 1e-8, 4) AS corr8,
  round({_gate('e', 'stddev_samp(e)', 8)} + 1e-8, 4) AS idvol8, round({_gate(_UP, f'stddev_samp({_UP})', 3)} + 1e-8, 4) AS upvol3, round({_gate(_DOWN, f'stddev_samp({_DOWN})', 3)} + 1e-8, 4) AS downvol3,
  round((week - min(week) OVER (PARTITION BY symbol)) / 7.0 + 1e-8, 4) AS age_weeks, round(CASE WHEN count(ret) OVER {_o(4)} >= 3 THEN stddev_samp(ret) OVER {_o(4)} END + 1e-8, 5) AS vol4_3 FROM b""")
def rolling_variants(spark, d):
    """Measures that differ from their namesakes in gates or conventions: mixed-moment beta, volatility of what it leaves,
    up and down volatility with full frames, age in calendar weeks."""
    a = returns(spark, d).join(factors.equal_weight_market(returns(spark, d)), "week")
    r, m = F.col("ret"), F.col("market")
    a = a.withColumn("beta8", rolling.beta_mixed(r, m, 8)).withColumn("e", r - F.col("beta8") * m)
    age = F.datediff("week", F.min("week").over(W.partitionBy("symbol"))) / 7
    made = {
        "mom4c": (rolling.compounded(r, 4, 3), 5), "beta8": (F.col("beta8"), 4), "corr8": (rolling.correlation(r, m, 8), 4), "idvol8": (rolling.sd(F.col("e"), 8), 4), "upvol3": (rolling.sd(F.when(r > 0, r), 3), 4),
        "downvol3": (rolling.sd(F.when(r < 0, r), 3), 4), "age_weeks": (age, 4), "vol4_3": (rolling.sd(r, 4, 3), 5),
    }
    return a.select("week", "symbol", *(rd(x, k).alias(n) for n, (x, k) in made.items()))


@query()
def entropy_by_week(spark, d):
    """Weekly entropy of the networks' communities and the mean over its weeks so far."""
    e = xsec.entropy(graph.clusters(returns(spark, d), graph.RECIPES["network"]), "cluster")
    return e.withColumn("so_far", F.avg("entropy").over(W.orderBy("week").rowsBetween(W.unboundedPreceding, 0)))


# Candidates


def written_weeks(spark, d):
    """The weekly panel, written once for all that a search reads of it."""
    return materialize(weekly(spark, d), "weekly", free=True)


def candidate_series(spark, d, weeks=None):
    a = panel.with_returns(written_weeks(spark, d) if weeks is None else weeks)
    a = a.join(materialize(factors.equal_weight_market(a), "market", free=True), "week").select("week", "symbol", "ret", "price", "mcap", "fwd", "market")
    return search.all_candidates(materialize(a, "returns", free=True))


def base_of(weeks):
    return materialize(factors.zoo(factors.characteristics(panel.with_returns(weeks)), SPECS), "zoo", free=True)


def spans_of(weeks):
    return materialize(panel.closed_windows(panel.chronological_split(weeks)), "windows", free=True)


@query()
def candidate_returns(spark, d):
    """All 110 characteristics in both directions: the t of their returns, corrected for the number of tests."""
    return search.screened(candidate_series(spark, d))


def full_window(windows):
    return windows.filter("`window` = 'Full'")


@query()
def candidate_search(spark, d):
    """The candidates that are no near twin of a base factor, priced beside the base and hidden factors over the whole sample;
    the t of that premium corrected for the number of tests."""
    weeks = written_weeks(spark, d)
    series = candidate_series(spark, d, weeks)
    return search.tested(series, search.priced(panel.with_returns(weeks), base_of(weeks), series, full_window(spans_of(weeks))))


@query()
def candidate_prices(spark, d):
    """The same premia over the whole sample and in and out of sample."""
    weeks = written_weeks(spark, d)
    return search.priced(panel.with_returns(weeks), base_of(weeks), candidate_series(spark, d, weeks), spans_of(weeks))


@query()
def joint_prices(spark, d):
    """Premia of the base factors and of the three strongest candidates in one model, in each window."""
    weeks = written_weeks(spark, d)
    rows, series, base, windows = panel.with_returns(weeks), candidate_series(spark, d, weeks), base_of(weeks), spans_of(weeks)
    tests = search.tested(series, search.priced(rows, base, series, full_window(windows)))
    return search.joint(rows, base, series, search.shortlist(series, tests, 3), windows)


@query()
def cca_forward(spark, d):
    """Canonical factors of returns against market series, fitted in sample and applied to all weeks. Prices are carried over
    gaps, as next to no symbol has all weeks."""
    p = materialize(weekly(spark, d).select("week", "symbol", "price", "mcap"), "panel")
    split = panel.chronological_split(p)
    return canonical.forward_canonical(panel.with_returns(p, "pad"), factors.market_state(panel.with_returns(p), 1), split.filter("window = 'IS'").select("week"))


@query()
def graph_recipes(spark, d):
    """Communities of the three recipes of networks, side by side."""
    rows = materialize(returns(spark, d).select("week", "symbol", "ret"), "returns")
    found = None
    for name, recipe in graph.RECIPES.items():
        one = graph.clusters(rows, recipe).withColumn("recipe", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("recipe", "week").agg(F.countDistinct("cluster").alias("n_clusters"), F.count("*").alias("n_names"))
