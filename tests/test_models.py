"""Regressions, decompositions, graphs and searches against plain versions, and every query without SQL on the smallest tables."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import canonical, graph, matrix, pricing, regime, rolling, search, stats, xsec
from panelforge.plans import ORACLE_SQL, QUERIES
from panelforge.session import replace_folders
from panelforge.sources import write_manifest, write_twins

MONDAY = dt.date(2024, 1, 1)


def week(k):
    return MONDAY + dt.timedelta(days=7 * int(k))


@pytest.fixture(scope="module")
def panel():
    """Weeks by symbols with gaps, y on two measures."""
    random = np.random.default_rng(21)
    rows = [(week(k), s, float(a), float(b) if random.random() < 0.8 else None, float(0.3 * a - 0.2 * b + e) if random.random() < 0.9 else None) for k in range(60) for s in range(14) for a, b, e in [random.normal(size=3)]]
    return pd.DataFrame(rows, columns=["week", "symbol", "a", "b", "y"])


@pytest.fixture(scope="module")
def rows(spark, panel):
    return spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in panel.itertuples(index=False)], "week date, symbol long, a double, b double, y double")


def normal_equations(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(x.T @ x, x.T @ y)


def test_cross_sections(panel, rows):
    got = {(r.week, r.term): r.slope for r in matrix.fama_macbeth(rows, "y", ["a", "b"]).collect()}
    for w, g in panel[panel.y.notna()].groupby("week"):
        if len(g) >= 8:
            want = normal_equations(g[["a", "b"]].fillna(0).to_numpy(), g.y.to_numpy())
            assert np.allclose([got[w, t] for t in ("intercept", "a", "b")], want)
    g = panel[panel.y.notna()]
    c = matrix.pooled_ols(rows, "y", ["a", "b"])
    assert np.allclose(list(c.values()), normal_equations(g[["a", "b"]].fillna(0).to_numpy(), g.y.to_numpy()))
    p = matrix.predict(rows, c).filter("week = date '2024-01-01'").collect()
    assert all(abs(r.prediction - (c["intercept"] + c["a"] * r.a + c["b"] * (r.b or 0))) < 1e-12 for r in p)


def test_series_regressions(panel, rows):
    got = {(r.symbol, r.term): r.beta for r in matrix.series_betas(rows, "y", ["a", "b"]).collect()}
    r2 = {r.symbol: r.r2 for r in matrix.series_r2(rows, "y", ["a", "b"]).collect()}
    for s, g in panel.dropna().groupby("symbol"):
        want = normal_equations(g[["a", "b"]].to_numpy(), g.y.to_numpy())
        e = g.y - want[0] - g[["a", "b"]].to_numpy() @ want[1:]
        assert np.allclose([got[s, t] for t in ("intercept", "a", "b")], want) and abs(r2[s] - (1 - (e**2).sum() / ((g.y - g.y.mean()) ** 2).sum())) < 1e-9


def test_three_passes_find_premia_beside_a_hidden_factor(spark):
    random = np.random.default_rng(3)
    n, t = 60, 300
    beta, hidden = random.normal(1, 0.5, (n, 2)), random.normal(0, 1, n)
    f, h = random.normal(0, 0.02, (t, 2)), random.normal(0, 0.02, t)
    premia, own = np.array([0.004, -0.003]), 0.005
    y = (f - f.mean(0) + premia) @ beta.T + (h - h.mean() + own)[:, None] * hidden + random.normal(0, 0.001, (t, n))
    returns = spark.createDataFrame([(week(k), j, float(y[k, j])) for k in range(t) for j in range(n)], "week date, symbol long, ret double")
    factors = spark.createDataFrame([(week(k), m, float(f[k, j])) for k in range(t) for j, m in enumerate("xy")], "week date, factor string, ret double")
    got = {r.factor: r for r in pricing.premia(returns, factors).collect()}
    assert all(got[m].n_hidden == 1 and got[m].n_assets == n and abs(got[m].premium - premia[j]) < 3e-4 for j, m in enumerate("xy"))
    b = np.array([normal_equations(f, y[:, j])[1:] for j in range(n)])
    alone = np.linalg.solve(b.T @ b, b.T @ y.mean(0))
    weekly = np.array([np.linalg.solve(b.T @ b, b.T @ row) for row in y])
    assert np.allclose([got[m].premium_alone for m in "xy"], alone) and np.allclose([got[m].fmb_mean for m in "xy"], weekly.mean(0))
    assert np.allclose([got[m].fmb_t for m in "xy"], [weekly[:, j].mean() / pricing.newey_west_se(weekly[:, j]) for j in range(2)])


def test_window_components(spark):
    random = np.random.default_rng(9)
    r = random.normal(size=(30, 12))
    r[random.random((30, 12)) < 0.1] = np.nan
    rows = [(week(k), j, float(r[k, j])) for k in range(30) for j in range(12) if not np.isnan(r[k, j])]
    got = {(x.end, x.symbol): x for x in matrix.rolling_pca(spark.createDataFrame(rows, "week date, symbol long, ret double")).collect()}
    assert {x for x, _ in got} == {week(k) for k in range(26, 30)}
    x = r[1:27]
    keep = (~np.isnan(x)).sum(0) >= 16
    z = np.nan_to_num(x)[:, keep]
    z = (z - z.mean(0)).T
    z = z - z.mean(0)
    value, vector = np.linalg.eigh(z.T @ z)
    score = z @ vector[:, ::-1][:, :3]
    names = np.flatnonzero(keep)
    assert np.allclose(np.abs([got[week(27), j].loadings for j in names]), np.abs(score)) and np.allclose(got[week(27), names[0]].explained, value[::-1][:3] / value.sum())
    known = [i for i, j in enumerate(names) if not np.isnan(r[26, j])]
    b = normal_equations(score[known], r[26, names[known]])
    assert all(abs(got[week(27), names[i]].residual - (r[26, names[i]] - b[0] - score[i] @ b[1:])) < 1e-9 for i in known)


def test_sparse_components_are_best_for_their_atoms():
    """Each loading meets the conditions of the lasso's optimum; no atom is longer than one; a rank-one table gives its column."""
    random = np.random.default_rng(2)
    series = random.normal(size=(104, 3))
    x = np.hstack([series[:, [j]] * random.uniform(0.5, 2, 8) + random.normal(0, 0.3, (104, 8)) for j in range(3)])
    x = (x - x.mean(0)) / x.std(0)
    for alpha in (0.0, 1.2, 4.0):
        atoms = random.normal(size=(3, 104)) / 12
        u = matrix.lasso_codes(x, atoms, alpha, np.zeros((24, 3)))
        slope = atoms @ (x - (u @ atoms).T)  # of half the squared rest
        assert np.allclose(slope.T[u != 0], alpha * np.sign(u[u != 0]), atol=1e-6) and (np.abs(slope) <= alpha + 1e-6).all()
    load = matrix.sparse_components(x, 3, 4.0)
    assert np.allclose(np.linalg.norm(load, axis=1), 1) and (load == 0).mean() > 0.4
    assert sorted(int(np.abs(v.reshape(3, 8)).sum(1).argmax()) for v in load) == [0, 1, 2]  # a component a block
    share = matrix.explained_by(x, load)
    for k in range(1, 4):
        z = x @ load[:k].T
        fit = z @ np.linalg.solve(z.T @ z, z.T @ x)
        assert abs(share[k - 1] - (1 - ((x - fit) ** 2).sum() / (x**2).sum())) < 1e-9
    plain = np.linalg.svd(x, full_matrices=False)[2][:3]
    dense = matrix.sparse_components(x, 3, 1e-9)
    assert np.allclose(np.linalg.svd(plain @ np.linalg.qr(dense.T)[0])[1], 1, atol=1e-3)  # without a penalty the span is that of principal components


def test_loadings_do_not_look_ahead(spark):
    """A symbol that stops before ``end`` is fitted all the same and only makes no return."""
    random = np.random.default_rng(5)
    r = random.normal(size=(32, 14)) + random.normal(size=(32, 1))
    rows = lambda gone: spark.createDataFrame([(week(k), j, float(r[k, j])) for k in range(31) for j in range(14) if not (gone and k == 30 and j in (2, 3))], "week date, symbol long, ret double")
    all_there, two_gone = ({x.component: x for x in matrix.rolling_sparse_pca(rows(gone), n=30, k=2).filter(F.col("end") == week(30)).collect()} for gone in (False, True))
    assert len(all_there) == 2 and all((x.n_loaded, x.n_symbols, x.explained) == (two_gone[k].n_loaded, 14, two_gone[k].explained) for k, x in all_there.items())
    x = matrix.standardised(pd.DataFrame(r[:30]))
    load = matrix.sparse_components(x.to_numpy(), 2, 1.2)
    here = [j for j in range(14) if j not in (2, 3)]
    for names, got in ((list(range(14)), all_there), (here, two_gone)):
        y = r[30, names] - r[30, names].mean()
        assert np.allclose([got[k].ret for k in range(2)], load[:, names] @ y)
    whole = matrix.sparse_pca(rows(True), k=2).toPandas()
    assert sorted(whole["symbol"].unique()) == here and np.allclose(whole.groupby("component")["loading"].apply(lambda v: (v**2).sum()), 1)


def test_sparse_components_over_blocks_are_those_of_the_whole(spark, monkeypatch):
    """However the series come in blocks, the fit is one; a flat series and one with a gap are left out; no task widens a long table."""
    random = np.random.default_rng(9)
    r = random.normal(size=(30, 3)) @ random.normal(size=(3, 40)) + 0.3 * random.normal(size=(30, 40))
    held = np.vstack([r.T, np.full(30, 0.1), [np.nan, *r[1:, 0]]])
    x = matrix.standardised(pd.DataFrame(r)).to_numpy()
    blocks, use, n = matrix.standardised_blocks([held[:7], held[7:8], held[8:]])
    assert n == 41 and np.concatenate(use).tolist() == [True] * 40 + [False] * 2 and max(len(z) for z in blocks()) == 32
    for alpha in (0.0, 1.2, 4.0):
        load, whole = matrix.fitted_components(blocks, matrix.squares_of(blocks), 3, alpha), matrix.sparse_components(x, 3, alpha)
        assert np.allclose(load, whole, atol=1e-6) and np.allclose(matrix.explained_share(blocks, x @ x.T, load), matrix.explained_by(x, whole))
    rows = spark.createDataFrame([(week(k), j, float(r[k, j])) for k in range(30) for j in range(40)], "week date, symbol long, ret double")
    monkeypatch.setattr(pd.DataFrame, "pivot", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = matrix.sparse_pca(rows, k=3)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        got = np.array([x.loading for x in sorted(found.collect(), key=lambda x: (x.component, x.symbol))]).reshape(3, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, matrix.sparse_components(x, 3, 1.2), atol=1e-6)


def test_neighbouring_windows_share_groups(spark):
    """Rows in front of the groups are about three times the panel's, however many weeks a window has."""
    rows = spark.createDataFrame([(week(k), j, float(k + j)) for k in range(120) for j in range(3)], "week date, symbol long, ret double")
    for n, after in ((12, 0), (26, 1), (60, 0)):
        seen = matrix.sliding(rows, n, lambda wide, end: pd.DataFrame({"end": [end], "rows": [len(wide)], "last": [wide.iloc[-1, 0]]}), "end date, rows int, last double", after)
        got = {x.end: x for x in seen.collect()}
        assert len(got) == 120 and all(got[week(k)].rows == min(k + 1, n + after) and got[week(k)].last == k for k in range(120))
        generated = [p for p in str(seen._jdf.queryExecution().executedPlan()).split("\n") if "Generate" in p]
        stretch = max(4, (n + after) // 2)
        copies = sum(1 for k in range(120) for g in range(k // stretch, (k + n + after - 1) // stretch + 1))
        assert generated and copies <= 3.2 * 120


def test_canonical_correlations_solve_the_eigenproblem(spark):
    random = np.random.default_rng(6)
    x = random.normal(size=(90, 3))
    y = np.column_stack([x[:, 0] + 0.5 * random.normal(size=90), random.normal(size=90)])
    frame = lambda m, names: spark.createDataFrame([(week(k), *map(float, r)) for k, r in enumerate(m)], "week date, " + ", ".join(f"{n} double" for n in names))
    rows = canonical.canonical_correlations(frame(x, "abc"), frame(y, "uv")).orderBy("pair").collect()
    got = [r.rho for r in rows]
    a, b = x - x.mean(0), y - y.mean(0)
    want = np.sort(np.linalg.eigvals(np.linalg.solve(a.T @ a, a.T @ b) @ np.linalg.solve(b.T @ b, b.T @ a)).real)[::-1][:2]
    assert np.allclose(np.square(got), want)
    assert rows[0].left_drivers.startswith("a+, ") and rows[0].right_drivers.startswith("u+, ") and rows[0].n == 90  # y's first column is x's first and noise
    long = spark.createDataFrame([(week(k), j, float(x[k, j])) for k in range(90) for j in range(3)], "week date, symbol long, ret double")
    fit = spark.createDataFrame([(week(k),) for k in range(60)], "week date")
    values = canonical.forward_canonical(long, frame(y, "uv"), fit, 2).toPandas().pivot(index="week", columns="component", values="value").to_numpy()
    assert np.allclose(values, plain_variates(x, y, 60, 2))  # later weeks by the moments of the first


def plain_variates(x, y, n, k):
    """Canonical variates by singular vectors of the whole table."""
    z, v = (x - x[:n].mean(0)) / x[:n].std(0), (y[:n] - y[:n].mean(0)) / y[:n].std(0)
    u, s, r = np.linalg.svd(z[:n], full_matrices=False)
    keep = s > 1e-6
    p, _, _ = np.linalg.svd(u[:, keep].T @ np.linalg.svd(v, full_matrices=False)[0], full_matrices=False)
    w = ((r[keep].T / s[keep]) @ p[:, :k]).T
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    w = w * np.sign(w[np.arange(k), np.abs(w).argmax(1)])[:, None]
    return np.nan_to_num(z, nan=0.0) @ w.T


@pytest.mark.parametrize("part", [4000, 50])
def test_canonical_variates_of_more_symbols_than_weeks(spark, monkeypatch, part):
    monkeypatch.setattr(canonical, "PART", part)
    random = np.random.default_rng(16)
    x = random.normal(size=(50, 240)) + np.outer(random.normal(size=50), random.normal(size=240))
    y = np.column_stack([x[:, :40].mean(1) + 0.1 * random.normal(size=50), random.normal(size=50)])
    rows = [(week(k), j, float(x[k, j])) for k in range(50) for j in range(240)] + [(week(k), 999, 0.5) for k in range(20)]  # 999 has not all weeks
    market = spark.createDataFrame([(week(k), float(y[k, 0]), float(y[k, 1])) for k in range(50)], "week date, u double, v double")
    fit = spark.createDataFrame([(week(k),) for k in range(30)], "week date")
    got = canonical.forward_canonical(spark.createDataFrame(rows, "week date, symbol long, ret double"), market, fit, 2).toPandas().pivot(index="week", columns="component", values="value").to_numpy()
    assert np.allclose(got, plain_variates(x, y, 30, 2), atol=1e-6)


def test_only_whole_series_are_widened(spark):
    series = spark.createDataFrame([(week(k), n, float(k)) for k in range(10) for n in ("a", "b", "c") if n == "a" or n == "b" and k or n == "c" and k > 4], "week date, name string, x double")
    assert canonical.widened(series, "name", "x").columns == ["week", "a"] and canonical.widened(series, "name", "x", 0.9).columns == ["week", "a", "b"]


def test_networks(spark):
    random = np.random.default_rng(8)
    f = random.normal(size=(12, 2))
    r = np.hstack([f[:, [0]] + 0.2 * random.normal(size=(12, 4)), f[:, [1]] + 0.2 * random.normal(size=(12, 4))])
    rows = spark.createDataFrame([(week(k), j, float(r[k, j])) for k in range(12) for j in range(8)], "week date, symbol long, ret double")
    tree = [x for x in graph.tree_edges(rows, graph.RECIPES["network"]).collect() if x.end == week(11)]
    rho = pd.DataFrame(r).corr(method="spearman").to_numpy()
    d = np.sqrt(2 * (1 - rho))
    inside, weight = {0}, 0.0
    while len(inside) < 8:  # by growing one tree
        i, j = min(((i, j) for i in inside for j in range(8) if j not in inside), key=lambda e: d[e])
        inside, weight = inside | {j}, weight + d[i, j]
    assert len(tree) == 7 and abs(sum(x.distance for x in tree) - weight) < 1e-9 and all(abs(x.rho - rho[x.a, x.b]) < 1e-9 for x in tree)
    label = {x.symbol: x.cluster for x in graph.clusters(rows, graph.RECIPES["network"]).collect() if x.week == week(11)}

    def modularity(part):
        w = {(x.a, x.b): 1 / (1 + x.distance) for x in tree}
        total, degree = sum(w.values()), [sum(v for e, v in w.items() if j in e) for j in range(8)]
        inner = sum(v for (a, b), v in w.items() if part[a] == part[b]) / total
        return inner - sum((sum(degree[j] for j in range(8) if part[j] == c) / (2 * total)) ** 2 for c in set(part.values()))

    splits = [{j: (m >> j) & 1 for j in range(8)} for m in range(128)]
    assert modularity(label) >= 0.85 * max(map(modularity, splits))  # the method climbs, and may stop short of the best
    found = [x for x in graph.network_panel(rows.withColumn("mom", F.col("ret")), graph.RECIPES["network"], "mom").collect() if x.week == week(11)]
    for x in found:
        others = [r[11, j] for j in range(8) if label[j] != label[x.symbol]]
        own = pd.Series({j: r[11, j] for j in range(8) if label[j] == label[x.symbol]}).rank()
        z = (own - own.mean()) / own.std() if len(own) > 1 else own * 0
        assert abs(x.relative - (r[11, x.symbol] - np.mean(others))) < 1e-9 and abs(x.within - z[x.symbol]) < 1e-9
    share = pd.Series(label).value_counts(normalize=True)
    assert abs(found[0].entropy + (share * np.log(share + 1e-12)).sum()) < 1e-9


def test_kmeans_parts_blocks(spark):
    random = np.random.default_rng(8)
    f = random.normal(size=(26, 5))
    rows = [(week(k), j, float(f[k, j // 3] + 0.05 * random.normal())) for k in range(26) for j in range(15)]
    got = {x.symbol: x.cluster for x in matrix.svd_kmeans(spark.createDataFrame(rows, "week date, symbol long, ret double")).collect() if x.end == week(25)}
    assert [got[j] for j in range(15)] == [j // 3 for j in range(15)]


@pytest.mark.parametrize("dense", [8000, 100])
def test_axes_take_few_rounds(monkeypatch, dense):
    """Noise with gaps, whose leading values lie close together: the axes are those of the whole matrix, after few products with it."""
    random = np.random.default_rng(4)
    values = np.where(random.random((26, 500)) < 0.2, np.nan, random.normal(size=(26, 500)))
    weight = random.integers(1, 4, 500).astype(float)
    monkeypatch.setattr(matrix, "COLUMNS", 60)
    rounds = []
    qr = np.linalg.qr
    monkeypatch.setattr(np.linalg, "qr", lambda x: rounds.append(x.shape) or qr(x))
    got = matrix.leading_axes(values, weight, 8, dense)
    whole = pd.DataFrame(values).corr(min_periods=2).to_numpy()
    s, u = np.linalg.eigh(np.sqrt(weight)[:, None] * whole * np.sqrt(weight))
    top = np.argsort(-np.abs(s))[:8]
    want = u[:, top] * np.abs(s[top]) / np.sqrt(weight)[:, None]
    assert 1 < len(rounds) < 40 and np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_unit_root_statistic(spark):
    random = np.random.default_rng(5)
    e = random.normal(size=300)
    rows = [("walk", week(k), float(x)) for k, x in enumerate(np.cumsum(e))] + [("noise", week(k), float(x)) for k, x in enumerate(e)]
    got = {r.name: r for r in matrix.unit_root(spark.createDataFrame(rows, "name string, week date, v double"), ["name"], "v").collect()}
    assert got["walk"].statistic > -2.9 > -7 > got["noise"].statistic
    k, d = got["noise"].lags, np.diff(e)  # with the chosen lags over all weeks, by normal equations
    y = d[k:]
    a = np.column_stack([np.ones(len(y)), e[k:-1], *(d[k - j : len(d) - j] for j in range(1, k + 1))])
    b = np.linalg.solve(a.T @ a, a.T @ y)
    s2 = ((y - a @ b) ** 2).sum() / (len(y) - a.shape[1])
    assert abs(got["noise"].statistic - b[1] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1])) < 1e-6 and got["noise"].p < 1e-4 and got["walk"].p == matrix.unit_root_p(got["walk"].statistic) > 0.05
    # The published critical values of a test with a constant, and the ends of the response surface.
    assert all(abs(matrix.unit_root_p(t) - p) < 0.002 for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10))) and matrix.unit_root_p(-20) == 0 and matrix.unit_root_p(3) == 1
    ends = [matrix.unit_root_p(t) for t in np.linspace(-6, 2.7, 200)]
    assert all(b - a > -1e-3 for a, b in zip(ends, ends[1:]))


def test_quantile_points_and_rolling_errors(spark):
    x = np.random.default_rng(2).normal(size=80)
    s = spark.createDataFrame([("f", week(k), float(v)) for k, v in enumerate(x)], "name string, week date, v double")
    got = stats.quantile_points(s, ["name"], "v").orderBy("i").collect()
    want = [NormalDist().inv_cdf(i / 81) * x.std(ddof=1) + x.mean() for i in range(1, 81)]
    assert np.allclose([r.value for r in got], np.sort(x)) and np.allclose([r.normal for r in got], want, atol=2e-6)
    t = {r.week: (r.mean, r.t) for r in stats.rolling_newey_west(s, ["name"], "v").collect()}
    assert t[week(25)] == (None, None)
    for k in (26, 50, 79):
        part = x[k - 26 : k]
        assert abs(t[week(k)][0] - part.mean()) < 1e-12 and abs(t[week(k)][1] - part.mean() / pricing.newey_west_se(part)) < 1e-8


def test_boosted_regimes(spark):
    random = np.random.default_rng(7)
    x = random.normal(size=(400, 6))
    y = (x[:, 3] > -0.4).astype(int) + (x[:, 3] > 0.4)
    p = regime.boosted_probabilities(x[:300], y[:300], x[300:])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[300:]).mean() > 0.9
    known = spark.createDataFrame([(week(k), *map(float, x[k])) for k in range(400)], "week date, " + ", ".join(f"{c} double" for c in regime.FEATURES))
    targets = spark.createDataFrame([(week(k), regime.CLASSES[y[k]]) for k in range(400)], "week date, label string")
    got = regime.probabilities(known, targets).collect()
    assert sum(r.split == "train" for r in got) == 280 and np.mean([max(regime.CLASSES, key=lambda c: r[f"p_{c}"]) == r.target for r in got if r.split == "test"]) > 0.9
    few = regime.probabilities(known.limit(20), targets).collect()
    assert all((r.p_RiskOff, r.p_Neutral, r.p_RiskOn) == (0, 1, 0) for r in few)
    spine = regime.on_weeks(spark.createDataFrame([(week(k),) for k in (0, 999)], "week date"), regime.probabilities(known, targets)).orderBy("week").collect()
    assert spine[1].p_Neutral == 1 and spine[1].regime == "Neutral" and abs(spine[0].p_RiskOff + spine[0].p_Neutral + spine[0].p_RiskOn - 1) < 1e-9


@pytest.fixture(scope="module")
def candidates(spark):
    random = np.random.default_rng(12)
    r = random.normal(0, 0.03, (90, 20))
    price, mcap = 100 * np.cumprod(1 + r, 0), random.uniform(1, 9, (90, 20))
    rows = [(week(k), j, float(r[k, j]), float(price[k, j]), float(mcap[k, j]), float(r[k + 1, j]) if k < 89 else None, float(r[k].mean())) for k in range(90) for j in range(20)]
    return r, spark.createDataFrame(rows, "week date, symbol long, ret double, price double, mcap double, fwd double, market double")


def test_grid_and_tests_of_candidates(candidates):
    r, rows = candidates
    made, names = search.grid(rows)
    assert len(names) == len(set(names)) == 110
    last = {x.symbol: x for x in made.filter(F.col("week") == week(89)).collect()}
    absolute = np.abs(r[86:90]).mean(0)
    assert np.allclose([last[j].attention_4w for j in range(20)], absolute / np.median(absolute)) and np.allclose([last[j].age for j in range(20)], 89)
    m = r.mean(1)
    beta = [((r[82:, j] * m[82:]).mean() - r[82:, j].mean() * m[82:].mean()) / m[82:].var(ddof=1) for j in range(20)]
    assert np.allclose([last[j].beta_8w for j in range(20)], beta)
    series = search.candidates(made, ["vol_4w", "ret_1w"])
    got = {x.factor: x for x in search.screened(series).collect()}
    spread = []
    for k in range(3, 89):
        order = np.argsort(r[k - 3 : k + 1].std(0, ddof=1))
        spread.append(r[k + 1, order[-6:]].mean() - r[k + 1, order[:6]].mean())
    spread = np.array(spread)
    assert len(got) == 4 and abs(got["vol_4w+"].t - spread.mean() / pricing.newey_west_se(spread)) < 1e-6 and abs(got["vol_4w+"].t + got["vol_4w-"].t) < 1e-9
    p = {f: 2 * (1 - NormalDist().cdf(abs(x.t))) for f, x in got.items()}
    order = sorted(p, key=lambda f: (p[f], f))
    q = np.minimum.accumulate([p[f] * 4 / (i + 1) for i, f in enumerate(order)][::-1])[::-1]
    assert np.allclose([got[f].q for f in order], np.minimum(q, 1), atol=1e-5)


def test_measures_side_by_side_equal_windows(spark, monkeypatch):
    """Measures of groups of symbols are those of window functions, with unknown returns, flat series and symbols of few rows; no measure
    is a window's, whose frames are added up anew for each row, and all of them never leave for their weeks at once."""
    monkeypatch.setattr(search, "PART", 4)
    random = np.random.default_rng(21)
    rows = []
    for j in range(14):
        price = 50.0
        for k in range(0, 70 if j else 3):
            if k and random.random() < 0.1:
                continue
            r = None if k == 0 or random.random() < 0.03 else 0.0 if j == 1 else float(random.normal(0, 0.1)) if j > 2 else abs(float(random.normal(0, 0.1)))
            price *= 1 + (r or 0.0)
            rows.append((week(k), j, r, 0.0 if random.random() < 0.02 else price, float(random.uniform(1, 9)), float(random.normal()), None if k == 0 else float(np.sin(k))))
    df = spark.createDataFrame(rows, "week date, symbol long, ret double, price double, mcap double, fwd double, market double")
    made, names = search.grid(df)
    assert "Window" not in str(made._jdf.queryExecution().optimizedPlan())
    r, p, m = F.col("ret"), F.col("price"), F.col("market")
    by = Window.partitionBy("symbol").orderBy("week")
    want = {"age": F.datediff("week", F.min("week").over(Window.partitionBy("symbol"))) / 7, "log_mcap": F.log("mcap")}
    for n in (1, 3, 8, 12):
        want |= {f"ret_{n}w": F.try_divide(p, F.lag("price", n).over(by)) - 1, f"vol_{n}w": rolling.sd(r, n), f"maxret_{n}w": rolling.highest(r, n), f"minret_{n}w": rolling.lowest(r, n), f"skew_{n}w": rolling.skew_adjusted(r, n, max(n, 3)), f"absret_{n}w": rolling.mean(F.abs(r), n)}
        want |= {f"up_{n}w": rolling.up_frequency(r, n), f"tohigh_{n}w": F.try_divide(p, rolling.highest(p, n)) - 1, f"tolow_{n}w": F.try_divide(p, rolling.lowest(p, n)) - 1, f"dmcap_{n}w": F.try_divide(F.col("mcap"), F.lag("mcap", n).over(by)) - 1}
    for n in (8, 12):
        want |= {f"beta_{n}w": rolling.beta_mixed(r, m, n), f"upvol_{n}w": rolling.sd(F.when(r > 0, r), n), f"downvol_{n}w": rolling.sd(F.when(r < 0, r), n)}
    want = {x: c for x, c in want.items() if x in names}
    plain = df.withColumns({f"{x}_": c for x, c in want.items()}).withColumn("e", r - F.col("beta_8w_") * m)
    plain = plain.withColumns({"idvol_8w_": rolling.sd(F.col("e"), 8), "attention_8w_": F.try_divide("absret_8w_", F.percentile("absret_8w_", 0.5).over(Window.partitionBy("week")))})
    both = made.join(plain.select("week", "symbol", *(c for c in plain.columns if c.endswith("_"))), ["week", "symbol"]).toPandas()
    assert len(both) == len(rows)
    for x in [*want, "idvol_8w", "attention_8w"]:
        a, b = both[x].to_numpy(float), both[f"{x}_"].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all() and np.allclose(a, b, equal_nan=True, atol=1e-9), x
    monkeypatch.setattr(search, "AT_ONCE", 40)
    monkeypatch.setattr(search, "NAMES", [x for x in names if x.endswith("_4w") or x == "age"])
    asked = []
    zoo = search.factors.zoo
    monkeypatch.setattr(search.factors, "zoo", lambda rows, specs, **how: asked.append(len(specs)) or zoo(rows, specs, **how))
    monkeypatch.setattr(search, "AT_ONCE", 5)
    every = {(x.week, x.factor): x.ret for x in search.all_candidates(df).collect()}
    assert max(asked) <= 5 and every == {(x.week, x.factor): x.ret for x in search.candidates(made, search.NAMES).collect()} and len(every) > 500


def test_prices_of_candidates(spark, candidates):
    r, rows = candidates
    made, _ = search.grid(rows)
    series = search.candidates(made, ["vol_4w", "minret_4w", "maxret_4w"])
    base = series.filter("factor = 'maxret_4w+'").select("week", F.lit("BASE").alias("factor"), "ret")
    windows = spark.createDataFrame([("Full", week(0), week(89)), ("IS", week(0), week(50))], "window string, lo date, hi date")
    returns = rows.select("week", "symbol", "ret")
    prices = search.priced(returns, base, series, windows, 40)
    got = {(x.candidate, x.window): x for x in prices.collect()}
    assert {c for c, _ in got} == {"vol_4w+", "vol_4w-", "minret_4w+", "minret_4w-"}  # a twin of the base factor is left out
    assert all(abs(got["vol_4w+", w].premium + got["vol_4w-", w].premium) < 1e-15 and got["vol_4w+", w].low == -got["vol_4w-", w].high for w in ("Full", "IS"))
    wide = series.toPandas().pivot(index="week", columns="factor", values="ret")
    for w, last in (("Full", 89), ("IS", 50)):
        f = wide.loc[[x for x in wide.index if x <= week(last)], ["maxret_4w+", "vol_4w+"]]
        want = plain_three_pass(r[[(x - week(0)).days // 7 for x in f.index]], f.to_numpy(float))
        assert_premia(want, 1, got["vol_4w+", w])
    rho = np.corrcoef(wide["vol_4w+"].dropna(), wide["maxret_4w+"].dropna())[0, 1]
    assert got["vol_4w+", "Full"].nearest == "BASE" and abs(got["vol_4w+", "Full"].rho - rho) < 1e-9
    tests = search.tested(series, prices.filter("`window` = 'Full'"), strict=0.5, bar=0.1)
    found = {x.candidate: x for x in tests.collect()}
    p = {c: 2 * (1 - NormalDist().cdf(abs(got[c, "Full"].t))) for c in found}
    assert len(found) == 4 and all(abs(x.p - p[c]) < 1e-5 and x.bonferroni == (p[c] * 4 <= 0.05) and x.passes_strict == (abs(x.t_full) >= 0.5) and abs(x.premium_full - 52 * got[c, "Full"].premium) < 1e-12 for c, x in found.items())
    assert abs(found["vol_4w+"].ann_ret - 52 * wide["vol_4w+"].mean()) < 1e-9 and abs(found["vol_4w+"].sharpe - wide["vol_4w+"].mean() / wide["vol_4w+"].std() * 52**0.5) < 1e-9
    chosen = search.shortlist(series, tests, 2)
    assert chosen == [c for c, _ in sorted(((c, -x.t_full) for c, x in found.items() if x.t_full > 0), key=lambda x: x[1])]
    assert search.shortlist(series, tests, 2, twin=0.0) == chosen[:1]
    both = {(x.factor, x.window): x for x in search.joint(returns, base, series, chosen, windows).collect()}
    assert {f for f, _ in both} == {"BASE", *chosen} and {f for (f, _), x in both.items() if x.selected} == set(chosen)
    f = wide[["maxret_4w+", *chosen]].dropna()
    assert_premia(plain_three_pass(r[[(x - week(0)).days // 7 for x in f.index]], f.to_numpy(float)), 1, both[chosen[0], "Full"])


def plain_three_pass(y, f, least=24, most=7):
    """The passes as they are defined, asset by asset and week by week over the whole matrix."""

    def betas(x):
        b, e = {}, {}
        for j in range(y.shape[1]):
            known = ~np.isnan(y[:, j])
            if known.sum() >= max(x.shape[1] + 2, 8, least):
                a = np.column_stack([np.ones(known.sum()), x[known]])
                c = np.linalg.lstsq(a, y[known, j], rcond=None)[0]
                b[j], e[j] = c[1:], np.zeros(len(y))
                e[j][known] = y[known, j] - a @ c
        return np.array([b[j] for j in b]), np.array([e[j] for j in b]).T, [*b]

    def premia(b, use):
        mean = np.array([np.nanmean(y[:, j]) for j in use])
        lam = np.linalg.lstsq(b, mean, rcond=None)[0]
        e, inv = mean - b @ lam, np.linalg.pinv(b.T @ b)
        return lam, np.sqrt(np.diag(inv @ (b.T * e**2) @ b @ inv))

    seen, resid, use = betas(f)
    u, s, v = np.linalg.svd(resid, full_matrices=False)
    t, n = resid.shape
    scores = [np.log(max(((resid - (u[:, :k] * s[:k]) @ v[:k]) ** 2).mean(), 1e-12)) + k * (n + t) / (n * t) * np.log(min(n, t)) for k in range(min(most, len(s)) + 1)]
    k = int(np.argmin(scores))
    hidden = u[:, :k] * s[:k]
    full, _, used = betas(np.hstack([f, hidden / hidden.std(0, ddof=1)]))
    weekly = []
    for row in y:
        known = [i for i, j in enumerate(use) if not np.isnan(row[j])]
        if len(known) >= f.shape[1] + 2:
            weekly.append(np.linalg.lstsq(seen[known], row[[use[i] for i in known]], rcond=None)[0])
    weekly = np.array(weekly)
    lam, error = premia(full, used)
    alone, alone_error = premia(seen, use)
    m = f.shape[1]
    return {"premium": lam[:m], "t": (lam / error)[:m], "premium_alone": alone, "t_alone": alone / alone_error, "fmb_mean": weekly.mean(0), "fmb_t": weekly.mean(0) / [pricing.newey_west_se(x) for x in weekly.T], "n_hidden": k, "n_assets": len(used)}


def assert_premia(want, j, got):
    for c, x in want.items():
        assert np.isclose(x if np.ndim(x) == 0 else x[j], getattr(got, c), rtol=1e-6, atol=1e-10), (c, x, got)


@pytest.mark.parametrize("part, fill", [(4000, "mean"), (7, "carry")])
def test_premia_equal_three_plain_passes(spark, monkeypatch, part, fill):
    """Gaps in returns and factors, symbols with few returns, several parts, keys and shared factors."""
    monkeypatch.setattr(pricing, "PART", part)
    random = np.random.default_rng(17)
    t, n = 70, 40
    f = random.normal(0, 0.02, (t, 4))
    y = f @ random.normal(0, 1, (4, n)) + np.outer(random.normal(0, 0.03, t), random.normal(0, 1, n)) + random.normal(0, 0.01, (t, n))
    y[random.random((t, n)) < 0.2] = np.nan
    y[:60, :3] = np.nan  # too few
    f[random.random((t, 4)) < 0.1] = np.nan
    returns = spark.createDataFrame([(week(k), f"s{j}", float(y[k, j])) for k in range(t) for j in range(n) if not np.isnan(y[k, j])], "week date, symbol string, ret double")
    series = lambda j: [(week(k), float(f[k, j])) for k in range(t) if not np.isnan(f[k, j])]
    shared = spark.createDataFrame([(w, name, x) for j, name in ((0, "a"), (1, "b")) for w, x in series(j)], "week date, factor string, ret double")
    own = spark.createDataFrame([(key, w, "own", x) for j, key in ((2, "p"), (3, "q")) for w, x in series(j)], "candidate string, week date, factor string, ret double")
    got = {(r.candidate, r.window, r.factor): r for r in pricing.premia(returns, own, ["candidate"], shared, [("all", week(0), week(t)), ("late", week(30), week(t))], fill).collect()}
    assert len(got) == 12
    for key, j in (("p", 2), ("q", 3)):
        for window, lo in (("all", 0), ("late", 30)):
            x = pd.DataFrame(f[lo:, [0, 1, j]])
            rows = ~x.isna().all(axis=1)
            x = x[rows].ffill() if fill == "carry" else x[rows]
            want = plain_three_pass(y[lo:][rows], x.fillna(x.mean()).to_numpy())
            for m, name in enumerate(("a", "b", "own")):
                assert_premia(want, m, got[key, window, name])


def test_premia_without_enough(spark):
    returns = spark.createDataFrame([(week(k), j, 0.01 * (k % 3)) for k in range(50) for j in range(3)], "week date, symbol long, ret double")
    factor = spark.createDataFrame([(week(k), "x", 0.01 * (k % 5)) for k in range(50)], "week date, factor string, ret double")
    assert pricing.premia(returns, factor).collect() == []  # fewer symbols than factors and three
    assert pricing.premia(returns, factor.limit(20)).collect() == [] and pricing.premia(returns.limit(0), factor).collect() == [] and pricing.premia(returns, factor.limit(0)).collect() == []


def test_scores_of_many_measures_take_one_aggregate(spark):
    rows = spark.createDataFrame([(week(k), j, float(j * k), float(j)) for k in range(3) for j in range(5)], "week date, symbol long, a double, b double")
    many = xsec.zscores(rows, {"za": ("a", True), "zb": ("b", True)})
    one = xsec.zscore(xsec.zscore(rows, "a", "za"), "b", "zb")
    assert sorted(many.select(*one.columns).collect()) == sorted(one.collect())
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


@pytest.mark.parametrize(("name", "most"), [("xs_zscore", 2), ("target_weights", 2), ("louvain_network_panel", 0), ("signed_factors", 0), ("winsorize", 0)])
def test_plans_scan_the_table_few_times(spark, sf, name, most):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= most


def test_twins_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    assert write_twins(df, str(tmp_path / "t"), top=F.max("k")) == {"rows": 1, "top": 1}
    assert spark.read.parquet(str(tmp_path / "t.parquet")).collect() == df.collect() and spark.read.option("header", True).csv(str(tmp_path / "t.csv")).first().s == "a"
    with pytest.raises(Exception, match="broken"):
        write_twins(df.select("k", F.when(F.col("k") == 1, F.raise_error(F.lit("broken"))).cast("string").alias("s")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).collect() == df.collect() and spark.read.option("header", True).csv(str(tmp_path / "t.csv")).first().s == "a"
    assert write_twins(df.union(df), str(tmp_path / "t"))["rows"] == 2 and spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(Exception, match="none"):  # the second folder is missing: both old ones stay
        replace_folders(spark, [(str(tmp_path / "t.csv"), str(tmp_path / "u.csv")), (str(tmp_path / "none"), str(tmp_path / "t.parquet"))])
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2 and (tmp_path / "t.csv").exists() and not (tmp_path / "u.csv").exists()
    write_manifest(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"k": 1, "s": "a"}'
    with pytest.raises(ValueError):
        write_manifest(df.union(df), str(tmp_path / "n"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns) and got.limit(5).collect() is not None


@pytest.mark.parametrize("step", ["canonical", "premia"])
def test_the_panel_is_read_once(spark, step):
    """However many passes follow, the panel that is given is made once."""
    random = np.random.default_rng(4)
    r = random.normal(size=(40, 30))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(week(k), j, float(r[k, j])) for k in range(40) for j in range(30)], "week date, symbol long, ret double").mapInPandas(count, "week date, symbol long, ret double")
    if step == "canonical":
        market = spark.createDataFrame([(week(k), float(r[k, :9].mean())) for k in range(40)], "week date, u double")
        assert canonical.forward_canonical(rows, market, market.select("week").filter(F.col("week") < week(35)), 1).count() == 40
    else:
        series = spark.createDataFrame([(week(k), "A", float(r[k, :9].mean())) for k in range(40)], "week date, factor string, ret double")
        assert pricing.premia(rows, series).count() == 1
    assert seen.value == 1200
