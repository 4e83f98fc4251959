"""Operators on fixtures with known answers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import evidence_tier, has_category, normal_cdf, number, truthy
from panelforge.operators import factors, graph, panel, portfolio, pricing, stats, xsec
from panelforge.sources import markdown_universe, pending_chunks
from panelforge.sources import payloads as pay

MONDAY = dt.date(2024, 1, 1)


def week(k):
    return MONDAY + dt.timedelta(days=7 * k)


def test_gaps_are_padded_or_left(spark):
    rows = [(week(0), 1, 1.0), (week(1), 1, 2.0), (week(3), 1, 4.0)]
    p = spark.createDataFrame(rows, "week date, symbol long, price double")
    pad = {r.week: r.ret for r in panel.with_returns(p, "pad").collect()}
    none = {r.week: r.ret for r in panel.with_returns(p).collect()}
    assert [pad[week(k)] for k in range(4)] == [None, 1.0, 0.0, 1.0]
    assert [none[week(k)] for k in (0, 1, 3)] == [None, 1.0, 1.0]


def test_flat_week_is_zero_or_null(spark):
    a = spark.createDataFrame([(week(0), 1, 5.0), (week(0), 2, 5.0)], "week date, symbol long, x double")
    a = xsec.zscore(xsec.zscore(a, "x", "z"), "x", "n", flat_to_zero=False)
    assert [(r.z, r.n) for r in a.collect()] == [(0.0, None)] * 2


@pytest.mark.parametrize(("n", "k"), [(15, 4), (25, 8), (35, 10), (45, 14)])
def test_leg_sizes_round_half_to_even(spark, n, k):
    a = spark.createDataFrame([(week(0), i, float(i)) for i in range(n)], "week date, symbol long, x double")
    assert {int(r.k) for r in xsec.legs(a, "x").collect()} == {k}


def test_average_ranks_and_bins_with_ties(spark):
    a = spark.createDataFrame([(week(0), i, x) for i, x in enumerate([1.0, 1.0, 2.0, 3.0, None])], "week date, symbol long, x double")
    assert [r.r for r in a.select("symbol", xsec.average_rank(F.col("x")).alias("r")).orderBy("symbol").collect()] == [1.5, 1.5, 3.0, 4.0, None]
    got = [r.b for r in xsec.quantile_bins(a, "x", "b", [0, 0.25, 0.5, 0.75, 1]).orderBy("symbol").collect()]
    want = pd.qcut(pd.Series([1.0, 1.0, 2.0, 3.0]), 4, labels=False, duplicates="drop").tolist()
    assert got == [*want, None]


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(1).normal(size=60)
    a = spark.createDataFrame([("f", week(k), float(v)) for k, v in enumerate(x)], "name string, week date, v double")
    r = stats.newey_west(a, ["name"], "v").first()
    assert r.n == 60 and abs(r.se - pricing.newey_west_se(x)) < 1e-12 and abs(r.t - x.mean() / r.se) < 1e-9


def test_allocation_is_causal(spark):
    books = {"mispricing": [0.01, 0.02, 0.03, 0.04, -0.02, -0.03, -0.04, -0.05], "core_rank": [-0.02, -0.01, -0.01, 0.0, 0.04, 0.05, 0.06, 0.07], "priced_tilt": [0.0, 0.01, -0.01, 0.0, 0.0, 0.01, -0.01, 0.0]}
    net = spark.createDataFrame([(week(k), b, v) for b, x in books.items() for k, v in enumerate(x)], "week date, book string, net double")
    base = {"mispricing": 0.5, "core_rank": 0.35, "priced_tilt": 0.15}
    p = lambda k: (0.2, 0.2, 0.6) if k < 4 else (0.7, 0.2, 0.1)
    known = spark.createDataFrame([(week(k), *p(k)) for k in range(8)], "week date, off double, neutral double, on double")
    scored = portfolio.trailing_score(net, 3, 2).join(known, "week").withColumn("tilt", portfolio.regime_tilt(F.col("book"), F.col("off"), F.col("neutral"), F.col("on")))
    got = {(r.week, r.book): r.share for r in portfolio.allocate(scored, portfolio.share_of(base)).collect()}
    # The first week by hand: base shares, tilted with confidence 0.5 + 0.5 * 0.6, and 18 % of the raw total at most for the priced book.
    raw = [0.5 * 0.8 * (1 + 0.25 * 0.6 - 0.1 * 0.2), 0.35 * 0.8 * (1 + 0.35 * 0.2), 0.15 * 0.8 * (0.55 + 0.35 * 0.6)]
    raw[2] = min(raw[2], 0.18 * sum(raw))
    assert np.allclose([got[week(0), b] for b in books], np.array(raw) / sum(raw))
    # The fourth week by hand: scores of the three weeks before, blended as they are.
    x = np.array([books[b][:3] for b in books])
    curve = np.cumprod(1 + x, 1)
    score = np.maximum(x.mean(1) / x.std(1, ddof=1), 0) * (1 + (curve / np.maximum.accumulate(curve, 1) - 1).min(1))
    raw = (0.35 * np.array(list(base.values())) + 0.65 * score) * 0.8 * np.array([1.13, 1.07, 0.76])
    raw[2] = min(raw[2], 0.18 * raw.sum())
    assert np.allclose([got[week(3), b] for b in books], raw / raw.sum())
    assert got[week(4), "mispricing"] > got[week(4), "core_rank"]  # its own week's loss is not known yet
    assert got[week(7), "core_rank"] > got[week(7), "mispricing"]
    assert all(abs(sum(got[week(k), b] for b in books) - 1) < 1e-12 for k in range(8))


def test_books_combine(spark):
    w = spark.createDataFrame([(week(0), "m", "A", 0.4), (week(0), "m", "B", -0.2), (week(0), "c", "A", 0.2), (week(0), "c", "C", -0.1)], "week date, book string, symbol string, w double")
    s = spark.createDataFrame([(week(0), "m", 0.75), (week(0), "c", 0.25)], "week date, book string, share double")
    got = {r.symbol: round(r.w, 9) for r in portfolio.combine(w, s).collect()}
    assert got == {"A": 0.35, "B": -0.15, "C": -0.025}


def test_turnover_counts_names_that_leave(spark):
    w = spark.createDataFrame([(week(0), "A", 1.0), (week(1), "B", 1.0), (week(2), "B", 0.5)], "week date, symbol string, w double")
    assert [r.turnover for r in portfolio.turnover(w, []).orderBy("week").collect()] == [0.5, 1.0, 0.25]


def plain_cap(raw, target, cap):
    """The cap by repeated passes over the names that are free."""
    out, left, free = [0.0] * len(raw), min(target, cap * len(raw)), set(range(len(raw)))
    while left > 1e-12 and free:
        total = sum(raw[k] for k in free)
        part = {k: left * raw[k] / total if total > 0 else left / len(free) for k in free}
        over = {k for k in free if part[k] >= cap - 1e-12}
        for k in over or free:
            out[k] = cap if over else part[k]
        if not over:
            break
        left, free = left - cap * len(over), free - over
    return out


def test_capped_allocation_equals_repeated_passes(spark):
    random = np.random.default_rng(4)
    groups = [([8.0, 1.0, 1.0], 1.0, 0.5), ([1.0] * 3, 1.0, 0.2), ([0.0] * 4, 0.6, 0.2), ([5.0, 0.0, 0.0], 0.6, 0.2), ([2.0], 0.1, 0.2), ([3.0, 1.0], 0.0, 0.2)]
    groups += [(random.exponential(1, n).tolist(), float(random.random()), 0.2) for n in random.integers(1, 30, 40)]
    rows = [(g, i, x, t) for g, (raw, t, cap) in enumerate(groups) for i, x in enumerate(raw) if cap == 0.2]
    got = {(r.g, r.symbol): r.w for r in portfolio.capped_allocation(spark.createDataFrame(rows, "g int, symbol int, s double, t double"), ["g"], "s", "t", 0.2, "w").collect()}
    for g, (raw, t, cap) in enumerate(groups):
        if cap == 0.2:
            assert np.allclose([got[g, i] for i in range(len(raw))], plain_cap(raw, t, cap), atol=1e-12), g
    one = spark.createDataFrame([(0, i, x, 1.0) for i, x in enumerate(groups[0][0])], "g int, symbol int, s double, t double")
    assert np.allclose([r.w for r in portfolio.capped_allocation(one, ["g"], "s", "t", 0.5, "w").orderBy("symbol").collect()], [0.5, 0.25, 0.25])


def test_capped_allocation_runs_up_from_the_least_score(spark, capsys):
    """A frame from the current row to the group's end costs the square of a leg's names."""
    rows = spark.createDataFrame([(0, 1, 1.0, 1.0)], "g int, symbol int, s double, t double")
    portfolio.capped_allocation(rows, ["g"], "s", "t", 0.5, "w").explain(True)
    plan = capsys.readouterr().out
    assert "currentrow$(), unboundedfollowing" not in plan and "unboundedpreceding$(), currentrow" in plan


def plain_weights(signals, exposure, rules):
    """Week by week with dictionaries: legs, raw weights, caps, and the move from the weights held before."""
    held, out = None, []
    for w in sorted({s[0] for s in signals}):
        names = sorted(((x, n, v) for k, n, x, v in signals if k == w and x is not None))
        if len(names) < rules.min_names:
            continue
        frac, gross, share = exposure[w]
        legs = lambda target, cap: min(len(names), max(1, int(np.ceil(len(names) * frac)), int(np.ceil(target / cap))))  # noqa: E731, B023
        low, high = names[: legs(gross * (1 - share), rules.short_cap)], names[-legs(gross * share, rules.long_cap) :]
        high = [x for x in high if x not in low]
        middle = float(np.median([v for *_, v in names if v is not None]))
        vol = lambda v: max(v if v is not None else middle, rules.least_vol)  # noqa: E731, B023
        goal = {n: 0.0 for _, n, _ in names}
        for leg, sign, power, target, cap in ((high, 1, rules.long_power, gross * share, rules.long_cap), (low, -1, rules.short_power, gross * (1 - share), rules.short_cap)):
            if leg:
                edge = min(x for x, *_ in leg) if sign > 0 else max(x for x, *_ in leg)
                raw = [(abs(x - edge) + 1e-6) ** power / vol(v) for x, _, v in leg]
                goal |= {n: sign * y for (_, n, _), y in zip(leg, plain_cap(raw, target, cap))}
        new = goal
        if held is not None:
            moved = sum(abs(goal.get(n, 0) - held.get(n, 0)) for n in goal.keys() | held.keys()) / 2
            if moved > rules.most_turnover:
                new = {n: held.get(n, 0) + rules.most_turnover / moved * (goal[n] - held.get(n, 0)) for n in goal}
        held = new
        out += [(w, n, y) for n, y in new.items() if y]
    return out


def test_weights_equal_plain_construction(spark):
    random = np.random.default_rng(0)
    signals = []
    for k in range(9):
        for i in range(40 if k != 4 else 10):  # a thin week has no weights and is no step
            if random.random() < 0.9:
                signals.append((week(k), f"s{i:02d}", None if random.random() < 0.05 else float(np.round(random.normal(), 1)), None if random.random() < 0.1 else float(random.exponential(0.1))))
    exposure = {week(k): (0.25, float(random.uniform(0.3, 0.9)), float(random.uniform(0.6, 0.9))) for k in range(9)}
    s = spark.createDataFrame([("b", *x) for x in signals], "book string, week date, symbol string, signal double, vol double")
    e = spark.createDataFrame([(w, "b", *x) for w, x in exposure.items()], "week date, book string, frac double, gross double, long_share double")
    want = {(w, n): y for w, n, y in plain_weights(signals, exposure, portfolio.Rules())}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # weeks cross batches
    got = {(r.week, r.symbol): r.w for r in portfolio.limit_turnover(portfolio.target_weights(s, e)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    w = spark.createDataFrame([("b", *k, y) for k, y in got.items()], "book string, week date, symbol string, w double")
    assert max(r.turnover for r in portfolio.turnover(w, ["book"]).collect()[1:]) < 1


def test_a_book_sorts_rows_of_many_names(spark, monkeypatch):
    """What a book's task sorts and reads is a row for many names of a week, and targets are read once."""
    monkeypatch.setattr(portfolio, "SIDE_BY_SIDE", 3)
    random = np.random.default_rng(1)
    rows = [(b, week(k), j, float(random.normal()) / 8) for b in "ab" for k in range(6) for j in range(8) if random.random() < 0.8]
    found = portfolio.limit_turnover(spark.createDataFrame(rows, "book string, week date, symbol long, w double"))
    plan = str(found._jdf.queryExecution().optimizedPlan())
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression") < plan.index("FlatMapGroupsInArrow")
    want = {}
    for b in "ab":
        held = {}
        for k in range(6):
            goal = {j: w for c, t, j, w in rows if c == b and t == week(k)}
            moved = sum(abs(goal.get(j, 0) - held.get(j, 0)) for j in goal.keys() | held.keys()) / 2
            share = min(1.0, 0.45 / moved) if k else 1.0
            held = {j: held.get(j, 0) + share * (w - held.get(j, 0)) for j, w in goal.items()}
            want |= {(b, week(k), j): w for j, w in held.items() if w}
    got = {(r.book, r.week, r.symbol): r.w for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_variants_in_one_pass_equal_each_by_itself(spark):
    """Combined weights of variants, books with gaps and weeks of their own, a missing return: sums side by side are those of the
    variants' rows, which no plan makes."""
    random = np.random.default_rng(2)
    books, variants, n = ["a", "b", "c"], ["x", "y", "x, tilt"], 6
    held = spark.createDataFrame([(b, week(k), j, float(random.normal())) for b in books for k in range(n) if (b, k) != ("a", 2) and k != 4 for j in range(9) if random.random() < 0.7], "book string, week date, symbol long, w double")
    share = spark.createDataFrame([(v, week(k), b, 0.0 if v == "y" and b == "c" else float(random.random())) for v in variants for k in range(n) for b in books], "variant string, week date, book string, share double")
    ahead = spark.createDataFrame([(week(k), j, None if random.random() < 0.2 else float(random.normal())) for k in range(n) for j in range(10)], "week date, symbol long, fwd double")
    found = portfolio.combined_backtest(held, share, ahead, variants, books)
    want = portfolio.backtest(portfolio.combine(held, share, ("variant",)), ahead, ["variant"])
    assert found.columns == want.columns and found.dtypes == want.dtypes
    got = {(r.variant, r.week): r for r in found.collect()}
    rows = want.collect()
    assert len(rows) == len(got) == 15
    for r in rows:
        assert np.allclose([x for x in r[2:]], [x for x in got[r.variant, r.week][2:]], atol=1e-12)
    plan = str(found._jdf.queryExecution().optimizedPlan())
    assert plan.index("Generate") < plan.index("Aggregate")  # variants become rows of a week's sums only


def test_exposures_by_regime(spark):
    p = spark.createDataFrame([(week(0), 0.2, 0.3, 0.5)], "week date, p_RiskOff double, p_Neutral double, p_RiskOn double")
    got = {r.book: r for r in portfolio.exposures(p).collect()}
    assert abs(got["mispricing"].gross - (0.5 * 0.90 + 0.3 * 0.72 + 0.2 * 0.52)) < 1e-12 and abs(got["core_rank"].long_share - (0.5 * 0.90 + 0.3 * 0.75 + 0.2 * 0.70)) < 1e-12


def test_measures_side_by_side_equal_one_at_a_time(spark, monkeypatch):
    """Legs and rank correlations of many measures in one pass, with ties, unknown values and weeks of few names."""
    monkeypatch.setattr(xsec, "SIDE_BY_SIDE", 2)
    random = np.random.default_rng(5)
    rows = [(week(k), s, None if random.random() < 0.1 else float(random.normal()), *(None if random.random() < 0.2 else float(random.integers(0, 6)) for _ in "abc")) for k in range(6) for s in range(8 + 3 * k)]
    df = spark.createDataFrame(rows, "week date, symbol long, fwd double, a double, b double, c double")
    got = {(r.week, r.factor): r for r in factors.zoo(df, {"A": ("a", False), "B": ("b", True), "C": ("c", False)}).collect()}
    ics = {(r.week, r.factor): r for r in xsec.information_coefficients(df, {"A": "a", "B": "b", "C": "c"}, "fwd").collect()}
    seen = 0
    for f, x, low in (("A", "a", False), ("B", "b", True), ("C", "c", False)):
        for r in factors.long_short(df, x, long_low=low).collect():
            assert np.isclose(got[r.week, f].ret, r.ret) and got[r.week, f].n == r.n
            seen += 1
        for r in xsec.information_coefficient(df, x, "fwd").collect():
            assert np.isclose(ics[r.week, f].ic, r.ic) and ics[r.week, f].n == r.n
    assert seen == len(got) == len(ics)


def test_tree_of_equal_series_is_that_of_the_whole_matrix():
    """Copies of a series, ties and gaps: a row of distances for each different series gives the tree of the matrix."""
    random = np.random.default_rng(8)
    for recipe in graph.RECIPES.values():
        x = random.integers(0, 4, (13, 12)).astype(float)
        x[random.random(x.shape) < 0.1] = np.nan
        x = x[:, random.integers(0, 12, 50)]
        wide = pd.DataFrame(x, columns=range(50))
        names, tree, rho, d = graph._graph(wide, recipe)
        used = wide.iloc[: len(wide) - (not recipe.inclusive)][names]
        ranks = (used.fillna(0.0) if recipe.nulls_to_zero else used).rank()
        whole = ranks.corr(min_periods=3).clip(-recipe.clip, recipe.clip).to_numpy().round(9)
        far = np.sqrt(np.maximum(recipe.factor * (1 - whole), 0.0))
        same = np.array([[ranks.iloc[:, i].equals(ranks.iloc[:, j]) for j in range(len(names))] for i in range(len(names))])
        assert np.allclose(rho, whole[tree[:, 0], tree[:, 1]], atol=1e-8)
        want = graph.spanning_tree(np.where(same & (recipe.clip == 1), 0.0, far))
        assert np.isclose(sum(far[a, b] for a, b in want), d.sum(), atol=1e-6) and len(want) == len(tree), recipe


def test_tree_comes_by_levels_and_tiles_as_from_all_pairs(monkeypatch):
    """Edges are those that all pairs give in order of closeness, of equals the smallest names first, whatever the tiles and however
    few pairs are held; and no pair is looked at once for each name that the tree takes, as a tree that grows by a row does."""
    random = np.random.default_rng(3)
    for tile, held in (((256, 2048), 4_000_000), ((7, 11), 50)):
        monkeypatch.setattr(graph, "TILE", tile)
        monkeypatch.setattr(graph, "HELD", held)
        for recipe in graph.RECIPES.values():
            x = np.where(random.random((13, 90)) < 0.3, random.integers(0, 3, (13, 90)), random.normal(size=(13, 90)))
            x[random.random(x.shape) < 0.15] = np.nan
            wide = pd.DataFrame(x[:, random.integers(0, 90, 140)], columns=range(140))
            names, tree, rho, d = graph._graph(wide, recipe)
            used = wide.iloc[: len(wide) - (not recipe.inclusive)][names]
            ranks = (used.fillna(0.0) if recipe.nulls_to_zero else used).rank()
            whole = ranks.corr(min_periods=3).clip(-recipe.clip, recipe.clip).to_numpy().round(9)
            far = np.sqrt(np.maximum(recipe.factor * (1 - whole), 0.0))
            label, want = list(range(len(names))), []
            for _, i, j in sorted((far[i, j], i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if far[i, j] > 0):
                if label[i] != label[j]:
                    want.append((i, j))
                    label = [label[i] if c == label[j] else c for c in label]
            assert len(names) > 40 and sorted(map(tuple, tree.tolist())) == sorted(want), recipe
            assert np.allclose(d, [far[i, j] for i, j in tree]) and np.allclose(rho, [whole[i, j] for i, j in tree])
    monkeypatch.setattr(graph, "TILE", (256, 2048))
    z = random.normal(size=(3000, 11))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    seen = []

    def near(i, j):
        seen.append((len(i), len(j)))
        return z[i] @ z[j].T

    a, _, _ = graph.spanning_forest(3000, near, lambda i, j: (z[i] * z[j]).sum(1))
    assert len(a) == 2999 and len(seen) < 1500 and sum(i * j for i, j in seen) < 1.5 * 3000 * 3000 and max(i * j for i, j in seen) <= 256 * 2048


def test_spanning_tree_and_communities():
    d = np.full((6, 6), 2.0)
    for a, b in ((0, 1), (1, 2), (3, 4), (4, 5)):
        d[a, b] = d[b, a] = 1.0
    d[2, 3] = d[3, 2] = 1.9
    assert sorted(graph.spanning_tree(d)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert graph.communities(6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 0.1)]) == [0, 0, 0, 1, 1, 1]


def test_one_factor_is_found():
    random = np.random.default_rng(2)
    x = np.outer(random.normal(size=80), random.normal(size=30)) + 0.05 * random.normal(size=(80, 30))
    x = x - x.mean(0)
    f = pricing.hidden_factors(x @ x.T, 30, 7)
    assert f.shape == (80, 1) and abs(f.std(ddof=1) - 1) < 1e-9


def test_normal_cdf_and_corrections(spark):
    a = spark.createDataFrame([("a", 1.96), ("b", 3.5), ("c", 0.1)], "k string, t double")
    got = {r.k: r for r in stats.corrections(a, "t", ["k"]).collect()}
    assert abs(got["a"].p - 0.0499958) < 1e-5 and got["b"].bonferroni and not got["a"].bonferroni
    assert abs(got["a"].q - 1.5 * got["a"].p) < 1e-9
    assert abs(a.select(normal_cdf(F.lit(-1.0))).first()[0] - 0.1586553) < 1e-6


def test_payload_flattening(spark):
    text = """[{"data": {"dates": ["2024-01-01", "2024-01-02"], "symbols": {"btc": {"fees": [1.5, "x", {"time": "2024-01-03T5", "value": 4, "chain": "c1"}], "dau": [{"date": "2024-02-01T00", "val": 7}],
      "tvl": 9, "users": {"web": [1, {"val": 2}], "app": 3}, "none": null}}}}, {"timestamps": ["2024-05-05T00:00"], "symbols": {"eth": {"fees": [null, {"timestamp": "2024-06-06", "val": null}]}}}, 5]"""
    got = {tuple(r) for r in pay.metric_series(spark.createDataFrame([(text,)], "payload string")).select("symbol", "metric", "date", "dimension", "value").collect()}
    assert got == {
        ("BTC", "fees", "2024-01-01", None, 1.5), ("BTC", "fees", "2024-01-02", None, None), ("BTC", "fees", "2024-01-03", "c1", 4.0), ("BTC", "dau", "2024-01-01", None, 7.0), ("BTC", "tvl", None, None, 9.0),
        ("BTC", "users", "2024-01-01", "web", 1.0), ("BTC", "users", "2024-01-02", "web", 2.0), ("BTC", "users", None, "app", 3.0), ("BTC", "none", None, None, None), ("ETH", "fees", "2024-05-05", None, None), ("ETH", "fees", "2024-06-06", None, None),
    }
    ticks = spark.createDataFrame([("A", [[0.0, 1.0]], [[0.0, 2.0], [1000.0, 3.0]], [])], "symbol string, prices array<array<double>>, market_caps array<array<double>>, total_volumes array<array<double>>")
    assert sorted((r.price, r.mcap, r.volume) for r in pay.merged_ticks(ticks).collect() if r.price) == [(1.0, 2.0, None)]


def test_chain_totals_prefer_the_whole(spark):
    rows = [(week(0), "ALL", 5.0), (week(0), "a", 1.0), (week(0) + dt.timedelta(1), "all", 7.0), (week(1), "a", 2.0)]
    got = [tuple(r) for r in panel.chain_totals(spark.createDataFrame(rows, "day date, chain string, v double"), ["v"]).collect()]
    assert got == [(week(0), 7.0)]


def test_grades_and_verdicts(spark):
    cases = [  # premium t, signed correlations' t in and out, second-order dominance, dominated, market, structure
        ((2.0, 2.0, 1.5, False, False, False, False), "Confirmed"), ((2.0, -2.0, -1.2, False, False, False, False), "Confirmed"), ((-1.7, 0.5, 0.1, False, False, False, False), "Priced risk"), ((1.0, 1.7, 1.0, False, False, False, False), "Tradable signal"),
        ((1.4, 0.0, 0.0, False, False, False, False), "Suggestive"), ((0.0, None, None, True, False, False, False), "Suggestive"), ((0.0, 1.1, 1.0, False, False, False, False), "Suggestive"), ((0.0, None, None, False, True, False, False), "Not supported"),
        ((0.0, None, None, False, False, False, False), "Economic-only"), ((0.0, -1.7, 0.5, False, False, False, False), "Not supported"), ((0.1, 0.1, 0.1, False, False, False, False), "Not supported"), ((9.0, 9.0, 9.0, True, False, False, True), "Structure"), ((0.0, None, None, False, False, True, False), "Priced risk"),
    ]
    a = spark.createDataFrame([(k, *x) for k, (x, _) in enumerate(cases)], "k int, p double, i double, o double, a boolean, d boolean, m boolean, s boolean")
    got = {r.k: r.g for r in a.select("k", stats.grade(*(F.col(c) for c in "pioadms")).alias("g")).collect()}
    assert [got[k] for k in range(len(cases))] == [g for _, g in cases] and set(got.values()) == set(stats.GRADES)
    v = spark.createDataFrame([(1.9, 3.0, 1.0, 1.0), (2.0, 1.0, -1.0, -2.0), (2.0, 1.0, -1.0, 2.0), (2.0, 0.9, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r.v for r in v.select(stats.verdict(*(F.col(c) for c in "abcd")).alias("v")).collect()] == ["weak", "robust", "in_sample_only", "in_sample_only", "weak"]


def test_scalar_functions(spark):
    a = spark.createDataFrame([(0.0, 3.0, "x", ["Meme coins"])], "a double, b double, s string, c array<string>")
    r = a.select(truthy(F.col("a"), F.col("b")).alias("t"), number(F.col("s")).alias("n"), has_category(F.col("c"), ["meme"]).alias("h"), evidence_tier(F.lit(None), F.lit(1), F.lit(None), F.col("b")).alias("e")).first()
    assert (r.t, r.n, r.h, r.e) == (3.0, None, True, "2_price_x_realsupply")


def test_markdown_universe(spark, tmp_path):
    (tmp_path / "u.md").write_text("# Layer 1\n| Rank | Coin | Symbol |\n|---|---|---|\n| 1 | Alpha | alp |\n## Meme\n| 2 | Beta | bet |\n| 3 | Again | ALP |\n")
    got = [tuple(r) for r in markdown_universe(spark, str(tmp_path / "u.md")).collect()]
    assert got == [("Layer 1", 1, "Alpha", "ALP"), ("Meme", 2, "Beta", "BET")]


def test_last_chunk_is_always_pending(spark):
    wanted, done = (spark.createDataFrame([(k,) for k in x], "chunk int") for x in ([1, 2, 3], [1, 2, 3]))
    assert [r.chunk for r in pending_chunks(wanted, done).collect()] == [3]


def test_weekly_stream(spark, sf, tmp_path):
    from panelforge.streaming import run_once, weekly_totals

    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = weekly_totals(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    got = {(r.week, r.event_type): r.n for r in run_once(stream, "weekly", str(tmp_path / "c")).collect()}
    want = {(r.week, r.event_type): r.n for r in source.groupBy(panel.week_of("ts").alias("week"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_weekly_evidence_is_one_pass_of_three(spark):
    """Returns, correlations and the market of a week, of rows that meet once, are those of their own passes."""
    random = np.random.default_rng(3)
    rows = [(MONDAY + dt.timedelta(7 * k), j, *(None if random.random() < 0.1 else float(v) for v in random.normal(size=3))) for k in range(3) for j in range(15)]
    a = spark.createDataFrame(rows, "week date, symbol long, fwd double, p double, q double")
    specs = {"P": ("p", True), "Q": ("q", False)}
    found = factors.weekly_evidence(a, specs, 9)
    assert str(found._jdf.queryExecution().executedPlan()).count("FlatMapGroupsInArrow") == 1
    got = {(r.week, r.what, r.factor): (r.value, r.n) for r in found.collect()}
    want = {(r.week, "ret", r.factor): (r.ret, r.n) for r in factors.zoo(a, specs).collect()}
    want |= {(r.week, "ic", r.factor): (r.ic, r.n) for r in xsec.information_coefficients(a, {"P": "p", "Q": "q"}, "fwd").collect()}
    want |= {(r.week, "market", None): (r.m, r.n) for r in a.filter("fwd is not null").groupBy("week").agg(F.avg("fwd").alias("m"), F.count("*").alias("n")).collect()}
    assert got.keys() == want.keys() and len(got) > 9 and all(abs(got[k][0] - want[k][0]) < 1e-8 and got[k][1] == want[k][1] for k in want)
