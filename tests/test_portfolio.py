"""Portfolios, stress, tuning, validation, models and decisions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel.operators import cleaning, decision, factors, linear, ml, portfolio, registry, research, stress, tuning, validation

D = dt.date
MONTHS = [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31)]


def scores(spark, table, rets):
    rows = [(m, s, table[i].get(s), rets[i].get(s)) for i, m in enumerate(MONTHS[: len(table)]) for s in sorted(set(table[i]) | set(rets[i]))]
    return spark.createDataFrame(rows, "month_end date, symbol string, score double, fwd_1m_ret double")


def wide(df, value):
    return {(r["month_end"], r["strategy"]): r[value] for r in df.collect()}


def test_long_short_return(spark):
    s = scores(spark, [{"a": 3.0, "b": 2.0, "c": 1.0}] * 3, [{"a": 0.1, "b": 0.0, "c": -0.05}] * 3)
    got = wide(portfolio.portfolio_returns(portfolio.weights(s, 1 / 3), s), "ret")
    assert got[MONTHS[0], "long_short"] == pytest.approx(0.15) and got[MONTHS[0], "short_only"] == pytest.approx(-0.05)


def test_benchmark_of_names_with_a_return(spark):
    rows = [(D(2020, 1, 31), "a", 1.0, 0.1), (D(2020, 1, 31), "b", None, 0.3), (D(2020, 1, 31), "c", 2.0, None), (D(2020, 2, 29), "a", 1.0, None)]
    s = spark.createDataFrame(rows, "month_end date, symbol string, score double, fwd_1m_ret double")
    w = portfolio.weights(s, 0.5)
    of = lambda kind: {r["month_end"].month: r["ret"] for r in portfolio.portfolio_returns(w, s, benchmark=kind).where("strategy = 'benchmark_ew'").collect()}
    assert of("scores") == pytest.approx({1: 0.05, 2: 0.0}) and of("returns") == pytest.approx({1: 0.2, 2: 0.0})
    with pytest.raises(ValueError, match="neither"):
        portfolio.portfolio_returns(w, s, benchmark="names")


def test_ties_and_rounded_baskets(spark):
    w = portfolio.weights(scores(spark, [{"a": 1.0, "b": 1.0, "c": 2.0, "d": None, "e": 0.0, "f": 0.0}], [{}]), 0.5).orderBy("symbol").toPandas()
    assert w["symbol"].tolist() == ["a", "b", "c", "e", "f"]
    assert w["w_long"].tolist() == [0.5, 0, 0.5, 0, 0] and w["w_short"].tolist() == [0, 0, 0, 0.5, 0.5]  # 2.5 rounds to 2


def test_turnover_against_a_dense_grid(spark):
    rng = np.random.default_rng(1)
    names = [f"s{i}" for i in range(8)]
    days = [D(2020, m, 1) for m in range(1, 11)]
    rows = [(d, s, float(rng.normal()) if rng.random() < 0.8 and d != days[4] else None, float(rng.normal())) for d in days for s in names if rng.random() < 0.9]
    s = spark.createDataFrame(rows, "month_end date, symbol string, score double, fwd_1m_ret double")
    w = portfolio.weights(s, 0.3)
    got = wide(portfolio.turnover(w, s), "turnover")
    long = portfolio.long_weights(w).toPandas()
    for strategy, g in long.groupby("strategy"):
        grid = g.pivot(index="month_end", columns="symbol", values="weight").reindex(days).fillna(0.0)
        want = (grid - grid.shift(1).fillna(0.0)).abs().sum(axis=1) / 2
        for d in days:
            assert got[d, strategy] == pytest.approx(want[d]), (strategy, d)
    rets = wide(portfolio.portfolio_returns(w, s), "ret")
    assert rets[days[4], "long_short"] == 0.0
    net = wide(portfolio.net_returns(portfolio.portfolio_returns(w, s), portfolio.turnover(w, s), 15.0), "ret")
    assert all(net[k] <= rets[k] + 1e-12 for k in net)


def test_performance_peculiarities(spark):
    rows = [(D(2020, i + 1, 1), "x", r) for i, r in enumerate([-0.5, 0.1, 0.2])]
    r = portfolio.performance(spark.createDataFrame(rows, "month_end date, strategy string, ret double")).first()
    assert r["max_drawdown"] == 0.0 and r["calmar"] is None and r["sortino"] is None
    assert r["ann_return"] == pytest.approx((0.5 * 1.1 * 1.2) ** 4 - 1)
    two = spark.createDataFrame([(D(2020, i + 1, 1), s, x) for i, x in enumerate([0.1, -0.1, 0.3]) for s in ("a", "benchmark_ew")], "month_end date, strategy string, ret double")
    assert portfolio.relative_metrics(two).where("strategy = 'a'").first()["beta"] == pytest.approx(1.5)


def test_scores_need_valid_weights(spark):
    with pytest.raises(ValueError):
        portfolio.normalized_weights({"other": 1.0})
    with pytest.raises(ValueError):
        portfolio.normalized_weights({"z_VALUE": 0.0})
    assert portfolio.normalized_weights({"z_VALUE": 1.0, "z_REVERSAL_1M": 1.0})["z_VALUE"] == 1.0
    row = spark.createDataFrame([(1.0, None, 1.0, 1.0)], "z_VALUE double, z_MOM_12_1 double, z_QUALITY double, z_SIZE double")
    assert portfolio.score(row, {"z_VALUE": 1.0}).first()["score"] is None


def test_signs_without_an_ic_are_negative(spark):
    p = spark.createDataFrame([("a", MONTHS[0], 0.1, 1.0)], "symbol string, month_end date, fwd_1m_ret double, z_VALUE double")
    assert portfolio.factor_signs(p, ("z_VALUE",)).first()["sign"] == -1.0


def test_stress_regimes(bars):
    p = factors.factor_panel(bars)
    got = stress.regimes(p, portfolio.scored_panel(p), bars.withColumn("pct_chg", F.lit(1.0)), limit=9.5).toPandas().pivot(index="month_end", columns="regime", values="ret")
    assert (got["high_cost_return"] <= got["net_return"] + 1e-12).all() and (got["net_return"] <= got["gross_return"] + 1e-12).all()
    assert np.allclose(got["price_limit_filtered_return"], got["gross_return"]) and got["t_plus_one_delay_return"].iloc[0] == 0.0
    assert stress.regime_summary(stress.regimes(p, portfolio.scored_panel(p), bars)).count() == 6


def test_tuning_selects_on_validation_alone(spark, bars):
    rows = [(0, "validation", 2.0, 0.1), (0, "test", 0.0, 0.0), (1, "validation", 1.0, 0.5), (1, "test", 99.0, 9.0), (2, "validation", None, None)]
    assert tuning.select(spark.createDataFrame(rows, "candidate_id int, split string, sharpe double, ann_return double")).first()["candidate_id"] == 0
    grid = tuning.grid(spark, [1.0, 5.0], [0.0, 0.1], [0.2], [{"z_VALUE": 1.0}, {"z_VALUE": 1.0, "z_SIZE": 1.0}])
    out = tuning.evaluate(factors.factor_panel(bars), grid, {"train_end": "2021-06-30", "valid_end": "2022-03-31", "test_start": "2022-04-01"}).toPandas()
    assert len(out) == 24 and set(out["split"]) == {"train", "validation", "test"}
    one = portfolio.scored_panel(factors.factor_panel(bars), {"z_VALUE": 1.0}, sign_flip=False)
    assert one.count() > 0


def months(n, start=(2020, 1)):
    return [(pd.Timestamp(*start, 1) + pd.offsets.MonthEnd(i + 1)).date() for i in range(n)]


def test_walk_forward():
    purged = validation.walk_forward(months(24), 12, 3, "purged", 2)
    validation.assert_no_leakage(purged)
    assert all(validation.month_gap(s.train_end, s.test_start) >= 2 and not set(s.train_months) & set(s.test_months) for s in purged)
    assert len(purged) == 4 and len(purged[0].train_months) == 10
    grown = validation.walk_forward(months(18), 6, 4)
    assert [len(s.train_months) for s in grown] == [6, 10, 14] and [len(s.test_months) for s in grown] == [4, 4, 4]
    assert validation.walk_forward(months(5), 1, 2, "purged", 3) == []
    with pytest.raises(ValueError):
        validation.walk_forward(months(5), 1, 2, "other")
    bad = validation.Split(0, tuple(months(3)), tuple(months(3)), "purged", 1)
    with pytest.raises(AssertionError):
        validation.assert_no_leakage([bad])


@pytest.fixture(scope="module")
def ml_panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{s:06d}", m, *(float(x) for x in rng.normal(size=2))) for m in months(12) for s in range(12)]
    p = pd.DataFrame(rows, columns=["symbol", "month_end", "x1", "x2"])
    p["fwd_1m_ret"] = 0.1 * p["x1"] - 0.05 * p["x2"] + 0.02 * rng.normal(size=len(p))
    return p


def standard(train, test):
    m, s = train.mean(), train.std(ddof=0)
    return ((train - m) / s).to_numpy(), ((test - m) / s).to_numpy()


@pytest.mark.parametrize("model", ["linear", "ridge", "lasso", "logistic"])
def test_linear_family(spark, ml_panel, model):
    split = validation.walk_forward(months(12), 8, 4)[0]
    data = ml.dataset(spark.createDataFrame(ml_panel), ["x1", "x2"])
    others = validation.walk_forward(months(12), 5, 3) + validation.walk_forward(months(12), 5, 3, "purged", 1)
    fits = linear.fit_all(data, [*others, split], (model,), ["x1", "x2"])  # the others are solved beside it
    got = linear.predict(data, fits[-1:], ["x1", "x2"]).toPandas().sort_values(["month_end", "symbol"])["score"].to_numpy()
    tr, te = (ml_panel[ml_panel["month_end"].isin(m)].sort_values(["month_end", "symbol"]) for m in (split.train_months, split.test_months))
    x, xt = standard(tr[["x1", "x2"]], te[["x1", "x2"]])
    y = tr["fwd_1m_ret"].to_numpy()
    if model in ("linear", "ridge"):
        w = np.linalg.solve(x.T @ x + (model == "ridge") * np.eye(2), x.T @ (y - y.mean()))
        want = xt @ w + y.mean()
    elif model == "lasso":
        w = np.zeros(2)
        for _ in range(2000):
            for j in range(2):
                r = y - y.mean() - x @ w + x[:, j] * w[j]
                c = x[:, j] @ r / len(y)
                w[j] = np.sign(c) * max(abs(c) - 0.001, 0) / (x[:, j] @ x[:, j] / len(y))
        want = xt @ w + y.mean()
    else:
        z, t, w = np.column_stack([np.ones(len(x)), x]), (y > 0).astype(float), np.zeros(3)
        ridge = np.diag([0.0, 1.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - t) + ridge @ w)
        want = 1 / (1 + np.exp(-np.column_stack([np.ones(len(xt)), xt]) @ w))
    assert np.allclose(got, want, atol=1e-8)


def test_walk_forward_models(spark, ml_panel):
    found, weights = ml.walk_forward_predictions(spark.createDataFrame(ml_panel), ["x1", "x2"], ("ridge", "random_forest"), 6, 3, "purged", 1, trees=5)
    p = found.toPandas()
    assert (p["train_end"] < p["test_start"]).all() and p["score"].notna().all() and set(p["model"]) == {"ridge", "random_forest"}
    metrics = {r["model"]: r for r in ml.evaluate(found).collect()}
    own = p[p["model"] == "ridge"]
    pos, neg = own[own["target_class"] == 1]["score"], own[own["target_class"] == 0]["score"]
    pairs = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics["ridge"]["auc"] == pytest.approx(pairs) and metrics["ridge"]["rmse"] == pytest.approx(np.sqrt(((own["score"] - own["target"]) ** 2).mean()))
    assert metrics["ridge"]["rank_ic"] == pytest.approx(own["score"].rank().corr(own["target"].rank()))
    assert ml.mean_importance(weights).count() == 4
    assert portfolio.performance(ml.score_portfolios(found), ("method", "model", "strategy")).count() == 8
    both = ml.evaluate(found).unionByName(ml.evaluate(found.withColumn("method", F.lit("expanding"))))
    assert all(r["difference"] == 0 for r in ml.compare_methods(both).collect())
    with pytest.raises(KeyError):
        ml.dataset(spark.createDataFrame(ml_panel), ["nothing"])


def test_optimal_weights():
    rng = np.random.default_rng(0)
    for _ in range(10):
        mu, a = rng.normal(0, 0.1, 3), rng.normal(size=(3, 3))
        cov, before = a @ a.T * 0.02 + 1e-6 * np.eye(3), np.array([0.5, 0.3, 0.2])
        f = lambda w: -mu @ w + 5 * w @ cov @ w + 0.05 * np.abs(w - before).sum() + 0.01 * w @ w
        w = decision.optimal_weights(mu, cov, before, max_weight=0.7)
        grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(71) for j in range(71) if 30 <= 100 - i - j + 30 and 0 <= 100 - i - j <= 70]
        assert f(w) <= min(map(f, grid)) + 1e-9 and abs(w.sum() - 1) < 1e-8 and (w >= -1e-10).all() and (w <= 0.7 + 1e-9).all()
    assert np.allclose(decision.optimal_weights(np.zeros(3), np.eye(3), np.zeros(3), max_weight=0.2), 1 / 3)
    cov = np.diag([0.1, 0.2, 0.3])
    calm, bold = (decision.optimal_weights(np.array([0.1, 0.2, 0.3]), cov, np.zeros(3), risk_aversion=r, max_weight=1.0) for r in (10.0, 0.1))
    assert calm @ cov @ calm <= bold @ cov @ bold
    held = np.array([1.0, 0.0, 0.0])
    moved = [np.abs(decision.optimal_weights(np.array([0.1, 0.2, 0.3]), cov, held, turnover_penalty=t, max_weight=1.0) - held).sum() for t in (0.0, 0.5)]
    assert moved[1] <= moved[0]


def test_decisions(spark, bars):
    found = decision.optimize_panel(decision.score_panels(factors.factor_panel(bars)), lookback=2, max_weight=0.5)
    sums = found.groupBy("source", "month_end").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert sums and all(abs(r["s"] - 1) < 1e-8 for r in sums)
    months = decision.month_returns(found)
    assert months.where("net > gross").count() == 0 and decision.performance(found).count() == 2
    assert np.allclose(decision.trailing_covariance(np.zeros((1, 2)), 5).dense(), 0.05 * np.eye(2))


def plain_sequence(scores, lookback=3, cost=15.0, **options):
    """The month sequence with dense arrays and one month's solver."""
    out = []
    for source, g in scores.groupby("source"):
        table = g.pivot(index="month_end", columns="symbol", values=["fwd_1m_ret", "score"]).sort_index()
        ret, score = (table[c].to_numpy(float) for c in ("fwd_1m_ret", "score"))
        held = np.zeros(ret.shape[1])
        for at, month in enumerate(table.index):
            own = np.flatnonzero(~np.isnan(score[at]) & ~np.isnan(ret[at]))
            if not len(own):
                continue
            w = decision.optimal_weights(score[at, own], decision.trailing_covariance(ret[max(0, at - lookback) : at, own], lookback), held[own], **options)
            moved, gained = np.abs(w - held[own]).sum() / 2, w @ ret[at, own]
            out += [(source, month, table["score"].columns[i], x, gained, moved, gained - moved * cost / 1e4) for i, x in zip(own, w)]
            held = np.zeros(ret.shape[1])
            held[own] = w
    return pd.DataFrame(out, columns=["source", "month_end", "symbol", "weight", "month_return", "month_turnover", "net_return"])


@pytest.mark.parametrize("sample,size", [(1000, 100_000), (0, 7), (9, 7)])
def test_month_sequence_over_tasks(spark, monkeypatch, sample, size):
    """Weights don't depend on how a month's names are spread, nor on the sample that the steps start from."""
    monkeypatch.setattr(decision, "START_NAMES", sample)
    monkeypatch.setattr(decision, "TASK_NAMES", size)
    rng = np.random.default_rng(9)
    rows = [(s, m, f"n{i:03d}", float(rng.normal()) if rng.random() < 0.9 and not (s == "a" and k == 3) else None, float(rng.normal(0, 0.5)) if rng.random() < 0.9 else None) for s in "ab" for k, m in enumerate(months(6)) for i in range(40) if rng.random() < 0.9]
    table = pd.DataFrame(rows, columns=["source", "month_end", "symbol", "score", "fwd_1m_ret"])
    found = decision.optimize_panel(spark.createDataFrame(rows, "source string, month_end date, symbol string, score double, fwd_1m_ret double"), 3, max_weight=0.2).toPandas()
    both = plain_sequence(table, max_weight=0.2).merge(found, on=["source", "month_end", "symbol"], how="outer", suffixes=("", "_found"))
    for c in ("weight", "month_return", "month_turnover", "net_return"):
        assert both[c].notna().all() and np.allclose(both[c], both[f"{c}_found"], atol=1e-8, rtol=0)


def uneven_month(spark, n, seed):
    """A month's names with heavy-tailed pasts, of which only a few are worth holding, and what _sums takes of them."""
    rng = np.random.default_rng(seed)
    past = np.minimum(rng.lognormal(0, 2.5, (n, 12)) / rng.lognormal(0, 2.5, (n, 12)), 1e4)
    past, score, before = (past - past.mean(axis=1, keepdims=True)) / np.sqrt(11), rng.normal(0, 0.5, n), np.zeros(n)
    before[rng.choice(n, 10, replace=False)] = 0.1
    rows = pd.DataFrame({"symbol": [f"{i:06d}" for i in range(n)], "score": score, "before": before, "past": past.tolist()})
    return spark.createDataFrame(rows, "symbol string, score double, before double, past array<double>").persist(), (score, before, past)


def gap_of(point, names, terms, ra):
    """What the weights at a point's prices cost above the dual's value there: none but at the optimum. And their sum."""
    score, before, past = names
    before = np.minimum(before, terms.cap)
    w = terms.weights(score - past @ point.prices[:12] + point.prices[12], before)
    risk = w @ past
    return terms.curve / 2 * w @ w - score @ w + terms.penalty * np.abs(w - before).sum() + ra * risk @ risk - point.value, w.sum()


@pytest.mark.parametrize("seed", [2, 5])
def test_a_month_settles_in_few_passes(spark, seed):
    names, columns = uneven_month(spark, 4_000, seed)
    terms = decision.Terms.of(12, 5.0, 0.05, 0.01, 0.25)
    spark.sparkContext.setJobGroup(f"uneven{seed}", "")
    try:
        best = decision.dual_prices(names, 4_000, terms, 12, columns[0].min(), columns[0].max())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"uneven{seed}"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert np.allclose(gap_of(best, columns, terms, 5.0), (0.0, 1.0), atol=1e-6) and jobs <= 15


@pytest.mark.parametrize("new,held", [(20, 20_000), (100, 150)])
def test_more_names_than_the_driver_holds(spark, monkeypatch, new, held):
    """The same optimum where names join a few at a time, and by steps over all names where they are too many."""
    monkeypatch.setattr(decision, "START_NAMES", 100)
    monkeypatch.setattr(decision, "NEW_NAMES", new)
    monkeypatch.setattr(decision, "HELD_NAMES", held)
    names, columns = uneven_month(spark, 600, 1)
    terms = decision.Terms.of(12, 5.0, 0.05, 0.01, 0.02)
    best = decision.dual_prices(names.repartition(3), 600, terms, 12, columns[0].min(), columns[0].max())
    assert np.allclose(gap_of(best, columns, terms, 5.0), (0.0, 1.0), atol=1e-6)


def test_odd_months_of_the_sequence(spark):
    schema = "source string, month_end date, symbol string, score double, fwd_1m_ret double"
    few = [("a", MONTHS[0], "x", 1.0, 0.1), ("a", MONTHS[0], "y", float("inf"), 0.2), ("a", MONTHS[1], "x", 1.0, 0.1), ("a", MONTHS[2], "z", float("nan"), 0.1)]
    got = {(r["month_end"], r["symbol"]): r["weight"] for r in decision.optimize_panel(spark.createDataFrame(few, schema)).collect()}
    assert got == {(MONTHS[0], "x"): 0.5, (MONTHS[0], "y"): 0.5, (MONTHS[1], "x"): 1.0}
    assert decision.optimize_panel(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="two rows of a month and symbol"):
        decision.optimize_panel(spark.createDataFrame([few[0], few[0]], schema)).collect()


def test_covariance_in_few_rows():
    rng = np.random.default_rng(3)
    past = rng.normal(0, 0.1, (9, 5))
    past[2, 3] = np.nan
    want = np.cov(np.nan_to_num(past)[-6:], rowvar=False, ddof=1) + 1e-6 * np.eye(5)
    assert np.allclose(decision.trailing_covariance(past, 6).dense(), want)


@pytest.mark.parametrize("scale,penalty,risk", [(0.05, 0.05, 5.0), (0.5, 0.05, 5.0), (3.0, 0.2, 1.0), (0.5, 0.0, 5.0), (0.5, 0.05, 0.0)])
def test_optimality(scale, penalty, risk):
    """The dual's weights meet the optimality conditions: marginal gains agree but where a bound or a kink explains it."""
    rng = np.random.default_rng(5)
    n, cap, conc = 200, 0.25, 0.01
    cov = decision.trailing_covariance(rng.normal(0, scale, (12, n)), 12)
    mu, before = rng.normal(0, 1, n), np.zeros(n)
    before[:8] = 1 / 8
    w = decision.optimal_weights(mu, cov, before, risk, penalty, conc, cap)
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= cap + 1e-9
    gain = mu - 2 * risk * cov.times(w) - 2 * conc * w
    up = np.where(w < cap - 1e-7, gain - penalty * np.where(w >= before - 1e-9, 1, -1), -np.inf)  # of a little more
    down = np.where(w > 1e-7, gain - penalty * np.where(w > before + 1e-9, 1, -1), np.inf)  # lost by a little less
    assert up.max() <= down.min() + 1e-5 * (1 + np.abs(gain).max())


def test_registry(spark, bars):
    p = factors.factor_panel(bars)
    s = portfolio.scored_panel(p)
    w = portfolio.weights(s)
    g, t = portfolio.portfolio_returns(w, s), portfolio.turnover(w, s)
    mean = t.groupBy("strategy").agg(F.avg("turnover").alias("mean_turnover"))
    tuned = spark.createDataFrame([(1, "validation", 0.1, 1.0, -0.1, 0.5), (1, "test", 0.2, 1.0, -0.1, 0.5)], "candidate_id int, split string, ann_return double, sharpe double, max_drawdown double, mean_turnover double")
    reg = registry.registry(registry.backtest_entries(portfolio.performance(g), mean, "gross", 0.0), registry.backtest_entries(portfolio.performance(portfolio.net_returns(g, t, 15.0)), mean, "net", 15.0), registry.tuned_entries(tuned, tuned))
    assert reg.columns == list(registry.COLUMNS) and reg.count() == 10
    assert {r["selection_role"] for r in reg.where("category = 'tuned_candidate'").collect()} == {"selected_on_validation", "test_reporting_only"}
    assert all(r["cost_drag"] is None or r["cost_drag"] >= -1e-12 for r in registry.gross_net(reg).collect())


def test_group_returns(spark):
    rows = [(f"s{i}", MONTHS[0], float(i), float(i) / 10) for i in range(10)] + [("s0", MONTHS[1], 1.0, 0.1)]
    p = spark.createDataFrame(rows, "symbol string, month_end date, z_A double, fwd_1m_ret double")
    got = {(r["month_end"], r["quantile"]): r["mean_return"] for r in research.group_returns(p, ["z_A"]).collect()}
    assert got == pytest.approx({(MONTHS[0], k + 1): (4 * k + 1) / 20 for k in range(5)})


def test_model_queries_cover_all_splits(monkeypatch):
    """The model queries walk over all splits with the reference's 18 and 6 months, and forests have 120 trees."""
    from tessel.plans import catalog

    asked = []
    monkeypatch.setattr(catalog, "panel", lambda *a: None)
    monkeypatch.setattr(ml, "evaluate", lambda d: d)
    monkeypatch.setattr(ml, "walk_forward_predictions", lambda panel, features, models, *a, **b: (asked.append((models, a, b)) or "rows", None))
    assert catalog.q_ml_linear(None, "") == catalog.q_ml_trees(None, "") == "rows"
    assert asked == [(("linear",), (18, 6, "expanding"), {}), (("random_forest", "gradient_boosting"), (18, 6, "purged"), {})]
    assert ml.estimator.__defaults__[-2] == 120


def test_queries_take_the_default_settings(monkeypatch):
    """Features, factors, horizons and grid of the queries are those of the settings, in the query and in its SQL."""
    from tessel.config import ML, Factors, Tuning
    from tessel.plans import catalog

    assert catalog.FEATURES == list(ML().feature_cols) == catalog.ALL_Z and catalog.HORIZONS == list(Factors().ic_decay_horizons)
    assert catalog.GRID == {"risk": Tuning().risk_aversion, "penalty": Tuning().turnover_penalty, "quantile": Tuning().top_quantile, "factor_weights": Tuning().factor_weight_sets}
    assert max(catalog.GRID["penalty"]) == 0.15 and "6 AS horizon" in catalog.ORACLE_SQL["q_ic_decay"] and "0.15::DOUBLE" in catalog.ORACLE_SQL["q_tuning_grid"]
    assert all(f"z_{f}" in catalog.ORACLE_SQL["q_factor_corr"] for f in factors.FACTORS)


def test_logistic_splits_and_constant_features(spark):
    """A split whose training rows are one class has no logistic model; a constant feature has no weight."""
    rows = [(m, f"s{i}", 1.0, float(i), 0.1 if k < 3 or i % 2 else -0.1) for k, m in enumerate(months(8)) for i in range(4)]
    data = ml.dataset(spark.createDataFrame(rows, "month_end date, symbol string, one double, x double, fwd_1m_ret double"), ["one", "x"])
    splits = validation.walk_forward(months(8), 2, 2)
    fits = linear.fit_all(data, splits, linear.MODELS, ["one", "x"])
    assert [f.split.split_id for f in fits if f.model == "logistic"] == [1, 2]
    assert all(abs(f.scaled[0]) < 1e-9 for f in fits)
    broken = validation.Split(0, tuple(months(8)[2:4]), tuple(months(8)[4:6]), "expanding", 0)
    with pytest.raises(ValueError, match="all months"):
        linear.fit_all(data, [broken], ("linear",), ["x"])


def test_a_decision_computes_its_scores_once(spark, month):
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x

    rows = [("a", month(2020, m), f"s{i}", float(i % 3), 0.01 * i) for m in (1, 2, 3) for i in range(6)]
    scores = spark.createDataFrame(rows, "source string, month_end date, symbol string, score double, fwd_1m_ret double")
    found = decision.optimize_panel(scores.withColumn("score", F.udf(costly, "double")("score")))
    assert found.count() == seen.value == len(rows)


def test_candidates_share_scores(spark, bars, monkeypatch):
    """Places are made once for each score, and each candidate's row is the one that it has alone."""
    seen, keep = [], tuning.__dict__.get("written", lambda df, name: df)
    monkeypatch.setattr(tuning, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    panel, splits = factors.factor_panel(bars).persist(), {"train_end": "2021-06-30", "valid_end": "2022-03-31", "test_start": "2022-04-01"}
    weights = [{"z_VALUE": 1.0}, {"z_VALUE": 1.0, "z_SIZE": 1.0}]
    out = tuning.evaluate(panel, tuning.grid(spark, [1.0, 5.0], [0.0, 0.1], [0.2, 0.5], weights), splits).toPandas().drop(columns="candidate_id")
    assert seen[0].count() == 4 * panel.count()
    for risk, penalty, quantile, w in ((5.0, 0.1, 0.5, weights[1]), (1.0, 0.0, 0.2, weights[0])):
        alone = tuning.evaluate(panel, tuning.grid(spark, [risk], [penalty], [quantile], [w]), splits).toPandas().drop(columns="candidate_id")
        same = out[(out["risk_aversion"] == risk) & (out["turnover_penalty"] == penalty) & (out["top_quantile"] == quantile) & (out["factor_weights_json"] == alone["factor_weights_json"][0])]
        order = lambda df: df.sort_values("split").reset_index(drop=True)
        pd.testing.assert_frame_equal(order(same), order(alone))


def test_one_regime_plans_no_other(spark, bars, monkeypatch):
    """A single regime makes no turnover, and cleaned bars are exchanged by symbol alone."""
    p = factors.factor_panel(bars)
    monkeypatch.setattr(portfolio, "turnover", lambda *a, **k: pytest.fail("turnover isn't asked for"))
    assert stress.regimes(p, portfolio.scored_panel(p), bars.withColumn("pct_chg", F.lit(1.0)), only=("price_limit_filtered_return",)).count() == p.select("month_end").distinct().count()
    plan = cleaning.clean_daily(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
