"""Cleaning, indicators, factors and statistics against pandas restatements and exact cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions import crosssections, trailing, windows
from tessel.operators import cleaning, factors, indicators, research
from tessel.sources import bars as sources

D = dt.date


def test_dirty_rows(spark):
    rows = [("000001", D(2020, 1, 1), 10.0, 9.0, 10.0), ("000001", D(2020, 1, 2), 10.0, 12.0, 11.0), ("000001", D(2020, 1, 3), 13.0, 11.0, 12.1)]
    out = cleaning.clean_daily(spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")).orderBy("date").collect()
    assert (out[1]["high"], out[1]["low"]) == (12.0, 10.0) and out[1]["pct_chg"] == pytest.approx(10.0) and out[0]["pct_chg"] is None


def test_aliases_coercion_and_last_row(spark):
    rows = [(" 000001\t", "2020-01-02", "1.5", "x", 1), ("000001", "2020-01-02", "2.5", "NaN", 2), (None, "2020-01-02", "1", "1", 3), ("000002", "never", "1", "1", 4)]
    out = cleaning.clean_daily(spark.createDataFrame(rows, ["代码", "日期", "收盘", "开盘", "n"]).withColumnRenamed("n", "ord"), None).collect()
    assert [(r["symbol"], r["date"], r["close"], r["open"]) for r in out] == [("000001", D(2020, 1, 2), 2.5, None)]
    last = cleaning.keep_last(spark.createDataFrame([("a", 1, 5), ("a", 1, 3)], ["symbol", "date", "ord"]), "ord").collect()
    assert [r["ord"] for r in last] == [5]


def test_quality_profile_counts_repeats(spark):
    rows = [("a", D(2020, 1, 1), -1.0), ("a", D(2020, 1, 1), -1.0), ("a", D(2020, 1, 1), 2.0), ("b", D(2020, 1, 2), None)]
    df = cleaning.add_missing(spark.createDataFrame(rows, "symbol string, date date, close double"))
    r = cleaning.quality_profile(df).first()
    assert (r["rows"], r["symbols"], r["repeated_rows"], r["repeated_keys"], r["negative_rows"], r["null_close"]) == (4, 2, 1, 2, 2, 0.25)


def test_global_quantiles_by_bands(spark):
    v = np.random.default_rng(0).normal(size=20000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    qs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    want = np.quantile(v, qs)
    assert np.allclose(crosssections.global_quantiles(df, "v", qs), want)
    assert np.allclose(crosssections.global_quantiles(df, "v", qs, small=10, per_bucket=50), want)
    assert crosssections.global_quantiles(df.where("false"), "v", [0.5]) == [None]


def test_constant_columns_raise_no_flag(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "symbol string, v double")
    assert not any(r["flag_z"] or r["flag_iqr"] for r in cleaning.outlier_flags(df, "v").collect())
    assert df.agg(windows.pair_corr(F.col("v"), F.col("v"))).first()[0] is None


def test_indicators_match_pandas(bars, daily):
    got = indicators.moving_convergence(indicators.indicators(bars)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    g = daily.sort_values(["symbol", "date"]).groupby("symbol")["close"]
    ema = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
    ret = g.pct_change()
    want = {
        "ret": ret,
        "ma_20": g.transform(lambda s: s.rolling(20).mean()),
        "vol_20": ret.groupby(daily["symbol"]).transform(lambda s: s.rolling(20).std(ddof=0)) * np.sqrt(252),
        "ema12": g.transform(lambda s: ema(s, 12)),
        "macd_signal": g.transform(lambda s: ema(ema(s, 12) - ema(s, 26), 9)),
    }
    for name, series in want.items():
        assert np.allclose(got[name], series.reset_index(drop=True), equal_nan=True, atol=1e-9), name


@pytest.mark.parametrize("days", [512, 40, 3])
def test_exponential_averages_over_chunks(spark, monkeypatch, days):
    """Chunks of any length give the recursion over the whole symbol, over gaps, empty chunks and missing values too."""
    import numpy as np

    monkeypatch.setattr(indicators, "CHUNK_DAYS", days)
    rng = np.random.default_rng(4)
    rows = []
    for s in ("a", "b", "c"):
        day = pd.Timestamp("2019-12-20")
        for i in range(400):
            day += pd.Timedelta(days=int(rng.integers(1, 4)) if i != 200 else 1500)
            missing = s == "c" or (s == "b" and (i < 5 or rng.random() < 0.3 or 100 < i < 180))
            rows.append((s, day.date(), None if missing else float(10 + rng.normal())))
    got = indicators.moving_convergence(spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    table = pd.DataFrame(rows, columns=["symbol", "date", "close"])
    want = []
    for _, g in table.groupby("symbol"):
        ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        macd = ema(g["close"].astype(float), 12) - ema(g["close"].astype(float), 26)
        want.append(pd.DataFrame({"ema12": ema(g["close"].astype(float), 12), "ema26": ema(g["close"].astype(float), 26), "macd": macd, "macd_signal": ema(macd, 9)}))
    want = pd.concat(want).reset_index(drop=True)
    for c in want:
        assert (got[c].isna() == want[c].isna()).all() and np.allclose(got[c].fillna(0), want[c].fillna(0), atol=1e-10, rtol=0), c


def test_rsi_without_loss_is_null(spark):
    rows = [("a", D(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(20)]
    assert all(r["rsi_14"] is None for r in indicators.rsi(spark.createDataFrame(rows, "symbol string, date date, close double")).collect())


def test_change_fills_gaps(spark):
    rows = [("a", 1, 10.0), ("a", 2, None), ("a", 3, 11.0)]
    df = spark.createDataFrame(rows, "symbol string, date int, close double")
    w = windows.by("symbol", order="date")
    assert [r["r"] for r in windows.with_change(df, "close", "r", w).orderBy("date").collect()] == pytest.approx([None, 0.0, 0.1])
    assert [r["r"] for r in windows.with_change(df, "close", "r", w, fill=False).orderBy("date").collect()] == [None, None, None]


def test_month_end_gate(bars, daily):
    panel = factors.raw_factors(bars).toPandas()
    ends = pd.to_datetime(panel["month_end"])
    traded = set(daily["date"])
    assert len(panel) and all(d.date() in traded for d in ends)
    loose = factors.raw_factors(bars, month_end_mode="last_bar")
    assert loose.count() > len(panel)


def test_factor_values(bars, daily):
    row = factors.raw_factors(bars).where("symbol = '000003'").orderBy("month_end").first()
    d = daily[daily["symbol"] == "000003"].reset_index(drop=True)
    at = d.index[d["date"] == row["month_end"]][0]
    ret = d["close"].pct_change()
    assert row["SIZE"] == pytest.approx(np.log(d["amount"][at - 20 : at + 1].mean()))
    ma = d["close"][at - 251 : at + 1].mean()
    assert row["VALUE"] == pytest.approx((ma - d["close"][at]) / ma)
    assert row["QUALITY"] == pytest.approx(ret[at - 62 : at + 1].mean() / ret[at - 62 : at + 1].std(ddof=0))
    assert row["ILLIQUIDITY"] == pytest.approx(-np.log((ret.abs() / d["amount"])[at - 20 : at + 1].mean()))


def test_cross_sections(bars):
    z = factors.factor_panel(bars).toPandas()
    means = z.groupby("month_end")["z_VALUE"].agg(["mean", lambda s: s.std(ddof=0)])
    assert np.allclose(means["mean"], 0, atol=1e-9) and np.allclose(means.iloc[:, 1], 1)
    ic = factors.rank_ic(factors.factor_panel(bars), ["z_VALUE", "z_SIZE"]).toPandas()
    for _, r in ic.iterrows():
        m = z[z["month_end"] == r["month_end"]]
        assert r["ic"] == pytest.approx(m[r["factor"]].rank().corr(m["fwd_1m_ret"].rank()))


@pytest.mark.parametrize("q", [2, 3, 4, 5, 10])
def test_buckets_are_those_of_ranked_quantiles(spark, q):
    rows = [(n, r) for n in range(q, 60) for r in range(1, n + 1)]
    got = spark.createDataFrame(rows, ["n", "r"]).select("n", "r", windows.quantile_bucket(F.col("r"), F.col("n"), q).alias("b")).toPandas()
    for n, g in got.groupby("n"):
        want = pd.qcut(pd.Series(range(1, n + 1)).rank(method="first"), q, labels=False) + 1
        assert g.sort_values("r")["b"].tolist() == want.tolist(), n


def test_time_split_test_wins(spark):
    df = spark.createDataFrame([(D(2021, 1, 31),), (D(2023, 6, 30),), (D(2024, 2, 29),), (D(2023, 12, 31),)], "d date")
    f = lambda *a: [r[0] for r in df.select(research.time_split("d", *a)).collect()]
    assert f("2022-12-31", "2023-06-30", "2024-01-01") == ["train", "validation", "test", "holdout"]
    assert f("2022-12-31", "2023-12-31", "2020-01-01") == ["test"] * 4


def test_bootstrap_is_numpys(spark):
    v = [0.1, -0.2, 0.3, 0.05, 0.0]
    ic = spark.createDataFrame([("f", D(2020, i + 1, 1), x) for i, x in enumerate(v)], "factor string, month_end date, ic double")
    means = np.random.default_rng(42).choice(np.array(v), size=(1000, 5), replace=True).mean(axis=1)
    r = research.bootstrap_mean(ic).first()
    assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_fama_macbeth_is_least_squares(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"month_end": [D(2020, 1 + i // 30, 1) for i in range(120)], "a": rng.normal(size=120), "b": rng.normal(size=120), "r": rng.normal(size=120)})
    got = {r["term"]: r for r in research.fama_macbeth(spark.createDataFrame(p), ["a", "b"], "r").collect()}
    betas = [np.linalg.lstsq(np.column_stack([np.ones(30), g[["a", "b"]]]), g["r"], rcond=None)[0] for _, g in p.groupby("month_end")]
    for i, t in enumerate(("const", "a", "b")):
        own = np.array(betas)[:, i]
        assert got[t]["mean_coef"] == pytest.approx(own.mean()) and got[t]["t_stat"] == pytest.approx(own.mean() / (own.std(ddof=1) / 2))
    one = {r["term"]: r["mean_coef"] for r in research.fama_macbeth_single(spark.createDataFrame(p), "a", "r").collect()}
    assert one["slope"] == pytest.approx({r["term"]: r["mean_coef"] for r in research.fama_macbeth(spark.createDataFrame(p), ["a"], "r").collect()}["a"])


def test_month_end_statistics_equal_daily_windows(spark, bars):
    """With gaps, missing closes and constant stretches; each bar is computed once for the panel and what is read from it."""
    gaps = bars.where("pmod(xxhash64(symbol, date), 11) > 0").withColumn("close", F.expr("CASE WHEN pmod(xxhash64(date), 7) = 0 THEN NULL WHEN year(date) = 2021 AND symbol < '000003' THEN 0.1 ELSE close END"))
    columns = ("symbol", "date", "month_end", "close", "avg_dv_21", "ma_252", "sharpe_3m", "vol_21", "illiq_21")
    want = factors.monthly_last(factors.daily_windows(gaps)).select(*columns)
    for strict in (False, True):
        got = factors.monthly_windows(gaps, strict=strict).select(*columns)
        got, kept = (got.where("date = month_end"), want.where("date = month_end")) if strict else (got, want)
        assert kept.count() and not got.exceptAll(kept).count() and not kept.exceptAll(got).count()


def test_a_panel_computes_its_bars_once(spark, bars):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    panel = factors.factor_panel(bars.withColumn("close", F.udf(counted, "double")("close")), amounts=True)
    assert factors.rank_ic(panel, ["z_VALUE", "z_SIZE"]).count() and panel.count()
    assert seen.value == bars.count()


def test_bars_to_month_ends_exchange_once(spark):
    """Trades are dealt by symbol and sorted once; neither bars nor months' ends move or sort them again."""
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"
    plan = factors.monthly_windows(sources.bars_from_lineitem(spark.createDataFrame([], schema)), amounts=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "ObjectHashAggregate" not in plan


def test_month_ends_over_batches(bars):
    """Batches that cut symbols and months anywhere give what one batch gives."""
    rows = bars.select("symbol", "date", F.last_day("date").alias("month_end"), "close", F.when(F.dayofmonth("date") % 5 != 0, F.col("amount")).alias("dollar_vol"))
    pdf = rows.withColumn("last", F.coalesce(F.last_day(F.lead("date").over(windows.by("symbol", order="date"))) != F.col("month_end"), F.lit(True))).toPandas().sort_values(["symbol", "date"])
    whole = pa.Table.from_pandas(pdf, preserve_index=False)
    run = lambda size, gathered: pa.Table.from_batches(trailing.month_ends(False, gathered)(iter(whole.to_batches(size)))).to_pandas()
    want = run(10**6, 10**6)
    assert len(want) == int(pdf["last"].sum()) and want["ma_252"].notna().sum() > 100
    for size, gathered in ((7, 1), (500, 900), (1, 50)):
        pd.testing.assert_frame_equal(run(size, gathered), want)
