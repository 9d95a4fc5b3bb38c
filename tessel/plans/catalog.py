"""The catalogue: one query per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.config import ML, Factors, Tuning, Validation
from tessel.functions.tables import written
from tessel.functions.crosssections import with_rank
from tessel.functions.windows import by, forward_fill
from tessel.operators import cleaning, decision, factors, indicators, linear, ml, plots, portfolio, registry, research, stress, tuning, validation
from tessel.plans import sql
from tessel.sources import bars as sources
from tessel.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ALL_Z = [f"z_{f}" for f in factors.FACTORS]
#: The default settings, for the queries and their SQL alike.
HORIZONS = list(Factors().ic_decay_horizons)
FEATURES = list(ML().feature_cols)
GRID = {"risk": Tuning().risk_aversion, "penalty": Tuning().turnover_penalty, "quantile": Tuning().top_quantile, "factor_weights": Tuning().factor_weight_sets}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, chain: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name; oracle is the SQL after the chain of common table expressions."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = f"WITH {sql.CHAIN}{'' if oracle.lstrip().startswith(',') else chr(10)}{oracle}" if chain else oracle
        return fn

    return add


def rounded(df: DataFrame, n: int = 8, **own: int) -> DataFrame:
    """Doubles to n decimals (or the column's own number), so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, own.get(c, n)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def single(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to single precision, where values may be very large."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.bars_from_lineitem(table(spark, sf_dir, "lineitem"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.returns(bars(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor panel, written: it is a hundredth of the bars, and most statistics read it several times."""
    priced = table(spark, sf_dir, "lineitem").where("l_extendedprice is not null").select(F.lit(1)).take(1)
    return written(factors.factor_panel(bars(spark, sf_dir), amounts=bool(priced)), "panel")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, written: weights, returns and turnover all read them."""
    return written(portfolio.scored_panel(panel(spark, sf_dir)), "scores")


# Bars and cleaning


@query("SELECT symbol, date, open, high, low, close, volume, amount FROM bars")
def q_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query("SELECT symbol, date, high, low FROM bars")
def q_clean_swap(spark, sf_dir):
    """All bars, with high and low crossed on some days before the repair."""
    crossed = F.dayofmonth("date") % 7 == 0
    high, low = F.when(crossed, F.col("low")).otherwise(F.col("high")), F.when(crossed, F.col("high")).otherwise(F.col("low"))
    return cleaning.swap_high_low(bars(spark, sf_dir).select("symbol", "date", high.alias("high"), low.alias("low")))


@query(
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS ord, o_totalprice AS close
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1""",
    chain=False,
)
def q_dedupe_keep_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("close"))
    return cleaning.keep_last(o, "ord")


@query(
    """SELECT trim(c_mktsegment) AS symbol, TRY_CAST(c_name AS DATE) AS date, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS open, TRY_CAST(c_name AS DOUBLE) AS close, count(*) AS n
FROM customer GROUP BY ALL""",
    chain=False,
)
def q_coerce(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t ")).alias("code"), F.col("c_name").alias("day"), F.col("c_acctbal").cast("string").alias("今开"), F.col("c_name").alias("Close"))
    typed = cleaning.coerce(cleaning.add_missing(cleaning.rename_aliases(raw)))
    return typed.groupBy("symbol", "date", "open", "close").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, date, round(ret * 100, 6) AS pct_chg FROM ret")
def q_pct_chg_global(spark, sf_dir):
    return rounded(cleaning.clean_daily(bars(spark, sf_dir)).select("symbol", "date", "pct_chg"), 6)


@query(
    """SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date, count(*) - count(DISTINCT (symbol, date, open, close)) AS repeated_rows,
  count(*) - count(DISTINCT (symbol, date)) AS repeated_keys, CAST(count_if(open < 0 OR close < 0) AS BIGINT) AS negative_rows, 0::BIGINT AS crossed_rows,
  0::DOUBLE AS null_symbol, 0::DOUBLE AS null_date, 0::DOUBLE AS null_open, 1::DOUBLE AS null_high, round(avg(CASE WHEN close IS NULL THEN 1 ELSE 0 END), 8) AS null_close
FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS open, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice - 100000 END AS close FROM orders)""",
    chain=False,
)
def q_quality_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("open"), F.lit(None).cast("double").alias("high"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") - 100000).alias("close"))
    p = cleaning.quality_profile(raw.withColumn("low", F.lit(None).cast("double")))
    return rounded(p.drop("null_low"))


@query("SELECT symbol, date, round(ret, 8) AS ret, round(abs(ret), 8) AS abs_ret FROM ret")
def q_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir).select("symbol", "date", "ret", "abs_ret"))


@query("SELECT symbol, date, round(ln(CASE WHEN close > 0 AND prev > 0 THEN close / prev END), 8) AS log_ret FROM ret")
def q_log_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir).select("symbol", "date", "log_ret"))


@query(
    f"""WITH {sql.RETURNS}, g AS (SELECT avg(ret) AS m, stddev_pop(ret) AS s FROM ret), q AS (SELECT quantile_cont(ret, [0.25, 0.75]) AS q FROM ret),
e AS (SELECT (SELECT m FROM g) AS m, (SELECT s FROM g) AS s, (SELECT q[1] - 1.5 * (q[2] - q[1]) FROM q) AS lo, (SELECT q[2] + 1.5 * (q[2] - q[1]) FROM q) AS hi)
SELECT symbol, date, coalesce(abs((ret - (SELECT m FROM e)) / (SELECT s FROM e)) > 3, false) AS flag_z, coalesce(ret < (SELECT lo FROM e) OR ret > (SELECT hi FROM e), false) AS flag_iqr FROM ret""",
    chain=False,
)
def q_outlier_flags(spark, sf_dir):
    return cleaning.outlier_flags(returns(spark, sf_dir), "ret").select("symbol", "date", "flag_z", "flag_iqr")


@query(
    """SELECT symbol, date, coalesce(abs((ret - avg(ret) OVER s) / nullif(stddev_pop(ret) OVER s, 0)) > 3, false) AS flag_z,
  coalesce(ret < quantile_cont(ret, 0.25) OVER s - 1.5 * (quantile_cont(ret, 0.75) OVER s - quantile_cont(ret, 0.25) OVER s) OR ret > quantile_cont(ret, 0.75) OVER s + 1.5 * (quantile_cont(ret, 0.75) OVER s - quantile_cont(ret, 0.25) OVER s), false)
    AND quantile_cont(ret, 0.75) OVER s <> quantile_cont(ret, 0.25) OVER s AS flag_iqr FROM ret WINDOW s AS (PARTITION BY symbol)"""
)
def q_outlier_by_symbol(spark, sf_dir):
    return cleaning.outlier_flags_by_symbol(returns(spark, sf_dir), "ret").select("symbol", "date", "flag_z", "flag_iqr")


@query(
    """, g AS (SELECT quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM ret)
SELECT symbol, date, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END, 8) AS ret_w FROM ret, g"""
)
def q_winsor_global(spark, sf_dir):
    return rounded(cleaning.winsorize_global(returns(spark, sf_dir), "ret", "ret_w").select("symbol", "date", "ret_w"))


@query(
    "SELECT symbol, date, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, quantile_cont(ret, 0.005) OVER s), quantile_cont(ret, 0.995) OVER s) END, 8) AS ret_w FROM ret WINDOW s AS (PARTITION BY symbol)"
)
def q_winsor_by_symbol(spark, sf_dir):
    return rounded(cleaning.winsorize_by_symbol(returns(spark, sf_dir), "ret", "ret_w").select("symbol", "date", "ret_w"))


@query(
    """SELECT count(ret) AS count, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, round(min(ret), 8) AS min, round(quantile_cont(ret, 0.25), 8) AS p25, round(quantile_cont(ret, 0.5), 8) AS p50,
  round(quantile_cont(ret, 0.75), 8) AS p75, round(max(ret), 8) AS max, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurt FROM ret"""
)
def q_describe(spark, sf_dir):
    return rounded(cleaning.describe(returns(spark, sf_dir), "ret"), skew=6, kurt=6)


# Indicators


@query(f"SELECT symbol, date, round({sql.least_frame('avg(close)', 5, 5)}, 6) AS ma_5, round({sql.least_frame('avg(close)', 20, 20)}, 6) AS ma_20 FROM bars")
def q_ma(spark, sf_dir):
    return rounded(indicators.moving_averages(bars(spark, sf_dir)).select("symbol", "date", "ma_5", "ma_20"), 6)


@query(f"SELECT symbol, date, round({sql.least_frame('stddev_pop(ret)', 20, 20)} * sqrt(252.0), 7) AS vol_20 FROM ret")
def q_vol(spark, sf_dir):
    return rounded(indicators.volatility(returns(spark, sf_dir)).select("symbol", "date", "vol_20"), 7)


@query(
    f""", gl AS (SELECT symbol, date, CASE WHEN close - prev > 0 THEN close - prev WHEN prev IS NOT NULL THEN 0 END AS g, CASE WHEN close - prev < 0 THEN prev - close WHEN prev IS NOT NULL THEN 0 END AS l FROM ret)
SELECT symbol, date, round(100 - 100 / (1 + {sql.least_frame('avg(g)', 14, 14)} / nullif({sql.least_frame('avg(l)', 14, 14)}, 0)), 5) AS rsi_14 FROM gl"""
)
def q_rsi(spark, sf_dir):
    return rounded(indicators.rsi(bars(spark, sf_dir)).select("symbol", "date", "rsi_14"), 5)


EMA = """, n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, list(close) OVER (PARTITION BY symbol ORDER BY date) AS h FROM bars),
e AS (SELECT symbol, date, k, CASE WHEN k >= 12 THEN list_reduce(h, lambda a, x: a + (2.0::DOUBLE / 13) * (x - a)) END AS ema12, CASE WHEN k >= 26 THEN list_reduce(h, lambda a, x: a + (2.0::DOUBLE / 27) * (x - a)) END AS ema26 FROM n)"""


@query(EMA + " SELECT symbol, date, round(ema12, 4) AS ema12, round(ema26, 4) AS ema26 FROM e")
def q_ema(spark, sf_dir):
    averages = indicators.exponential_averages(bars(spark, sf_dir).select("symbol", "date", "close"), "close", {"ema12": 12, "ema26": 26})
    return rounded(averages.select("symbol", "date", "ema12", "ema26"), 4)


@query(
    EMA
    + """, s AS (SELECT symbol, date, k, ema12 - ema26 AS macd FROM e), t AS (SELECT *, list(macd) FILTER (WHERE macd IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date) AS h FROM s)
SELECT symbol, date, round(macd, 4) AS macd, round(CASE WHEN k >= 34 THEN list_reduce(h, lambda a, x: a + 0.2::DOUBLE * (x - a)) END, 4) AS macd_signal FROM t"""
)
def q_macd(spark, sf_dir):
    return rounded(indicators.moving_convergence(bars(spark, sf_dir).select("symbol", "date", "close")).select("symbol", "date", "macd", "macd_signal"), 4)


@query(
    f""", i AS (SELECT ret, {sql.least_frame('avg(close)', 5, 5)} AS ma_5, {sql.least_frame('stddev_pop(ret)', 20, 20)} AS vol, amount FROM ret),
c AS (SELECT {', '.join(f"{sql.CORR.format(a=f'CASE WHEN {b} IS NOT NULL THEN {a} END', b=f'CASE WHEN {a} IS NOT NULL THEN {b} END')} AS {a}__{b}" for a in ('ret', 'ma_5', 'vol', 'amount') for b in ('ret', 'ma_5', 'vol', 'amount'))} FROM i)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round({a}__{b}, 7) AS corr FROM c" for a in ('ret', 'ma_5', 'vol', 'amount') for b in ('ret', 'ma_5', 'vol', 'amount'))}"""
)
def q_indicator_corr(spark, sf_dir):
    i = indicators.volatility(indicators.moving_averages(returns(spark, sf_dir)), year=1).withColumnRenamed("vol_20", "vol")
    return rounded(factors.correlation_matrix(i, ["ret", "ma_5", "vol", "amount"], 100), 7)


@query(
    """SELECT user_id AS symbol, CAST(ts AS DATE) AS date, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS amount
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    chain=False,
)
def q_intraday_daily_bars(spark, sf_dir):
    return sources.bars_from_events(table(spark, sf_dir, "events"))


@query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, max_by(value, ts) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL), l AS (SELECT user_id, max_by(c, d) AS c FROM e GROUP BY user_id),
o AS (SELECT o_custkey, max_by(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS t FROM orders GROUP BY o_custkey)
SELECT user_id AS symbol, c AS intraday_close, t AS daily_close, round(abs(c - t), 6) AS abs_diff, round(abs(c - t) / nullif(t, 0), 6) AS rel_diff FROM l JOIN o ON l.user_id = o.o_custkey""",
    chain=False,
)
def q_intraday_compare(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.struct(F.to_date("o_orderdate").alias("d"), "o_orderkey").alias("date"), F.col("o_totalprice").alias("close"))
    return rounded(sources.intraday_against_daily(sources.bars_from_events(table(spark, sf_dir, "events")), daily), 6)


# Factors and statistics


@query("SELECT symbol, month_end, close AS close_me, volume AS vol_me, amount AS amt_me, round(ret_1m, 8) AS ret_1m, round(fwd_1m_ret, 8) AS fwd_1m_ret FROM monthly")
def q_monthly_close(spark, sf_dir):
    m = factors.monthly_closes(bars(spark, sf_dir))
    return m.withColumns({c: F.round(c, 8) for c in ("ret_1m", "fwd_1m_ret")})


@query("SELECT symbol, month_end, round(fwd_1m_ret, 8) AS fwd_1m_ret FROM monthly WHERE fwd_1m_ret IS NOT NULL")
def q_fwd_return(spark, sf_dir):
    return rounded(factors.monthly_closes(bars(spark, sf_dir)).select("symbol", "month_end", "fwd_1m_ret").where("fwd_1m_ret is not null"))


@query("SELECT symbol, month_end, round(mom, 8) AS mom FROM monthly WHERE mom IS NOT NULL")
def q_momentum(spark, sf_dir):
    w = by("symbol", order="month_end")
    m = factors.monthly_closes(bars(spark, sf_dir))
    return rounded(m.select("symbol", "month_end", (F.lag("close_me", 1).over(w) / F.lag("close_me", 12).over(w) - 1).alias("mom")).where("mom is not null"))


@query(f"SELECT symbol, month_end, close_me, round(fwd_1m_ret, 7) AS fwd_1m_ret, {', '.join(f'round({f}, 7) AS {f}' for f in sql.FACTORS)} FROM raw")
def q_factor_raw(spark, sf_dir):
    return factors.raw_factors(bars(spark, sf_dir)).withColumns({c: F.round(c, 7) for c in ("fwd_1m_ret", *factors.FACTORS)})


@query(f"SELECT symbol, month_end, {', '.join(f'round(z_{f}, 6) AS z_{f}' for f in sql.FACTORS)} FROM z")
def q_factor_z(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("symbol", "month_end", *ALL_Z), 6)


@query("SELECT month_end, factor, round(ic, 7) AS ic FROM ic")
def q_rank_ic(spark, sf_dir):
    return rounded(factors.rank_ic(panel(spark, sf_dir), ALL_Z), 7)


@query("SELECT factor, round(avg(ic), 7) AS ic_mean, round(stddev_samp(ic), 7) AS ic_std, count(ic) AS ic_count, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir FROM ic GROUP BY factor")
def q_ic_summary(spark, sf_dir):
    return rounded(factors.ic_summary(factors.rank_ic(panel(spark, sf_dir), ALL_Z)), 7, icir=6)


@query("SELECT factor, count(ic) AS n, round(avg(ic), 7) AS mean, round(stddev_samp(ic), 7) AS std, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 5) AS t_stat FROM ic GROUP BY factor")
def q_ic_significance_t(spark, sf_dir):
    return rounded(research.ic_significance(factors.rank_ic(panel(spark, sf_dir), ALL_Z)), 7, t_stat=5)


@query()
def q_ic_bootstrap(spark, sf_dir):
    return research.bootstrap_mean(factors.rank_ic(panel(spark, sf_dir), ALL_Z))


@query("SELECT month_end, factor, round(ic, 7) AS ic, round(sum(ic) OVER (PARTITION BY factor ORDER BY month_end ROWS UNBOUNDED PRECEDING), 6) AS cum_ic FROM ic")
def q_cumulative_ic(spark, sf_dir):
    return rounded(factors.cumulative_ic(factors.rank_ic(panel(spark, sf_dir), ALL_Z)), 7, cum_ic=6)


def _decay(h: int) -> str:
    return f"""mv{h} AS (SELECT *, lead(close_me, {h}) OVER (PARTITION BY symbol, factor ORDER BY month_end) / close_me - 1 AS r FROM lz), {sql.ranked(f'rk{h}', f'mv{h}', 'value', 'r', 'month_end, factor')},
d{h} AS (SELECT month_end, {h} AS horizon, factor, {sql.CORR.format(a='rv', b='rr')} AS ic FROM rk{h} GROUP BY month_end, factor HAVING count(*) >= 3)"""


DECAY = f", {', '.join(_decay(h) for h in HORIZONS)}, dc AS ({' UNION ALL '.join(f'SELECT * FROM d{h}' for h in HORIZONS)})"


@query(DECAY + " SELECT month_end, horizon, factor, round(ic, 7) + 0.0::DOUBLE AS ic FROM dc")
def q_ic_decay(spark, sf_dir):
    return rounded(research.ic_decay(panel(spark, sf_dir), ALL_Z, HORIZONS), 7).withColumn("ic", F.col("ic") + F.lit(0.0))  # no negative zeros


@query(DECAY + " SELECT factor, horizon, round(avg(ic), 7) AS ic_mean, round(stddev_samp(ic), 7) AS ic_std, count(ic) AS ic_count, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir FROM dc GROUP BY factor, horizon")
def q_ic_decay_summary(spark, sf_dir):
    return rounded(research.ic_decay_summary(research.ic_decay(panel(spark, sf_dir), ALL_Z, HORIZONS)), 7, icir=6)


GROUPS = f""", gr AS (SELECT *, row_number() OVER (PARTITION BY month_end, factor ORDER BY value, symbol) AS r, count(*) OVER (PARTITION BY month_end, factor) AS n FROM lz WHERE value IS NOT NULL),
gq AS (SELECT *, CAST(1 + {' + '.join(f'CASE WHEN r > 1 + (n - 1) * CAST({k * (1.0 / 5) * 100.0 / 100.0!r} AS DOUBLE) THEN 1 ELSE 0 END' for k in range(1, 5))} AS INTEGER) AS quantile FROM gr WHERE n >= 5),
gm AS (SELECT month_end, factor, quantile, avg(fwd_1m_ret) AS mean_return FROM gq GROUP BY ALL)"""


@query(GROUPS + " SELECT month_end, factor, quantile, round(mean_return, 8) AS mean_return FROM gm")
def q_group_returns(spark, sf_dir):
    return rounded(research.group_returns(panel(spark, sf_dir), ALL_Z))


@query(GROUPS + " SELECT factor, quantile, round(avg(mean_return), 8) AS mean_return, count(mean_return) AS months FROM gm GROUP BY ALL")
def q_group_summary(spark, sf_dir):
    return rounded(research.group_summary(research.group_returns(panel(spark, sf_dir), ALL_Z)))


@query()
def q_fama_macbeth(spark, sf_dir):
    return rounded(research.fama_macbeth(panel(spark, sf_dir), ALL_Z), 6)


@query(
    """, fm AS (SELECT month_end, covar_pop(z_VALUE, fwd_1m_ret) / nullif(var_pop(z_VALUE), 0) AS slope, avg(fwd_1m_ret) AS my, avg(z_VALUE) AS mx FROM z GROUP BY month_end HAVING count(*) > 2),
fc AS (SELECT 'slope' AS term, slope AS coef FROM fm UNION ALL SELECT 'const', my - slope * mx FROM fm)
SELECT term, round(avg(coef), 7) AS mean_coef, round(stddev_samp(coef), 7) AS std_coef, count(coef) AS count, round(avg(coef) / nullif(stddev_samp(coef) / sqrt(count(coef)), 0), 5) AS t_stat FROM fc GROUP BY term"""
)
def q_fama_macbeth_single(spark, sf_dir):
    return rounded(research.fama_macbeth_single(panel(spark, sf_dir), "z_VALUE"), 7, t_stat=5)


@query(
    f""", c AS (SELECT {', '.join(f"{sql.CORR.format(a=f'CASE WHEN z_{b} IS NOT NULL THEN z_{a} END', b=f'CASE WHEN z_{a} IS NOT NULL THEN z_{b} END')} AS {a}__{b}" for a in sql.FACTORS for b in sql.FACTORS)} FROM z)
{' UNION ALL '.join(f"SELECT 'z_{a}' AS a, 'z_{b}' AS b, round({a}__{b}, 7) AS corr FROM c" for a in sql.FACTORS for b in sql.FACTORS)}"""
)
def q_factor_corr(spark, sf_dir):
    return rounded(factors.correlation_matrix(panel(spark, sf_dir), ALL_Z), 7)


@query("SELECT month_end, factor, symbol, value_rank FROM (SELECT *, rank() OVER (PARTITION BY month_end, factor ORDER BY round(value, 6)) + (count(*) OVER (PARTITION BY month_end, factor, round(value, 6)) - 1) / 2.0 AS value_rank FROM lz WHERE value IS NOT NULL)")
def q_cross_rank(spark, sf_dir):
    rows = factors.long_factors(panel(spark, sf_dir), ALL_Z).where("value is not null").withColumn("value", F.round("value", 6))
    return with_rank(rows, "value", "value_rank", "month_end", "factor").select("month_end", "factor", "symbol", "value_rank")


@query(
    """, gaps AS (SELECT symbol, date, CASE WHEN day(date) % 3 = 0 THEN NULL ELSE close END AS v FROM bars)
SELECT symbol, date, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM gaps"""
)
def q_forward_fill(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("v", F.when(F.dayofmonth("date") % 3 != 0, F.col("close")))
    return b.select("symbol", "date", forward_fill(F.col("v"), by("symbol", order="date")).alias("v"))


# Portfolio


@query("SELECT factor, round(ic_mean, 7) AS ic_mean, CAST(sign AS DOUBLE) AS sign FROM signs")
def q_signs(spark, sf_dir):
    return rounded(portfolio.factor_signs(panel(spark, sf_dir)), 7)


@query("SELECT month_end, symbol, round(score, 6) AS score FROM sc")
def q_score(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("month_end", "symbol", "score"), 6)


@query(" UNION ALL ".join(f"SELECT month_end, symbol, '{s}' AS strategy, round({s}, 8) AS weight FROM p_w" for s in sql.STRATEGIES))
def q_weights(spark, sf_dir):
    return rounded(portfolio.long_weights(portfolio.weights(scores(spark, sf_dir))))


def gross(spark, sf_dir):
    s = scores(spark, sf_dir)
    return portfolio.portfolio_returns(portfolio.weights(s), s)


def turns(spark, sf_dir):
    s = scores(spark, sf_dir)
    return portfolio.turnover(portfolio.weights(s), s)


def net(spark, sf_dir):
    s = scores(spark, sf_dir)
    w = portfolio.weights(s)
    return portfolio.net_returns(portfolio.portfolio_returns(w, s), portfolio.turnover(w, s), 15.0)


@query("SELECT month_end, strategy, round(ret, 8) AS ret FROM p_r")
def q_portfolio_returns(spark, sf_dir):
    return rounded(gross(spark, sf_dir))


@query("SELECT month_end, strategy, round(turnover, 8) AS turnover FROM p_t")
def q_turnover(spark, sf_dir):
    return rounded(turns(spark, sf_dir))


@query("SELECT strategy, round(avg(turnover), 8) AS mean_turnover FROM p_t GROUP BY strategy")
def q_mean_turnover(spark, sf_dir):
    return rounded(turns(spark, sf_dir).groupBy("strategy").agg(F.avg("turnover").alias("mean_turnover")))


@query("SELECT month_end, strategy, round(ret, 8) AS ret FROM net")
def q_net_returns(spark, sf_dir):
    return rounded(net(spark, sf_dir))


@query("SELECT month_end, strategy, round(ln(abs(nullif(nav, 0))), 6) AS log_nav, nav < 0 AS below_zero FROM gn")
def q_nav(spark, sf_dir):
    n = portfolio.with_nav(gross(spark, sf_dir))
    return n.select("month_end", "strategy", F.round(F.ln(F.abs(F.nullif(F.col("nav"), F.lit(0.0)))), 6).alias("log_nav"), (F.col("nav") < 0).alias("below_zero"))


@query("SELECT month_end, strategy, round(drawdown, 7)::FLOAT::DOUBLE AS drawdown FROM gn")
def q_drawdown(spark, sf_dir):
    return single(rounded(portfolio.with_nav(gross(spark, sf_dir)).select("month_end", "strategy", "drawdown"), 7), "drawdown")


@query(
    """, rl AS (SELECT month_end, strategy, count(ret) OVER w AS n, stddev_pop(ret) OVER w * sqrt(12.0) AS v, avg(ret) OVER w * sqrt(12.0) AS m FROM p_r WINDOW w AS (PARTITION BY strategy ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT month_end, strategy, round(CASE WHEN n >= 12 THEN v END, 7) AS rolling_vol, round(CASE WHEN n >= 12 THEN m / nullif(v, 0) END, 6) AS rolling_sharpe FROM rl"""
)
def q_rolling(spark, sf_dir):
    return rounded(portfolio.rolling_metrics(gross(spark, sf_dir)).select("month_end", "strategy", "rolling_vol", "rolling_sharpe"), 7, rolling_sharpe=6)


def _performance(df: DataFrame) -> DataFrame:
    out = rounded(df, 8, sharpe=6, calmar=6, sortino=6)
    return single(out, *[c for c, t in out.dtypes if t == "double"])


@query(sql.performance("gn", "strategy"))
def q_performance(spark, sf_dir):
    return _performance(portfolio.performance(gross(spark, sf_dir)))


@query(sql.performance("nn", "strategy"))
def q_performance_net(spark, sf_dir):
    return _performance(portfolio.performance(net(spark, sf_dir)))


@query(
    """, b AS (SELECT month_end, ret AS b FROM p_r WHERE strategy = 'benchmark_ew'), j AS (SELECT strategy, ret, b FROM p_r JOIN b USING (month_end)),
k AS (SELECT strategy, covar_samp(ret, b) / var_pop(b) AS beta, avg(ret) AS mr, avg(b) AS mb, avg(ret - b) AS md, stddev_pop(ret - b) AS sd FROM j GROUP BY strategy)
SELECT strategy, round(beta, 6) AS beta, round((mr - beta * mb) * 12, 7) AS alpha_ann, round(md * sqrt(12.0) / CASE WHEN sd > 0 THEN sd END, 6) AS information_ratio FROM k"""
)
def q_relative_metrics(spark, sf_dir):
    return rounded(portfolio.relative_metrics(gross(spark, sf_dir)), 6, alpha_ann=7)


SPLIT = f"CASE WHEN month_end >= DATE '{sql.SPLITS['test_start']}' THEN 'test' WHEN month_end <= DATE '{sql.SPLITS['train_end']}' THEN 'train' WHEN month_end <= DATE '{sql.SPLITS['valid_end']}' THEN 'validation' ELSE 'holdout' END"


@query(
    f"""SELECT split, strategy, count(ret) AS periods, round(avg(ret), 8) AS mean_ret, round(stddev_pop(ret), 8) AS std_ret, round(ln(abs(nullif(product(1 + ret), 0))), 7) AS log_growth
FROM (SELECT *, {SPLIT} AS split FROM p_r) WHERE split <> 'holdout' GROUP BY split, strategy"""
)
def q_split_summary(spark, sf_dir):
    r = portfolio.split_summary(gross(spark, sf_dir), research.time_split("month_end", **sql.SPLITS))
    return rounded(r.withColumn("log_growth", F.ln(F.abs(F.nullif(1 + F.col("total_ret"), F.lit(0.0))))).drop("total_ret"), log_growth=7)


@query(
    f""", rs AS (SELECT sc.*, q.top_quantile FROM sc CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS top_quantile) q), {sql.portfolio('rb', 'rs', 'top_quantile', 'top_quantile')}, ro AS (SELECT * FROM rb_r WHERE strategy = 'long_short'), {sql.nav('rn', 'ro', 'top_quantile')}
SELECT top_quantile, count(ret) AS months, round(ln(abs(nullif(product(1 + ret), 0))), 6) AS final_nav, round(avg(ret), 8) AS mean_ret, round(stddev_pop(ret), 8) AS std_ret, round(min(drawdown), 7)::FLOAT::DOUBLE AS max_drawdown FROM rn GROUP BY top_quantile"""
)
def q_robustness(spark, sf_dir):
    r = portfolio.robustness(scores(spark, sf_dir), [0.1, 0.2, 0.3])
    r = r.withColumn("final_nav", F.ln(F.abs(F.nullif(F.col("final_nav"), F.lit(0.0)))))
    return single(rounded(r, final_nav=6, max_drawdown=7), "max_drawdown")


@query(
    """, ls AS (SELECT * FROM p_r WHERE strategy = 'long_short')
SELECT (SELECT month_end FROM ls ORDER BY ret DESC, month_end LIMIT 1) AS best_month, (SELECT round(max(ret), 8) FROM ls) AS best_ret, (SELECT month_end FROM ls ORDER BY ret, month_end LIMIT 1) AS worst_month, (SELECT round(min(ret), 8) FROM ls) AS worst_ret"""
)
def q_extreme_months(spark, sf_dir):
    return rounded(portfolio.extreme_months(gross(spark, sf_dir)))


# Stress and tuning


def stressed(spark, sf_dir, *only):
    b = written(cleaning.clean_daily(bars(spark, sf_dir)), "daily")
    p = written(factors.factor_panel(b), "panel")
    return stress.regimes(p, written(portfolio.scored_panel(p), "scores"), b, limit=40.0, only=only)


STRESS = f""", liq AS (SELECT month_end, symbol, CASE WHEN (rank() OVER (PARTITION BY month_end ORDER BY SIZE) + (count(*) OVER (PARTITION BY month_end, SIZE) - 1) / 2.0) / count(SIZE) OVER (PARTITION BY month_end) <= 0.2 THEN NULL ELSE score END AS score, fwd_1m_ret FROM sc),
{sql.portfolio('lq', 'liq')},
lim AS (SELECT sc.month_end, sc.symbol, CASE WHEN abs(l.ret * 100) >= 40 THEN NULL ELSE score END AS score, sc.fwd_1m_ret FROM sc LEFT JOIN lasts l ON l.symbol = sc.symbol AND l.month_end = sc.month_end),
{sql.portfolio('lm', 'lim')},
ms AS (SELECT month_end, row_number() OVER (ORDER BY month_end) AS m FROM p_n),
del AS (SELECT b.month_end, s.symbol, s.score, t.fwd_1m_ret FROM sc s JOIN ms a ON a.month_end = s.month_end JOIN ms b ON b.m = a.m + 1 LEFT JOIN sc t ON t.month_end = b.month_end AND t.symbol = s.symbol),
del2 AS (SELECT * FROM del UNION ALL SELECT month_end, NULL, NULL, NULL FROM p_n WHERE month_end NOT IN (SELECT month_end FROM del)),
{sql.portfolio('dl', 'del2')},
reg AS (SELECT month_end, 'gross_return' AS regime, ret FROM p_r WHERE strategy = 'long_short'
  UNION ALL SELECT month_end, 'net_return', ret FROM net WHERE strategy = 'long_short'
  UNION ALL SELECT r.month_end, 'high_cost_return', r.ret - t.turnover * 75.0 / 10000.0 FROM p_r r JOIN p_t t ON r.month_end = t.month_end AND r.strategy = t.strategy WHERE r.strategy = 'long_short'
  UNION ALL SELECT month_end, 'liquidity_stress_return', ret FROM lq_r WHERE strategy = 'long_short'
  UNION ALL SELECT month_end, 'price_limit_filtered_return', ret FROM lm_r WHERE strategy = 'long_short'
  UNION ALL SELECT month_end, 't_plus_one_delay_return', ret FROM dl_r WHERE strategy = 'long_short')"""


def _one_regime(*names: str):
    wanted = ", ".join(f"'{n}'" for n in names)

    def run(spark, sf_dir):
        return rounded(stressed(spark, sf_dir, *names).select("month_end", "regime", "ret"))

    return query(STRESS + f" SELECT month_end, regime, round(ret, 8) AS ret FROM reg WHERE regime IN ({wanted})"), run


for _name, _regimes in {
    "q_stress_net": ("gross_return", "net_return", "high_cost_return"),
    "q_stress_liquidity": ("liquidity_stress_return",),
    "q_stress_price_limit": ("price_limit_filtered_return",),
    "q_stress_t1": ("t_plus_one_delay_return",),
}.items():
    _add, _run = _one_regime(*_regimes)
    _run.__name__ = _name
    _add(_run)


@query(STRESS + f", {sql.nav('rgn', 'reg', 'regime')} {sql.performance('rgn', 'regime')}")
def q_stress_summary(spark, sf_dir):
    return _performance(stress.regime_summary(stressed(spark, sf_dir)))


def tuned(spark, sf_dir):
    return tuning.evaluate(panel(spark, sf_dir), tuning.grid(spark, **GRID), sql.SPLITS)


def _grid_values() -> str:
    import itertools

    rows = []
    for i, (r, p, q, w) in enumerate(itertools.product(*GRID.values())):
        own = {f: w.get(f"z_{f}", 0.0) for f in sql.BASE}
        size = sum(abs(x) for x in own.values())
        rows.append(f"({i}, {r}::DOUBLE, {p}::DOUBLE, {q}::DOUBLE, {', '.join(f'{own[f]}::DOUBLE' for f in sql.BASE)}, {size}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS g(candidate_id, risk_aversion, turnover_penalty, top_quantile, {', '.join(f'g_{f}' for f in sql.BASE)}, total)"


TUNING = f""", tsg AS (SELECT {', '.join(f"max(CASE WHEN factor = 'z_{f}' THEN sign END) AS s_{f}" for f in sql.BASE)} FROM (SELECT factor, CASE WHEN avg(ic) >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM sic WHERE month_end <= DATE '{sql.SPLITS['train_end']}' GROUP BY factor)),
tm AS (SELECT month_end, row_number() OVER (ORDER BY month_end) AS m FROM (SELECT DISTINCT month_end FROM z)),
tz AS (SELECT z.*, m, CASE WHEN count(fwd_1m_ret) OVER w >= 3 THEN stddev_pop(fwd_1m_ret) OVER w ELSE 0 END AS sd FROM z JOIN tm ON z.month_end = tm.month_end WINDOW w AS (PARTITION BY symbol ORDER BY m RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)),
grid AS (SELECT * FROM {_grid_values()}),
ts AS (SELECT candidate_id, top_quantile, month_end, symbol, fwd_1m_ret, round(({' + '.join(f'z_{f} * s_{f} * g_{f}' for f in sql.BASE)}) / total - risk_aversion * sd, 10) AS score FROM tz, tsg, grid),
{sql.portfolio('tp', 'ts', 'top_quantile', 'candidate_id')},
tr AS (SELECT r.candidate_id, r.month_end, t.turnover, r.ret - t.turnover * (15.0 + g.turnover_penalty * 100) / 10000.0 AS ret, {SPLIT.replace('month_end', 'r.month_end')} AS split
  FROM tp_r r JOIN tp_t t ON r.candidate_id = t.candidate_id AND r.month_end = t.month_end AND r.strategy = t.strategy JOIN grid g ON g.candidate_id = r.candidate_id WHERE r.strategy = 'long_short'),
th AS (SELECT * FROM tr WHERE split <> 'holdout'), {sql.nav('tn', 'th', 'candidate_id, split')},
tf AS (SELECT a.*, mean_turnover FROM ({sql.performance('tn', 'candidate_id, split')}) a JOIN (SELECT candidate_id, split, avg(turnover) AS mean_turnover FROM th GROUP BY ALL) b ON a.candidate_id = b.candidate_id AND a.split = b.split)"""
TUNED = "candidate_id, split, periods, ann_return, ann_vol, sharpe, max_drawdown, round(mean_turnover, 8)::FLOAT::DOUBLE AS mean_turnover"


@query(TUNING + f" SELECT {TUNED} FROM tf")
def q_tuning_grid(spark, sf_dir):
    return _performance(tuned(spark, sf_dir).select("candidate_id", "split", "periods", "ann_return", "ann_vol", "sharpe", "max_drawdown", "mean_turnover"))


@query(TUNING + f" SELECT {TUNED} FROM tf WHERE split = 'validation' ORDER BY tf.sharpe DESC NULLS LAST, tf.ann_return DESC NULLS LAST, candidate_id LIMIT 1")
def q_tuning_selected(spark, sf_dir):
    return _performance(tuning.select(rounded(tuned(spark, sf_dir), 8, sharpe=6)).select("candidate_id", "split", "periods", "ann_return", "ann_vol", "sharpe", "max_drawdown", "mean_turnover"))


# Registry


def registered(spark, sf_dir):
    s = scores(spark, sf_dir)
    w = portfolio.weights(s)
    g, t = portfolio.portfolio_returns(w, s), portfolio.turnover(w, s)
    mean = t.groupBy("strategy").agg(F.avg("turnover").alias("mean_turnover"))
    return registry.registry(
        registry.backtest_entries(portfolio.performance(g), mean, "gross", 0.0),
        registry.backtest_entries(portfolio.performance(portfolio.net_returns(g, t, 15.0)), mean, "net", 15.0),
    )


REGISTRY = f""", pg AS ({sql.performance('gn', 'strategy')}), pn AS ({sql.performance('nn', 'strategy')}), mt AS (SELECT strategy, round(avg(turnover), 8)::FLOAT::DOUBLE AS turnover FROM p_t GROUP BY strategy),
rg AS (SELECT 'gross' AS return_type, 0::DOUBLE AS transaction_cost_bps, * FROM pg UNION ALL SELECT 'net', 15::DOUBLE, * FROM pn)"""


@query(
    REGISTRY
    + """ SELECT 'factor_' || rg.strategy AS benchmark, 'factor_strategy' AS category, '' AS validation_method, return_type, '' AS model, rg.strategy, ann_return, sharpe, max_drawdown, turnover, transaction_cost_bps,
  NULL::DOUBLE AS auc, NULL::DOUBLE AS rank_ic, 'reporting_only' AS selection_role, 'backtest' AS source_file FROM rg JOIN mt ON rg.strategy = mt.strategy"""
)
def q_registry(spark, sf_dir):
    return _performance(registered(spark, sf_dir))


@query(
    REGISTRY
    + """ SELECT 'factor_' || g.strategy AS benchmark, g.strategy, g.ann_return AS gross, n.ann_return AS net, round(g.ann_return - n.ann_return, 3)::FLOAT::DOUBLE AS cost_drag FROM pg g JOIN pn n ON g.strategy = n.strategy"""
)
def q_gross_net(spark, sf_dir):
    return rounded_drag(registry.gross_net(_performance(registered(spark, sf_dir))))


def rounded_drag(df: DataFrame) -> DataFrame:
    return single(df.withColumn("cost_drag", F.round("cost_drag", 3)), "cost_drag")


# Validation and models

@query(
    """, mo AS (SELECT month_end, row_number() OVER (ORDER BY month_end) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT month_end FROM z)),
st AS (SELECT unnest(range(24, CAST(max(n) AS BIGINT), 6)) AS first_i FROM mo), sp AS (SELECT first_i, CAST(row_number() OVER (ORDER BY first_i) - 1 AS INTEGER) AS split_id FROM st)
SELECT split_id, CASE WHEN i < first_i THEN 'train' ELSE 'test' END AS role, month_end, 'purged' AS method, 1::INTEGER AS embargo_months FROM sp JOIN mo ON i < first_i - 1 OR (i >= first_i AND i < first_i + 6)"""
)
def q_walkforward_splits(spark, sf_dir):
    splits = validation.walk_forward(validation.panel_months(panel(spark, sf_dir)), 24, 6, "purged", 1)
    validation.assert_no_leakage(splits)
    return validation.split_table(spark, splits)


def predicted(spark, sf_dir, *models: str, method: str | tuple[str, ...] = "expanding") -> DataFrame:
    """Predictions of all splits, with the default features, least training months and test months."""
    v = Validation()
    return ml.walk_forward_predictions(panel(spark, sf_dir), FEATURES, models, v.min_train_months, v.test_window_months, method)[0]


@query()
def q_ml_linear(spark, sf_dir):
    return ml.evaluate(predicted(spark, sf_dir, "linear"))


COEFFICIENTS = f""", mo AS (SELECT month_end, row_number() OVER (ORDER BY month_end) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT month_end FROM z)),
st AS (SELECT unnest(range({Validation().min_train_months}, CAST(max(n) AS BIGINT), {Validation().test_window_months})) AS first_i FROM mo), sp AS (SELECT first_i, CAST(row_number() OVER (ORDER BY first_i) - 1 AS INTEGER) AS split_id FROM st),
cut AS (SELECT 'expanding' AS method, split_id, first_i AS least FROM sp UNION ALL SELECT 'purged', split_id, first_i - {Validation().embargo_months} FROM sp),
tr AS (SELECT method, split_id, count(*) AS n, avg(z_VALUE) AS mx, CASE WHEN stddev_pop(z_VALUE) > 0 THEN stddev_pop(z_VALUE) ELSE 1 END AS sx, avg(fwd_1m_ret) AS my, covar_pop(z_VALUE, fwd_1m_ret) * count(*) AS xy, var_pop(z_VALUE) * count(*) AS xx
  FROM cut JOIN mo ON mo.i < cut.least JOIN z ON z.month_end = mo.month_end GROUP BY ALL),
fit AS (SELECT 'linear' AS model, *, (xy / sx) / (xx / sx / sx) AS w FROM tr UNION ALL SELECT 'ridge', *, (xy / sx) / (xx / sx / sx + 1) FROM tr
  UNION ALL SELECT 'lasso', *, sign(xy) * greatest(abs(xy / sx) - 0.001 * n, 0) / (xx / sx / sx) FROM tr)
SELECT method, model, split_id, 'z_VALUE' AS feature, round(w, 8) AS coefficient, round(w / sx, 8) AS raw, round(my - w / sx * mx, 8) AS intercept FROM fit"""


@query(COEFFICIENTS)
def q_ml_coefficients(spark, sf_dir):
    """Coefficients of the least-squares models of one feature, all splits of both methods: they have a closed form."""
    v = Validation()
    _, _, fits = ml.split_fits(panel(spark, sf_dir), ["z_VALUE"], ("linear", "ridge", "lasso"), v.min_train_months, v.test_window_months, validation.METHODS, v.embargo_months)
    return rounded(linear.coefficient_table(spark, fits, ["z_VALUE"]))


@query()
def q_ml_ridge(spark, sf_dir):
    return ml.evaluate(predicted(spark, sf_dir, "ridge", "lasso"))


@query()
def q_ml_logistic(spark, sf_dir):
    return ml.evaluate(predicted(spark, sf_dir, "logistic"))


@query()
def q_ml_trees(spark, sf_dir):
    return ml.evaluate(predicted(spark, sf_dir, "random_forest", "gradient_boosting", method="purged"))


@query()
def q_ml_portfolios(spark, sf_dir):
    return portfolio.performance(ml.score_portfolios(predicted(spark, sf_dir, "ridge")), ("method", "model", "strategy"))


@query()
def q_validation_cmp(spark, sf_dir):
    return ml.compare_methods(ml.evaluate(predicted(spark, sf_dir, "ridge", method=validation.METHODS)))


def fixed_predictions(spark, sf_dir) -> DataFrame:
    """z_VALUE as a prediction, to check the metrics."""
    p = ml.dataset(panel(spark, sf_dir), ["z_VALUE"])
    return p.select("month_end", "symbol", F.lit("value").alias("model"), F.lit("none").alias("method"), F.round("z_VALUE", 6).alias("score"), F.col("fwd_1m_ret").alias("target"), "target_class")


FIXED = """, fx AS (SELECT month_end, symbol, round(z_VALUE, 6) AS score, fwd_1m_ret AS target, CAST(fwd_1m_ret > 0 AS INTEGER) AS c FROM z)"""


@query(
    FIXED
    + """, fr AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS rt FROM fx)
SELECT 'none' AS method, 'value' AS model, round((sum(rs * c) - sum(c) * (sum(c) + 1) / 2.0) / (sum(c) * (count(*) - sum(c))), 7) AS auc, round(covar_pop(rs, rt) / (stddev_pop(rs) * stddev_pop(rt)), 7) AS rank_ic FROM fr"""
)
def q_ml_auc(spark, sf_dir):
    return rounded(ml.evaluate(fixed_predictions(spark, sf_dir)).select("method", "model", "auc", "rank_ic"), 7)


@query(FIXED + """ SELECT 'value' AS model, round(avg(c), 8) AS precision_top FROM (SELECT *, row_number() OVER (ORDER BY score DESC, month_end, symbol) AS k, count(*) OVER () AS n FROM fx) WHERE k <= greatest(1, round_even(n * 0.2, 0))""")
def q_ml_precision_top(spark, sf_dir):
    return rounded(ml.evaluate(fixed_predictions(spark, sf_dir)).select("model", "precision_top"))


@query(FIXED + " SELECT 'value' AS model, count(*) AS n, round(sqrt(avg(pow(score - target, 2))), 7) AS rmse, round(avg(abs(score - target)), 7) AS mae FROM fx")
def q_ml_errors(spark, sf_dir):
    return rounded(ml.evaluate(fixed_predictions(spark, sf_dir)).select("model", "n", "rmse", "mae"), 7)


# Decision


def decided(spark, sf_dir) -> DataFrame:
    return decision.optimize_panel(decision.score_panels(panel(spark, sf_dir)))


@query()
def q_decision_weights(spark, sf_dir):
    return decision.long_weights(decided(spark, sf_dir))


@query()
def q_decision_returns(spark, sf_dir):
    return decision.month_returns(decided(spark, sf_dir))


@query(
    """, nm AS MATERIALIZED (SELECT symbol, month_end, fwd_1m_ret FROM z), cg AS MATERIALIZED (SELECT m.month_end, s.symbol, coalesce(n.fwd_1m_ret, 0) AS r, n.symbol IS NOT NULL AS here FROM (SELECT DISTINCT month_end FROM nm) m CROSS JOIN (SELECT DISTINCT symbol FROM nm) s LEFT JOIN nm n ON n.month_end = m.month_end AND n.symbol = s.symbol),
ct AS (SELECT *, sum(r) OVER (PARTITION BY month_end) AS total FROM cg),
cp AS (SELECT month_end, symbol, here, count(*) OVER w AS k, var_samp(r) OVER w AS var, covar_samp(r, total) OVER w AS cov_all FROM ct WINDOW w AS (PARTITION BY symbol ORDER BY month_end ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT month_end, symbol, round(var, 6)::FLOAT::DOUBLE AS var, round(cov_all, 4)::FLOAT::DOUBLE AS cov_all FROM cp WHERE here AND k > 1"""
)
def q_trailing_cov(spark, sf_dir):
    """Each symbol's trailing variance and its covariances' sum; all pairs would be symbols squared for each month."""
    return single(rounded(decision.trailing_risk(panel(spark, sf_dir)), 6, cov_all=4), "var", "cov_all")


# Sources


@query(
    """, d AS (SELECT symbol, date, CAST(symbol AS BIGINT) % 8 AS i, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM bars),
c AS (SELECT symbol, date, i, t, (10 + i) * pow(1 + (1 + 0.00015::DOUBLE * i) * 0.0005::DOUBLE, t) * (1 + 0.02::DOUBLE * sin(t / 19.0::DOUBLE + i)) AS close FROM d)
SELECT symbol, date, round(close * 0.999::DOUBLE, 6) AS open, round(close * 1.01::DOUBLE, 6) AS high, round(close * 0.99::DOUBLE, 6) AS low, round(close, 6) AS close, CAST(100000 + 1000 * i + 10 * t AS DOUBLE) AS volume,
  round(close * (100000 + 1000 * i + 10 * t), 2) AS amount, round((close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1) * 100, 6) AS pct_chg FROM c"""
)
def q_sample_panel(spark, sf_dir):
    """Made-up prices for every symbol and day of the bars."""
    return rounded(sources.sample_like(bars(spark, sf_dir)), 6, amount=2)


@query(
    """, h AS (SELECT min(ret) AS lo, max(ret) AS hi FROM ret), b AS (SELECT CAST(least(floor((ret - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin FROM ret, h WHERE ret IS NOT NULL)
SELECT bin, count(*) AS count FROM b GROUP BY bin"""
)
def q_return_histogram(spark, sf_dir):
    return sinks.histogram(returns(spark, sf_dir), "ret", 20).select("bin", "count")


def box_sql(keys: str, source: str = "ret") -> str:
    head, using = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    group = f"GROUP BY {keys}" if keys else ""
    return f""", x AS (SELECT {head}ret AS v FROM {source} WHERE ret IS NOT NULL), b AS (SELECT {head}quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM x {group} HAVING count(*) > 0),
i AS (SELECT {head}v, q1, med, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM x JOIN b {using})
SELECT {head}count(*) AS n, round(avg(v), 8) AS mean, round(any_value(q1), 8) AS q1, round(any_value(med), 8) AS median, round(any_value(q3), 8) AS q3, round(least(min(v) FILTER (WHERE inside), any_value(q1)), 8) AS whisker_low,
  round(greatest(max(v) FILTER (WHERE inside), any_value(q3)), 8) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM i {group}"""


@query(box_sql(""))
def q_box_stats(spark, sf_dir):
    return rounded(plots.box_stats(returns(spark, sf_dir), "ret"))


@query(box_sql("symbol"))
def q_box_stats_by_symbol(spark, sf_dir):
    return rounded(plots.box_stats(returns(spark, sf_dir), "ret", "symbol"))


@query(
    f""", v AS (SELECT round({sql.least_frame('stddev_pop(ret)', 20, 20)} * sqrt(252.0), 7) AS x, round(ret, 8) AS y FROM ret), p AS (SELECT x, y FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT min(x) AS x0, (max(x) - min(x)) / 40 AS xw, min(y) AS y0, (max(y) - min(y)) / 40 AS yw FROM p)
SELECT CAST(least(floor((x - x0) / xw), 39) AS INTEGER) AS x_bin, CAST(least(floor((y - y0) / yw), 39) AS INTEGER) AS y_bin, count(*) AS count FROM p, e GROUP BY 1, 2"""
)
def q_scatter_bins(spark, sf_dir):
    """Volatility against return, all rows in 40 x 40 bins."""
    rows = indicators.volatility(returns(spark, sf_dir)).select(F.round("vol_20", 7).alias("vol_20"), F.round("ret", 8).alias("ret"))
    return plots.scatter_bins(rows, "vol_20", "ret").select("x_bin", "y_bin", "count")
