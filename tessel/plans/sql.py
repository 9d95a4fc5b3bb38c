"""The same relations as the operators, in SQL that DuckDB runs: one chain of common table expressions."""

from __future__ import annotations

FACTORS = ("VALUE", "MOM_12_1", "QUALITY", "SIZE", "REVERSAL_1M", "VOL_1M", "ILLIQUIDITY")
BASE = FACTORS[:4]
SPLITS = {"train_end": "1998-12-31", "valid_end": "1999-12-31", "test_start": "2000-01-01"}
STRATEGIES = ("long_only", "short_only", "long_short", "benchmark_ew")


def least_frame(fn: str, n: int, least: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = fn[fn.index("(") + 1 : -1]
    return f"CASE WHEN count({value}) {frame} >= {least} THEN {fn} {frame} END"


def zscores() -> str:
    clip = ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, quantile_cont({f}, 0.01) OVER m), quantile_cont({f}, 0.99) OVER m) END AS w_{f}" for f in FACTORS
    )
    z = ", ".join(
        f"(w_{f} - avg(w_{f}) OVER m) / CASE WHEN coalesce(stddev_pop(w_{f}) OVER m, 0) = 0 THEN 1.0 ELSE stddev_pop(w_{f}) OVER m END AS z_{f}" for f in FACTORS
    )
    return (
        f"clipped AS (SELECT *, {clip} FROM raw WINDOW m AS (PARTITION BY month_end)),\n"
        f"z AS (SELECT symbol, month_end, close_me, fwd_1m_ret, {', '.join(FACTORS)}, {z} FROM clipped WINDOW m AS (PARTITION BY month_end))"
    )


def ranked(name: str, source: str, value: str, ret: str, keys: str) -> str:
    """Average ranks of value and ret within keys, of rows with both."""
    return f"""{name} AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY {keys} ORDER BY {ret}) + (count(*) OVER (PARTITION BY {keys}, {ret}) - 1) / 2.0 AS rr
  FROM {source} WHERE {value} IS NOT NULL AND {ret} IS NOT NULL)"""


CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
LONG_Z = " UNION ALL ".join(f"SELECT symbol, month_end, close_me, fwd_1m_ret, 'z_{f}' AS factor, z_{f} AS value FROM z" for f in FACTORS)


def portfolio(name: str, source: str, q: str = "0.2", keys: str = "") -> str:
    """CTEs {name}_w (weights), {name}_r (returns), {name}_t (turnover), {name}_n (months) from (keys, month_end, symbol, score, fwd_1m_ret)."""
    k = f"{keys}, " if keys else ""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    size = f"greatest(1, CAST(round_even(n * {q}, 0) AS INTEGER))"
    unpivot = " UNION ALL ".join(f"SELECT {k}month_end, '{s}' AS strategy, {s} AS {{v}} FROM {{t}}" for s in STRATEGIES)
    turn = ", ".join(f"sum(abs({s} - coalesce(p_{s}, 0))) / 2 AS {s}" for s in STRATEGIES)
    grid_cols = ", ".join(f"coalesce({s}, 0) AS {s}" for s in STRATEGIES)
    lags = ", ".join(f"lag({s}) OVER (PARTITION BY {k}symbol ORDER BY month_end) AS p_{s}" for s in STRATEGIES)
    return f"""{name}_n AS (SELECT DISTINCT {k}month_end FROM {source}),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {k}month_end ORDER BY score DESC, symbol) AS r, count(*) OVER (PARTITION BY {k}month_end) AS n FROM {source} WHERE score IS NOT NULL),
{name}_s AS (SELECT *, {size} AS top FROM {name}_k),
{name}_w AS (SELECT *, CASE WHEN r <= top THEN CAST(1 AS DOUBLE) / least(top, n) ELSE CAST(0 AS DOUBLE) END AS long_only, CASE WHEN r > n - top THEN CAST(1 AS DOUBLE) / least(top, n) ELSE CAST(0 AS DOUBLE) END AS short_only,
  CASE WHEN r <= top THEN CAST(1 AS DOUBLE) / least(top, n) ELSE CAST(0 AS DOUBLE) END - CASE WHEN r > n - top THEN CAST(1 AS DOUBLE) / least(top, n) ELSE CAST(0 AS DOUBLE) END AS long_short, CAST(1 AS DOUBLE) / n AS benchmark_ew FROM {name}_s),
{name}_a AS (SELECT {k}month_end, {', '.join(f'sum({s} * coalesce(fwd_1m_ret, 0)) AS {s}' for s in ('long_only', 'short_only', 'benchmark_ew'))} FROM {name}_w GROUP BY {k}month_end),
{name}_x AS (SELECT {f'a.{keys}, ' if keys else ''}a.month_end, coalesce(long_only, 0) AS long_only, coalesce(short_only, 0) AS short_only, coalesce(long_only, 0) - coalesce(short_only, 0) AS long_short, coalesce(benchmark_ew, 0) AS benchmark_ew
  FROM {name}_n a LEFT JOIN {name}_a b ON {on}a.month_end = b.month_end),
{name}_r AS ({unpivot.format(v='ret', t=f'{name}_x')}),
{name}_g AS (SELECT n.*, s.symbol FROM {name}_n n CROSS JOIN (SELECT DISTINCT symbol FROM {source}) s),
{name}_d AS (SELECT {f'a.{keys}, ' if keys else ''}a.month_end, a.symbol, {grid_cols} FROM {name}_g a LEFT JOIN {name}_w b ON {on}a.month_end = b.month_end AND a.symbol = b.symbol),
{name}_l AS (SELECT *, {lags} FROM {name}_d),
{name}_y AS (SELECT {k}month_end, {turn} FROM {name}_l GROUP BY {k}month_end),
{name}_t AS ({unpivot.format(v='turnover', t=f'{name}_y')})"""


def nav(name: str, source: str, keys: str = "strategy") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY month_end ROWS UNBOUNDED PRECEDING)"
    return f"""{name}_nav AS (SELECT *, product(1 + ret) {w} AS nav FROM {source}),
{name} AS (SELECT *, nav / max(nav) {w} - 1 AS drawdown FROM {name}_nav)"""


def performance(source: str, keys: str) -> str:
    """Metrics from a relation with ret and drawdown."""
    return f"""SELECT {keys}, periods, round(a, 8)::FLOAT::DOUBLE AS ann_return, round(v, 8)::FLOAT::DOUBLE AS ann_vol, round(a / CASE WHEN v > 1e-12 THEN v END, 6)::FLOAT::DOUBLE AS sharpe, round(d, 8)::FLOAT::DOUBLE AS max_drawdown,
  round(a / CASE WHEN d < -1e-12 THEN -d END, 6)::FLOAT::DOUBLE AS calmar, round(a / CASE WHEN s > 1e-12 THEN s END, 6)::FLOAT::DOUBLE AS sortino
FROM (SELECT {keys}, count(ret) AS periods, CASE WHEN product(1 + ret) >= 0 THEN pow(product(1 + ret), 12.0 / count(ret)) - 1 END AS a, stddev_pop(ret) * sqrt(12.0) AS v,
  min(drawdown) AS d, stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(12.0) AS s FROM {source} GROUP BY {keys})"""


RETURNS = """px AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px,
  (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord, l_quantity, l_extendedprice FROM lineitem),
bars AS (SELECT symbol, date, min_by(px, ord) AS open, max(px) AS high, min(px) AS low, max_by(px, ord) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM px GROUP BY symbol, date),
ret AS (SELECT *, lag(close) OVER d AS prev, close / lag(close) OVER d - 1 AS ret FROM bars WINDOW d AS (PARTITION BY symbol ORDER BY date))"""

CHAIN = f"""{RETURNS},
illiq AS (SELECT *, abs(ret) / nullif(amount, 0) AS il FROM ret),
daily AS (SELECT *, {least_frame('avg(amount)', 21, 10)} AS avg_dv_21, {least_frame('avg(close)', 252, 126)} AS ma_252,
  {least_frame('avg(ret)', 63, 40)} / nullif({least_frame('stddev_pop(ret)', 63, 40)}, 0) AS sharpe_3m, {least_frame('stddev_pop(ret)', 21, 15)} AS vol_21, {least_frame('avg(il)', 21, 15)} AS illiq_21 FROM illiq),
lasts AS (SELECT *, last_day(date) AS month_end FROM daily QUALIFY row_number() OVER (PARTITION BY symbol, last_day(date) ORDER BY date DESC) = 1),
m1 AS (SELECT *, close / lag(close) OVER d - 1 AS ret_1m, lag(close, 1) OVER d / nullif(lag(close, 12) OVER d, 0) - 1 AS mom FROM lasts WINDOW d AS (PARTITION BY symbol ORDER BY month_end)),
monthly AS (SELECT *, lead(ret_1m) OVER (PARTITION BY symbol ORDER BY month_end) AS fwd_1m_ret FROM m1),
gated AS (SELECT symbol, month_end, close AS close_me, fwd_1m_ret, (ma_252 - close) / nullif(ma_252, 0) AS VALUE, mom AS MOM_12_1, sharpe_3m AS QUALITY, ln(CASE WHEN avg_dv_21 > 0 THEN avg_dv_21 END) AS SIZE,
  -ret_1m AS REVERSAL_1M, -vol_21 AS VOL_1M, -ln(CASE WHEN illiq_21 > 0 THEN illiq_21 END) AS ILLIQUIDITY FROM monthly WHERE date = month_end),
raw AS (SELECT * FROM gated WHERE fwd_1m_ret IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in BASE)}),
{zscores()},
lz AS ({LONG_Z}),
{ranked('icr', 'lz', 'value', 'fwd_1m_ret', 'month_end, factor')},
ic AS (SELECT month_end, factor, {CORR.format(a='rv', b='rr')} AS ic FROM icr GROUP BY month_end, factor HAVING count(*) >= 3),
sic AS (SELECT month_end, factor, {CORR.format(a='rv', b='rr')} AS ic FROM icr GROUP BY month_end, factor),
signs AS (SELECT factor, avg(ic) AS ic_mean, CASE WHEN avg(ic) >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM sic WHERE factor IN ({', '.join(f"'z_{f}'" for f in BASE)}) GROUP BY factor),
sg AS (SELECT {', '.join(f"max(CASE WHEN factor = 'z_{f}' THEN sign END) AS s_{f}" for f in BASE)} FROM signs),
sc AS (SELECT month_end, symbol, round({' + '.join(f'z_{f} * s_{f} * 0.25' for f in BASE)}, 10) AS score, fwd_1m_ret, SIZE FROM z, sg),
{portfolio('p', 'sc')},
net AS (SELECT r.month_end, r.strategy, r.ret - coalesce(t.turnover, 0) * 15.0 / 10000.0 AS ret FROM p_r r LEFT JOIN p_t t ON r.month_end = t.month_end AND r.strategy = t.strategy),
{nav('gn', 'p_r')},
{nav('nn', 'net')}"""
