"""Monthly factors from daily bars.

All daily windows share one exchange on symbol; the month's last bar is known from the next bar's date, so monthly
sampling needs no join and no further exchange. Trailing statistics of up to a year are computed at months' ends alone:
a sliding window would go over its whole frame again for every day. Cross-sections exchange once on month_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.crosssections import is_large, with_rank, with_zscores
from tessel.functions.tables import written
from tessel.functions.trailing import STATISTICS, month_ends
from tessel.functions.windows import by, pair_corr, positive_ln, ratio, rolling, with_change

BASE = ("VALUE", "MOM_12_1", "QUALITY", "SIZE")
ENHANCED = ("REVERSAL_1M", "VOL_1M", "ILLIQUIDITY")
FACTORS = (*BASE, *ENHANCED)


def days():
    return by("symbol", order="date")


def months():
    return by("symbol", order="month_end")


def dollar_volume(df: DataFrame, amounts: bool | None = None) -> DataFrame:
    """dollar_vol: amount where the column has any value, else close times volume. amounts tells whether it has; by default df is asked."""
    known = df.where(F.col("amount").isNotNull()).select(F.lit(1)).take(1) if amounts is None else amounts
    return df.withColumn("dollar_vol", F.col("amount") if known else F.col("close") * F.col("volume"))


def daily_windows(df: DataFrame) -> DataFrame:
    """Trailing statistics that factors are read from at a month's end."""
    out = with_change(dollar_volume(df), "close", "ret_d", days())
    out = out.withColumn("__illiq", ratio(F.abs("ret_d"), F.col("dollar_vol")))
    return out.withColumns(
        {
            "avg_dv_21": rolling(F.avg, F.col("dollar_vol"), days(), 21, 10),
            "ma_252": rolling(F.avg, F.col("close"), days(), 252, 126),
            "__mu": rolling(F.avg, F.col("ret_d"), days(), 63, 40),
            "__sd": rolling(F.stddev_pop, F.col("ret_d"), days(), 63, 40),
            "vol_21": rolling(F.stddev_pop, F.col("ret_d"), days(), 21, 15),
            "illiq_21": rolling(F.avg, F.col("__illiq"), days(), 21, 15),
        }
    ).withColumn("sharpe_3m", ratio(F.col("__mu"), F.col("__sd"))).drop("__illiq", "__mu", "__sd")


def monthly_windows(df: DataFrame, amounts: bool | None = None, strict: bool = True) -> DataFrame:
    """symbol, date, month_end, close of each month's last bar, and daily_windows' statistics there; strict: only where that is the month's end."""
    following, end = F.lead("date").over(days()), F.last_day("date")
    rows = dollar_volume(df, amounts).select("symbol", "date", end.alias("month_end"), (following.isNull() | (F.last_day(following) != end)).alias("last"), "close", "dollar_vol")
    numbers = ", ".join(f"{c} double" for c in ("close", *STATISTICS))
    # the window has brought each symbol's days into one task in their order; the sort states it and costs nothing more
    return rows.sortWithinPartitions("symbol", "date").mapInArrow(month_ends(strict), f"symbol {dict(df.dtypes)['symbol']}, date date, month_end date, {numbers}")


def monthly_last(df: DataFrame) -> DataFrame:
    """The last bar of each symbol and month, with month_end (the calendar month's last day)."""
    following = F.lead("date").over(days())
    last = following.isNull() | (F.last_day(following) != F.last_day("date"))
    return df.withColumn("__last", last).where("__last").drop("__last").withColumn("month_end", F.last_day("date"))


def with_monthly_returns(monthly: DataFrame) -> DataFrame:
    """ret_1m and fwd_1m_ret over traded months."""
    out = with_change(monthly, "close", "ret_1m", months())
    return out.withColumn("fwd_1m_ret", F.lead("ret_1m").over(months()))


def monthly_closes(df: DataFrame) -> DataFrame:
    out = with_monthly_returns(monthly_last(df))
    return out.select("symbol", "month_end", F.col("close").alias("close_me"), F.col("volume").alias("vol_me"), F.col("amount").alias("amt_me"), "fwd_1m_ret", "ret_1m")


def raw_factors(df: DataFrame, enhanced: bool = True, month_end_mode: str = "strict", amounts: bool | None = None) -> DataFrame:
    """symbol, month_end, close_me, fwd_1m_ret and factors; rows without a forward return or a base factor drop out.

    strict: a factor exists only where the calendar month's end was traded. last_bar: at each month's last bar.
    """
    m = with_monthly_returns(monthly_windows(df, amounts, month_end_mode == "strict"))
    m = m.withColumn("MOM_12_1", ratio(F.lag("close", 1).over(months()), F.lag("close", 12).over(months())) - 1)
    if month_end_mode == "strict":
        m = m.where("date = month_end")
    out = {
        "SIZE": positive_ln(F.col("avg_dv_21")),
        "VALUE": ratio(F.col("ma_252") - F.col("close"), F.col("ma_252")),
        "QUALITY": F.col("sharpe_3m"),
        "REVERSAL_1M": -F.col("ret_1m"),
        "VOL_1M": -F.col("vol_21"),
        "ILLIQUIDITY": -positive_ln(F.col("illiq_21")),
    }
    names = FACTORS if enhanced else BASE
    rows = m.withColumns(out).select("symbol", "month_end", F.col("close").alias("close_me"), "fwd_1m_ret", *names)
    return rows.na.drop(subset=["fwd_1m_ret", *BASE])


def standardize(panel: DataFrame, factors: tuple[str, ...] = FACTORS, p: float = 0.01) -> DataFrame:
    """z_ columns: clipped to the month's [p, 1 - p] quantiles, then to zero mean and unit population deviation."""
    spread = is_large(panel, "month_end")
    return with_zscores(written(panel, "raw") if spread else panel, factors, p, "month_end", spread=spread)


def factor_panel(bars: DataFrame, p: float = 0.01, amounts: bool | None = None) -> DataFrame:
    """raw_factors and their z-scores. Raw factors are written: months' sizes, bounds and moments would each compute them anew."""
    return with_zscores(written(raw_factors(bars, amounts=amounts), "raw"), FACTORS, p, "month_end")


def long_factors(panel: DataFrame, columns: list[str], keep: tuple[str, ...] = ("symbol", "month_end", "fwd_1m_ret")) -> DataFrame:
    """One row per (row, factor): keep columns, factor, value."""
    return panel.unpivot(list(keep), columns, "factor", "value")


def rank_ic(panel: DataFrame, columns: list[str], ret: str = "fwd_1m_ret", least: int = 3, joint: bool = True) -> DataFrame:
    """month_end, factor, ic: correlation of average ranks of factor and return, over rows with both.

    joint=False ranks every value of either column, with no least count, as signs are computed.
    """
    rows = long_factors(panel, columns, ("symbol", "month_end", ret))
    if joint:
        rows = rows.where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    spread, keys = is_large(panel, "month_end"), ("month_end", "factor")
    rows = written(rows, "values") if spread else rows
    ranked = with_rank(with_rank(rows, "value", "rv", *keys, spread=spread), ret, "rr", *keys, spread=spread)
    out = ranked.groupBy("month_end", "factor").agg(F.count(F.lit(1)).alias("n"), pair_corr(F.col("rv"), F.col("rr")).alias("ic"))
    return out.where(F.col("n") >= (least if joint else 0)).drop("n")


def ic_summary(ic: DataFrame, *more: str) -> DataFrame:
    """mean, deviation (ddof 1), count and ICIR by factor (and more keys)."""
    out = ic.groupBy("factor", *more).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("ic_count"))
    return out.withColumn("icir", ratio(F.col("ic_mean"), F.col("ic_std")))


def correlation_matrix(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """(a, b, corr) of every ordered pair, over complete pairs, null under `least` of them; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cell = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _guarded(a, b, least).alias("corr"))
    upper = df.agg(*[cell(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    flat = upper.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")
    return flat.unionByName(flat.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))


def _guarded(a: str, b: str, least: int) -> Column:
    return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= least, pair_corr(F.col(a), F.col(b)))


def cumulative_ic(ic: DataFrame) -> DataFrame:
    """Running sum of each factor's IC, for plots."""
    w = Window.partitionBy("factor").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    return ic.withColumn("cum_ic", F.sum("ic").over(w))
