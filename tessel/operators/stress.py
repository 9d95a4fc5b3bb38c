"""Market-friction variants of the long-short return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.crosssections import is_large, with_percent_rank
from tessel.operators import portfolio
from tessel.operators.factors import monthly_last


def _long_short(scores: DataFrame, months: DataFrame, q: float, spread: bool | None = None) -> DataFrame:
    return portfolio.portfolio_returns(portfolio.weights(scores, q, spread=spread), months).where("strategy = 'long_short'").select("month_end", "ret")


def liquidity_filtered(scores: DataFrame, size: DataFrame, cut: float = 0.2) -> DataFrame:
    """score becomes null where SIZE's percent rank in the month is at most `cut`."""
    ranked = with_percent_rank(size, "SIZE", "__p", "month_end").select("month_end", "symbol", "__p")
    return scores.join(ranked, ["month_end", "symbol"], "left").withColumn("score", F.when(F.coalesce(F.col("__p") <= cut, F.lit(False)), None).otherwise(F.col("score"))).drop("__p")


def price_limit_filtered(scores: DataFrame, bars: DataFrame, limit: float = 9.5) -> DataFrame:
    """score becomes null where the month's last bar moved by `limit` percent or more."""
    if "pct_chg" not in bars.columns:
        return scores
    last = monthly_last(bars).select("month_end", "symbol", (F.abs("pct_chg") >= limit).alias("__locked"))
    return scores.join(last, ["month_end", "symbol"], "left").withColumn("score", F.when(F.coalesce("__locked", F.lit(False)), None).otherwise(F.col("score"))).drop("__locked")


def delayed(scores: DataFrame) -> DataFrame:
    """Each symbol's score of the panel's previous month; a symbol absent then has none.

    Rows exist for the months that follow one with a score, so no dense grid is made.
    """
    steps = scores.select("month_end").distinct().withColumn("__m", F.row_number().over(Window.orderBy("month_end")))
    numbered = scores.join(F.broadcast(steps), "month_end")
    moved = numbered.select((F.col("__m") + 1).alias("__m"), "symbol", "score").join(F.broadcast(steps), "__m").select("month_end", "symbol", "score")
    return moved.join(scores.select("month_end", "symbol", "fwd_1m_ret"), ["month_end", "symbol"], "left")


def regimes(panel: DataFrame, scores: DataFrame, bars: DataFrame, q: float = 0.2, cost: float = 15.0, high_cost: float = 75.0, cut: float = 0.2, limit: float = 9.5, only: tuple[str, ...] = ()) -> DataFrame:
    """month_end, regime, ret of the six variants, or of those named; others are not planned.

    No variant has a larger month than the largest of `scores`, so months' sizes are counted once for all.
    """
    spread = is_large(scores, "month_end")

    def gross() -> DataFrame:
        return _long_short(scores, scores, q, spread)

    def charged(bps: float) -> DataFrame:
        turn = portfolio.turnover(portfolio.weights(scores, q, spread=spread), scores).where("strategy = 'long_short'").select("month_end", "turnover")
        return gross().join(turn, "month_end", "left").select("month_end", (F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * bps / 10000.0).alias("ret"))

    parts = {
        "gross_return": gross,
        "net_return": lambda: charged(cost),
        "high_cost_return": lambda: charged(high_cost),
        "liquidity_stress_return": lambda: _long_short(liquidity_filtered(scores, panel, cut), scores, q, spread),
        "price_limit_filtered_return": lambda: _long_short(price_limit_filtered(scores, bars, limit), scores, q, spread),
        "t_plus_one_delay_return": lambda: _long_short(delayed(scores), scores, q, spread),
    }
    return reduce(DataFrame.unionByName, [part().withColumn("regime", F.lit(k)) for k, part in parts.items() if not only or k in only])


def regime_summary(returns: DataFrame) -> DataFrame:
    return portfolio.performance(returns, ("regime",))
