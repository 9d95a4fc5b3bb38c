"""Scores, baskets, returns, turnover, costs and performance, all in long form: (month_end, symbol, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.crosssections import with_place
from tessel.functions.windows import ratio
from tessel.operators.factors import BASE, rank_ic

SCORED = tuple(f"z_{f}" for f in BASE)
STRATEGIES = ("long_only", "short_only", "long_short", "benchmark_ew")


def factor_signs(panel: DataFrame, columns: tuple[str, ...] = SCORED, ret: str = "fwd_1m_ret") -> DataFrame:
    """factor, ic_mean, sign: +1 for a mean monthly rank IC of zero or more, else -1 (also without an IC)."""
    ic = rank_ic(panel, list(columns), ret, joint=False)
    return ic.groupBy("factor").agg(F.avg("ic").alias("ic_mean")).withColumn("sign", F.when(F.col("ic_mean") >= 0, 1.0).otherwise(-1.0))


def sign_values(signs: DataFrame) -> dict[str, float]:
    return {r["factor"]: r["sign"] for r in signs.collect()}  # one row per factor


def flip(panel: DataFrame, signs: dict[str, float]) -> DataFrame:
    return panel.withColumns({c: F.col(c) * F.lit(s) for c, s in signs.items() if c in panel.columns})


def normalized_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Weights of the scored columns, by sum of sizes; other names drop out."""
    own = {c: 1.0 for c in SCORED} if weights is None else {c: float(w) for c, w in weights.items() if c in SCORED}
    if not own:
        raise ValueError("no valid factor weights")
    total = sum(abs(w) for w in own.values())
    if not total:
        raise ValueError("all factor weights are zero")
    return {c: own.get(c, 0.0) / total for c in SCORED}


#: Decimals of a score: sums of distributed rows differ in their last bits, and ties must not.
DECIMALS = 10


def score(panel: DataFrame, weights: dict[str, float] | None = None, out: str = "score", decimals: int = DECIMALS) -> DataFrame:
    """Weighted sum of all scored columns; a null in any of them makes the score null."""
    total: Column | None = None
    for c, w in normalized_weights(weights).items():
        term = F.col(c) * F.lit(w)
        total = term if total is None else total + term
    return panel.withColumn(out, F.round(total, decimals))


def flip_by(panel: DataFrame, signs: DataFrame) -> DataFrame:
    """flip with the signs of factor_signs, in the same plan: a single row joins the panel."""
    row = signs.agg(*[F.max(F.when(F.col("factor") == c, F.col("sign"))).alias(f"__s_{c}") for c in SCORED])
    return panel.crossJoin(F.broadcast(row)).withColumns({c: F.col(c) * F.col(f"__s_{c}") for c in SCORED}).drop(*[f"__s_{c}" for c in SCORED])


def scored_panel(panel: DataFrame, weights: dict[str, float] | None = None, sign_flip: bool = True) -> DataFrame:
    """month_end, symbol, score, fwd_1m_ret."""
    if sign_flip:
        panel = flip_by(panel, factor_signs(panel))
    return score(panel, weights).select("month_end", "symbol", "score", "fwd_1m_ret")


def placed(scores: DataFrame, keys: tuple[str, ...] = (), spread: bool | None = None) -> DataFrame:
    """Every scored row with its place __r in the month, descending by score, ties by symbol, and the month's scored rows __n."""
    return with_place(scores.where(F.col("score").isNotNull()), [-F.col("score"), F.col("symbol")], "__r", "__n", *keys, "month_end", spread=spread)


def weights(scores: DataFrame, q: float | str = 0.2, keys: tuple[str, ...] = (), spread: bool | None = None) -> DataFrame:
    """keys, month_end, symbol, w_long, w_short, w_ew of every scored row; q may name a column. spread only chooses the plan of places."""
    return baskets(placed(scores, keys, spread), q)


def baskets(ranked: DataFrame, q: float | str) -> DataFrame:
    """Weights of placed rows; a basket holds the rounded (half to even) share q of the names, one at least."""
    share = F.col(q) if isinstance(q, str) else F.lit(q)
    ranked = ranked.withColumn("__top", F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("int")))
    size = F.least("__top", "__n")
    weight = lambda held, of: F.when(held, 1.0 / of).otherwise(0.0)
    return ranked.withColumns(
        {
            "w_long": weight(F.col("__r") <= F.col("__top"), size),
            "w_short": weight(F.col("__r") > F.col("__n") - F.col("__top"), size),
            "w_ew": 1.0 / F.col("__n"),
        }
    ).drop("__r", "__n", "__top")


def long_weights(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, month_end, symbol, strategy, weight."""
    cells = F.array(
        *[F.struct(F.lit(s).alias("strategy"), v.alias("weight")) for s, v in zip(STRATEGIES, (F.col("w_long"), F.col("w_short"), F.col("w_long") - F.col("w_short"), F.col("w_ew")))]
    )
    return w.select(*keys, "month_end", "symbol", F.explode(cells).alias("c")).select(*keys, "month_end", "symbol", "c.strategy", "c.weight")


def portfolio_returns(w: DataFrame, months: DataFrame, keys: tuple[str, ...] = (), benchmark: str = "scores") -> DataFrame:
    """keys, month_end, strategy, ret for every month of `months`; a missing return adds nothing, an empty month is 0.

    The benchmark holds all names with a score, or with benchmark="returns" all rows of `months` with a return.
    """
    if benchmark not in ("scores", "returns"):
        raise ValueError(f"benchmark {benchmark!r} is neither scores nor returns")
    r = F.coalesce("fwd_1m_ret", F.lit(0.0))
    sums = w.groupBy(*keys, "month_end").agg(F.sum(F.col("w_long") * r).alias("long_only"), F.sum(F.col("w_short") * r).alias("short_only"), F.sum(F.col("w_ew") * r).alias("benchmark_ew"))
    if benchmark == "returns":
        all_months = months.groupBy(*keys, "month_end").agg(F.avg("fwd_1m_ret").alias("benchmark_ew")).join(sums.drop("benchmark_ew"), [*keys, "month_end"], "left").na.fill(0.0)
    else:
        all_months = months.select(*keys, "month_end").distinct().join(sums, [*keys, "month_end"], "left").na.fill(0.0)
    wide = all_months.withColumn("long_short", F.col("long_only") - F.col("short_only"))
    return wide.unpivot([*keys, "month_end"], list(STRATEGIES), "strategy", "ret")


def turnover(w: DataFrame, months: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, month_end, strategy, turnover: half the sum of weight changes, the first month against nothing.

    A dense grid isn't made: a symbol's change stands in the month it trades, and a symbol that leaves gives its whole
    weight to the month after its last.
    """
    order = Window.orderBy("month_end") if not keys else Window.partitionBy(*keys).orderBy("month_end")
    steps = months.select(*keys, "month_end").distinct().withColumn("__m", F.row_number().over(order))
    held = w.join(F.broadcast(steps), [*keys, "month_end"])
    names = Window.partitionBy(*keys, "symbol").orderBy("__m")
    cols = {"long_only": F.col("w_long"), "short_only": F.col("w_short"), "long_short": F.col("w_long") - F.col("w_short"), "benchmark_ew": F.col("w_ew")}
    held = held.withColumns(cols).withColumns({"__prev": F.lag("__m").over(names), "__next": F.lead("__m").over(names)})
    came = F.col("__prev") == F.col("__m") - 1
    change = [F.abs(F.col(c) - F.when(came, F.lag(c).over(names)).otherwise(0.0)).alias(c) for c in STRATEGIES]
    changes = held.select(*keys, "__m", *change)
    left = held.where(F.col("__next").isNull() | (F.col("__next") > F.col("__m") + 1)).select(*keys, (F.col("__m") + 1).alias("__m"), *[F.abs(c).alias(c) for c in STRATEGIES])
    sums = changes.unionByName(left).groupBy(*keys, "__m").agg(*[(F.sum(c) / 2).alias(c) for c in STRATEGIES])
    wide = steps.join(sums, [*keys, "__m"], "left").drop("__m").na.fill(0.0)
    return wide.unpivot([*keys, "month_end"], list(STRATEGIES), "strategy", "turnover")


def net_returns(returns: DataFrame, turn: DataFrame, bps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    joined = returns.join(turn, [*keys, "month_end", "strategy"], "left")
    return joined.select(*keys, "month_end", "strategy", (F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * bps / 10000.0).alias("ret"))


def with_nav(returns: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """nav (product of 1 + ret) and drawdown from the running maximum of nav."""
    w = Window.partitionBy(*keys).orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def rolling_metrics(returns: DataFrame, window: int = 12, freq: int = 12, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("month_end").rowsBetween(-(window - 1), 0)
    full = F.count("ret").over(w) >= window
    vol = F.when(full, F.stddev_pop("ret").over(w) * F.sqrt(F.lit(float(freq))))
    return returns.withColumns({"rolling_vol": vol, "rolling_sharpe": ratio(F.when(full, F.avg("ret").over(w) * F.sqrt(F.lit(float(freq)))), vol)})


def performance(returns: DataFrame, keys: tuple[str, ...] = ("strategy",), freq: int = 12, rf: float = 0.0) -> DataFrame:
    """ann_return, ann_vol, sharpe, max_drawdown, calmar, sortino by keys.

    The drawdown starts from the first month's nav; sortino's deviation is that of the negative returns among
    themselves.
    """
    rows = with_nav(returns.where(F.col("ret").isNotNull()), keys)
    root = F.sqrt(F.lit(float(freq)))
    m = rows.groupBy(*keys).agg(
        F.count("ret").alias("periods"), F.product(1 + F.col("ret")).alias("__t"), (F.stddev_pop("ret") * root).alias("ann_vol"),
        F.min("drawdown").alias("max_drawdown"), (F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))) * root).alias("__down"),
    )
    m = m.withColumn("ann_return", F.when(F.col("__t") >= 0, F.pow("__t", F.lit(float(freq)) / F.col("periods")) - 1))
    over = F.col("ann_return") - rf
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return m.select(
        *keys, "periods", "ann_return", "ann_vol", ratio(over, positive("ann_vol")).alias("sharpe"), "max_drawdown",
        ratio(over, F.when(F.col("max_drawdown") < 0, -F.col("max_drawdown"))).alias("calmar"), ratio(over, positive("__down")).alias("sortino"),
    )


def relative_metrics(returns: DataFrame, benchmark: str = "benchmark_ew", freq: int = 12) -> DataFrame:
    """beta (covariance of ddof 1 over population variance), alpha_ann and information_ratio against a strategy."""
    base = returns.where(F.col("strategy") == benchmark).select("month_end", F.col("ret").alias("b"))
    rows = returns.join(base, "month_end").where(F.col("ret").isNotNull() & F.col("b").isNotNull())
    m = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ret", "b").alias("c"), F.var_pop("b").alias("v"), F.avg("ret").alias("mr"), F.avg("b").alias("mb"), F.avg(F.col("ret") - F.col("b")).alias("md"), F.stddev_pop(F.col("ret") - F.col("b")).alias("sd"))
    m = m.withColumn("beta", F.when(F.col("n") > 1, ratio(F.col("c"), F.when(F.col("v") > 0, F.col("v")))))
    info = F.when(F.col("n") > 1, ratio(F.col("md") * F.sqrt(F.lit(float(freq))), F.when(F.col("sd") > 0, F.col("sd"))))
    return m.select("strategy", "beta", ((F.col("mr") - F.col("beta") * F.col("mb")) * freq).alias("alpha_ann"), info.alias("information_ratio"))


def split_summary(returns: DataFrame, split: Column) -> DataFrame:
    rows = returns.withColumn("split", split).where("split <> 'holdout'")
    return rows.groupBy("split", "strategy").agg(F.count("ret").alias("periods"), F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("std_ret"), (F.product(1 + F.col("ret")) - 1).alias("total_ret"))


def robustness(scores: DataFrame, quantiles: list[float]) -> DataFrame:
    """By top quantile: months, final nav, mean, deviation and largest drawdown of long-short; one plan for all."""
    spread = scores.withColumn("top_quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    keys = ("top_quantile",)
    rets = portfolio_returns(weights(spread, "top_quantile", keys), spread, keys).where("strategy = 'long_short'")
    rows = with_nav(rets, keys)
    return rows.groupBy("top_quantile").agg(F.count("ret").alias("months"), F.product(1 + F.col("ret")).alias("final_nav"), F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("std_ret"), F.min("drawdown").alias("max_drawdown"))


def extreme_months(returns: DataFrame, strategy: str = "long_short") -> DataFrame:
    """Best and worst month of a strategy; the earliest on ties."""
    own = returns.where(F.col("strategy") == strategy)
    day = -F.unix_date("month_end")
    return own.agg(F.max_by(F.struct("month_end", "ret"), F.struct("ret", day)).alias("best"), F.min_by(F.struct("month_end", "ret"), F.struct("ret", -day)).alias("worst")).select(
        F.col("best.month_end").alias("best_month"), F.col("best.ret").alias("best_ret"), F.col("worst.month_end").alias("worst_month"), F.col("worst.ret").alias("worst_ret")
    )
