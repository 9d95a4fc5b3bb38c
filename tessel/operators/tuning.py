"""Grid search over portfolio settings, all candidates in one plan, chosen on the validation split alone."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.crosssections import is_large
from tessel.functions.tables import written
from tessel.operators import portfolio
from tessel.operators.research import time_split

#: Candidates share a score by risk aversion and factor weights, and a portfolio by its quantile too; the turnover penalty is a cost.
KEY = ("score_id", "top_quantile")


def grid(spark, risk: list[float], penalty: list[float], quantile: list[float], factor_weights: list[dict[str, float]]) -> DataFrame:
    """candidate_id, risk_aversion, turnover_penalty, top_quantile, factor_weights (map and JSON)."""
    rows = [(i, float(r), float(p), float(q), {k: float(v) for k, v in w.items()}, json.dumps(w, sort_keys=True)) for i, (r, p, q, w) in enumerate(itertools.product(risk, penalty, quantile, factor_weights))]
    return spark.createDataFrame(rows, "candidate_id int, risk_aversion double, turnover_penalty double, top_quantile double, factor_weights map<string,double>, factor_weights_json string")


def evaluate(panel: DataFrame, candidates: DataFrame, splits: dict[str, str], lookback: int = 12, base_bps: float = 15.0) -> DataFrame:
    """One row per candidate and split: settings, periods, performance and mean turnover.

    Scores are placed once for all candidates that share them. Signs come from the training months alone; the score is lowered by risk aversion times the symbol's return
    deviation over the `lookback` panel months before (three values at least, else nothing).
    """
    train = panel.where(F.col("month_end") <= F.lit(splits["train_end"]).cast("date"))
    flipped = portfolio.flip_by(panel, portfolio.factor_signs(train))
    steps = panel.select("month_end").distinct().withColumn("__m", F.row_number().over(Window.orderBy("month_end")))
    before = Window.partitionBy("symbol").orderBy("__m").rangeBetween(-lookback, -1)
    sd = F.when(F.count("fwd_1m_ret").over(before) >= 3, F.stddev_pop("fwd_1m_ret").over(before))
    rows = flipped.join(F.broadcast(steps), "month_end").withColumn("__sd", F.coalesce(sd, F.lit(0.0)))
    total = None
    for c in portfolio.SCORED:  # weights of a candidate over the sum of their sizes; names outside the scored columns drop out
        term = F.col(c) * F.coalesce(F.col("factor_weights")[c], F.lit(0.0))
        total = term if total is None else total + term
    size = sum((F.abs(F.coalesce(F.col("factor_weights")[c], F.lit(0.0))) for c in portfolio.SCORED), F.lit(0.0))
    candidates = candidates.withColumn("score_id", F.min("candidate_id").over(Window.partitionBy("risk_aversion", "factor_weights_json")))
    own = candidates.where("candidate_id = score_id").select("score_id", "risk_aversion", "factor_weights")
    scores = rows.crossJoin(F.broadcast(own)).select("score_id", "month_end", "symbol", "fwd_1m_ret", F.round(total / size - F.col("risk_aversion") * F.col("__sd"), portfolio.DECIMALS).alias("score"))
    ranked = written(portfolio.placed(scores, ("score_id",), is_large(panel, "month_end")).drop("score"), "places")
    baskets = candidates.select(*KEY).distinct()
    w = portfolio.baskets(ranked.join(F.broadcast(baskets), "score_id"), "top_quantile")
    months = baskets.crossJoin(F.broadcast(steps.select("month_end")))
    gross = portfolio.portfolio_returns(w, months, KEY).where("strategy = 'long_short'")
    turn = portfolio.turnover(w, months, KEY).where("strategy = 'long_short'").drop("strategy")
    bps = candidates.select("candidate_id", *KEY, (base_bps + F.col("turnover_penalty") * 100).alias("bps"))
    net = gross.join(turn, [*KEY, "month_end"]).join(F.broadcast(bps), list(KEY))
    net = net.select("candidate_id", "month_end", "turnover", (F.col("ret") - F.col("turnover") * F.col("bps") / 10000.0).alias("ret"), time_split("month_end", **splits).alias("split")).where("split <> 'holdout'")
    found = portfolio.performance(net, ("candidate_id", "split")).drop("calmar", "sortino")
    means = net.groupBy("candidate_id", "split").agg(F.avg("turnover").alias("mean_turnover"))
    every = candidates.drop("score_id").crossJoin(F.broadcast(candidates.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")))
    out = every.join(found, ["candidate_id", "split"], "left").join(means, ["candidate_id", "split"], "left")
    return out.withColumn("periods", F.coalesce("periods", F.lit(0).cast("long")))


def select(results: DataFrame) -> DataFrame:
    """The best candidate's validation row: by sharpe, then annual return, nulls last, then the smallest id."""
    order = [F.col("sharpe").desc_nulls_last(), F.col("ann_return").desc_nulls_last(), F.col("candidate_id")]
    return results.where("split = 'validation'").orderBy(*order).limit(1)
