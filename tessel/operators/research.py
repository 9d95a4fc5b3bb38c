"""Research statistics on the factor panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.crosssections import is_large, with_place
from tessel.functions.windows import by, quantile_bucket, ratio
from tessel.operators.factors import ic_summary, long_factors, rank_ic


def time_split(day: str, train_end: str, valid_end: str, test_start: str) -> Column:
    """train, validation, test or holdout; test wins where ranges overlap."""
    d = F.col(day)
    cut = lambda x: F.lit(x).cast("date")
    return F.when(d >= cut(test_start), "test").when(d <= cut(train_end), "train").when(d <= cut(valid_end), "validation").otherwise("holdout")


def ic_decay(panel: DataFrame, columns: list[str], horizons: list[int], least: int = 3) -> DataFrame:
    """month_end, horizon, factor, ic against the return over the next h rows of a symbol's panel."""
    w, out = by("symbol", order="month_end"), None
    for h in horizons:
        moved = panel.withColumn("__r", ratio(F.lead("close_me", h).over(w), F.col("close_me")) - 1)
        part = rank_ic(moved, columns, "__r", least).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def ic_decay_summary(decay: DataFrame) -> DataFrame:
    return ic_summary(decay, "horizon")


def ic_significance(ic: DataFrame) -> DataFrame:
    """n, mean, deviation and t of each factor's IC; t is null for one value or no spread."""
    out = ic.groupBy("factor").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"))
    return out.withColumn("t_stat", ratio(F.col("mean"), F.col("std") / F.sqrt("n")))


def bootstrap_mean(ic: DataFrame, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """factor, ci_low, ci_high: resampled means with numpy's generator, seeded alike for every factor.

    A factor's group is its months' ICs, a few hundred numbers.
    """

    def resample(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("month_end")["ic"].dropna().to_numpy()
        if not len(v):
            return pd.DataFrame({"factor": group["factor"].iloc[:1], "ci_low": [None], "ci_high": [None]})
        means = np.random.default_rng(seed).choice(v, size=(samples, len(v)), replace=True).mean(axis=1)
        lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({"factor": [group["factor"].iloc[0]], "ci_low": [lo], "ci_high": [hi]})

    return ic.select("factor", "month_end", "ic").groupBy("factor").applyInPandas(resample, "factor string, ci_low double, ci_high double")


def group_returns(panel: DataFrame, columns: list[str], q: int = 5, ret: str = "fwd_1m_ret") -> DataFrame:
    """month_end, factor, quantile, mean_return; months with fewer rows than quantiles drop out."""
    rows = long_factors(panel, columns, ("symbol", "month_end", ret)).where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    rows = with_place(rows, [F.col("value"), F.col("symbol")], "r", "n", "month_end", "factor", spread=is_large(panel, "month_end")).where(F.col("n") >= q)
    rows = rows.withColumn("quantile", quantile_bucket(F.col("r"), F.col("n"), q).cast("int"))
    return rows.groupBy("month_end", "factor", "quantile").agg(F.avg(ret).alias("mean_return"))


def group_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("factor", "quantile").agg(F.avg("mean_return").alias("mean_return"), F.count("mean_return").alias("months"))


def fama_macbeth(panel: DataFrame, columns: list[str], ret: str = "fwd_1m_ret") -> DataFrame:
    """term, mean_coef, std_coef, t_stat, count of monthly cross-sectional least squares with intercept.

    Months with no more complete rows than terms drop out. Each month sums its normal equations in Spark, (k+1)^2
    numbers, so that no task holds a month's rows; only the small systems are solved in Python.
    """
    terms = ["const", *columns]
    rows = panel.select("month_end", ret, *columns).na.drop().withColumn("const", F.lit(1.0))
    k = len(terms)
    products = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)]
    sums = rows.groupBy("month_end").agg(F.count(F.lit(1)).alias("n"), *products, *[F.sum(F.col(a) * F.col(ret)).alias(f"y{i}") for i, a in enumerate(terms)])

    def solve(frames):
        for f in frames:
            out = []
            for _, s in f.iterrows():
                x = np.array([[s[f"x{i}_{j}"] for j in range(k)] for i in range(k)])
                beta = np.linalg.pinv(x, hermitian=True) @ np.array([s[f"y{i}"] for i in range(k)])
                out += [(s["month_end"], t, float(b)) for t, b in zip(terms, beta)]
            yield pd.DataFrame(out, columns=["month_end", "term", "coef"])

    coefs = sums.where(F.col("n") > k).mapInPandas(solve, "month_end date, term string, coef double")
    out = coefs.groupBy("term").agg(F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("std_coef"), F.count("coef").alias("count"))
    return out.withColumn("t_stat", ratio(F.col("mean_coef"), F.col("std_coef") / F.sqrt("count")))


def fama_macbeth_single(panel: DataFrame, factor: str, ret: str = "fwd_1m_ret") -> DataFrame:
    """fama_macbeth for one factor in built-in aggregates alone."""
    months = panel.na.drop(subset=[factor, ret]).groupBy("month_end").agg(F.count(F.lit(1)).alias("n"), F.covar_pop(factor, ret).alias("c"), F.var_pop(factor).alias("v"), F.avg(ret).alias("my"), F.avg(factor).alias("mx"))
    months = months.where("n > 2").withColumn("slope", ratio(F.col("c"), F.col("v"))).withColumn("const", F.col("my") - F.col("slope") * F.col("mx"))
    coefs = months.unpivot(["month_end"], ["const", "slope"], "term", "coef")
    out = coefs.groupBy("term").agg(F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("std_coef"), F.count("coef").alias("count"))
    return out.withColumn("t_stat", ratio(F.col("mean_coef"), F.col("std_coef") / F.sqrt("count")))
