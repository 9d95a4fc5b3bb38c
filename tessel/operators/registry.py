"""The benchmark registry: results of all stages in one table of fixed columns, and comparisons drawn from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The registry's columns and types.
COLUMNS = {
    "benchmark": "string",
    "category": "string",
    "validation_method": "string",
    "return_type": "string",
    "model": "string",
    "strategy": "string",
    "ann_return": "double",
    "sharpe": "double",
    "max_drawdown": "double",
    "turnover": "double",
    "transaction_cost_bps": "double",
    "auc": "double",
    "rank_ic": "double",
    "selection_role": "string",
    "source_file": "string",
}


def entries(df: DataFrame, benchmark, category: str, source: str, **columns) -> DataFrame:
    """df's rows as registry rows: named columns or literals, text defaults to '' and numbers to null."""
    given = {"benchmark": benchmark, "category": F.lit(category), "selection_role": F.lit("reporting_only"), "source_file": F.lit(source), **columns}
    empty = {"string": F.lit(""), "double": F.lit(None)}
    return df.select(*[(given[c] if c in given else empty[t]).cast(t).alias(c) for c, t in COLUMNS.items()])


def backtest_entries(performance: DataFrame, mean_turnover: DataFrame, return_type: str, bps: float, source: str = "backtest") -> DataFrame:
    rows = performance.join(mean_turnover, "strategy", "left")
    own = {c: F.col(c) for c in ("strategy", "ann_return", "sharpe", "max_drawdown")}
    return entries(rows, F.concat(F.lit("factor_"), F.col("strategy")), "factor_strategy", source, return_type=F.lit(return_type), turnover=F.col("mean_turnover"), transaction_cost_bps=F.lit(bps), **own)


def model_entries(metrics: DataFrame, source: str = "ml") -> DataFrame:
    own = {c: F.col(c) for c in ("model", "auc", "rank_ic")}
    return entries(metrics, F.concat(F.lit("ml_"), F.col("model")), "ml_model", source, validation_method=F.col("method"), return_type=F.lit("prediction"), **own)


def decision_entries(performance: DataFrame, mean_turnover: DataFrame, bps: float, source: str = "decision") -> DataFrame:
    """performance by (source, kind), mean_turnover by source."""
    rows = performance.join(mean_turnover, "source", "left")
    own = {c: F.col(c) for c in ("ann_return", "sharpe", "max_drawdown")}
    return entries(rows, F.concat(F.lit("decision_"), F.col("source")), "decision_optimizer", source, return_type=F.col("kind"), strategy=F.col("source"), turnover=F.col("mean_turnover"), transaction_cost_bps=F.when(F.col("kind") == "net", bps).otherwise(0.0), **own)


def tuned_entries(results: DataFrame, selected: DataFrame, source: str = "tuning") -> DataFrame:
    """The selected candidate's splits: the validation split selected it, the test split only reports."""
    rows = results.join(F.broadcast(selected.select("candidate_id")), "candidate_id", "left_semi")
    role = F.when(F.col("split") == "validation", "selected_on_validation").when(F.col("split") == "test", "test_reporting_only").otherwise("train_reporting_only")
    own = {c: F.col(c) for c in ("ann_return", "sharpe", "max_drawdown")}
    return entries(rows, F.concat(F.lit("tuned_"), F.col("split")), "tuned_candidate", source, return_type=F.lit("net"), strategy=F.col("split"), turnover=F.col("mean_turnover"), **own | {"selection_role": role})


def registry(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gross_net(reg: DataFrame) -> DataFrame:
    """benchmark, strategy, gross, net, cost_drag (gross less net) of annual returns."""
    rows = reg.where(F.col("return_type").isin("gross", "net")).groupBy("benchmark", "strategy").pivot("return_type", ["gross", "net"])
    return rows.agg(F.first("ann_return", ignorenulls=True)).withColumn("cost_drag", F.col("gross") - F.col("net"))
