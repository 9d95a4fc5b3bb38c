"""Daily bars from tables that hold none: trades, intraday events, and a made-up panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.windows import by


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One bar per supplier and ship day; unit prices in order of (order, line, part, price).

    Trades are dealt by symbol and sorted once: the days of a symbol hardly shrink before an exchange, and what follows
    takes them by symbol, in the order of days that the aggregate leaves.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lineitem.select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.to_date("l_shipdate").alias("date"), px.alias("px"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ord"), "l_quantity", "l_extendedprice",
    )
    return rows.repartition("symbol").groupBy("symbol", "date").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ord").alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def bars_from_events(events: DataFrame) -> DataFrame:
    """Daily bars of a user's event values: first, highest, lowest, last, and the number of events; rows without a value drop out."""
    rows = events.where(F.col("value").isNotNull()).withColumn("date", F.to_date("ts"))
    return rows.groupBy(F.col("user_id").alias("symbol"), "date").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.lit(None).cast("double").alias("amount"),
    )


def intraday_against_daily(intraday: DataFrame, daily: DataFrame) -> DataFrame:
    """Last intraday close of each symbol beside its last daily close: absolute and relative difference, largest first."""
    last = lambda d: d.groupBy("symbol").agg(F.max_by("close", "date").alias("c"))
    joined = last(intraday).withColumnRenamed("c", "intraday_close").join(last(daily).withColumnRenamed("c", "daily_close"), "symbol")
    diff = F.col("intraday_close") - F.col("daily_close")
    return joined.withColumns({"abs_diff": F.abs(diff), "rel_diff": F.try_divide(F.abs(diff), F.col("daily_close"))})


def sample_panel(spark: SparkSession, symbols: int = 8, start: str = "2019-01-01", end: str = "2023-12-31") -> DataFrame:
    """Deterministic bars on week days: growth times a sine, by symbol and step."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS date").where("weekday(date) < 5")
    steps = days.withColumn("t", F.row_number().over(by(order="date")) - 1)
    rows = F.broadcast(spark.range(symbols).withColumnRenamed("id", "i")).crossJoin(steps)
    return _made_up(rows.withColumn("symbol", F.lpad((F.col("i") + 1).cast("string"), 6, "0")))


def sample_like(bars: DataFrame, levels: int = 8) -> DataFrame:
    """Deterministic bars for each symbol and day of given bars, to try a study on a panel of their shape.

    A symbol's level is its number modulo levels (its length, if it is no number); its steps are its own days in order.
    A symbol or date that is null drops out; repeated rows give one.
    """
    days = bars.select("symbol", "date").where("symbol IS NOT NULL AND date IS NOT NULL").distinct()
    level = F.pmod(F.coalesce(F.expr("try_cast(symbol AS BIGINT)"), F.length("symbol").cast("long")), F.lit(levels))
    return _made_up(days.withColumns({"i": level, "t": F.row_number().over(by("symbol", order="date")) - 1}))


def _made_up(rows: DataFrame) -> DataFrame:
    """Bars of rows (symbol, date, level i, step t)."""
    close = (10 + F.col("i")) * F.pow(1 + (1 + 0.00015 * F.col("i")) * 0.0005, F.col("t")) * (1 + 0.02 * F.sin(F.col("t") / 19 + F.col("i")))
    rows = rows.select("symbol", "date", close.alias("close"), (100000 + 1000 * F.col("i") + 10 * F.col("t")).cast("double").alias("volume"))
    out = rows.withColumns({"open": F.col("close") * 0.999, "high": F.col("close") * 1.01, "low": F.col("close") * 0.99, "amount": F.col("close") * F.col("volume")})
    w = by("symbol", order="date")
    return out.withColumn("pct_chg", (F.col("close") / F.lag("close").over(w) - 1) * 100).select("symbol", "date", "open", "high", "low", "close", "volume", "amount", "pct_chg")
