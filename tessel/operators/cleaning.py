"""Cleaning and profiling of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.crosssections import global_quantiles
from tessel.functions.tables import written
from tessel.functions.windows import by, with_change

#: Names that daily data comes with, and the names used here.
ALIASES = {
    "日期": "date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount",
    "涨跌幅": "pct_chg", "涨跌额": "change", "换手率": "turnover_rate", "振幅": "amplitude", "代码": "symbol", "名称": "name",
    "Date": "date", "Open": "open", "Close": "close", "High": "high", "Low": "low", "Volume": "volume", "Amount": "amount",
    "Pct_chg": "pct_chg", "Change": "change", "Code": "symbol", "code": "symbol", "day": "date", "时间": "date",
    "最新价": "price", "今开": "open", "昨收": "pre_close",
}
NUMBERS = ("open", "high", "low", "close", "volume", "amount", "pct_chg")
COLUMNS = ("symbol", "date", *NUMBERS)


def rename_aliases(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns})


def add_missing(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string" if c == "symbol" else "date" if c == "date" else "double") for c in columns if c not in df.columns})


def coerce(df: DataFrame) -> DataFrame:
    """Types of the daily panel; what can't be read becomes null, NaN too, and symbols lose surrounding white space."""
    kinds = dict(df.dtypes)
    day = F.col("date") if kinds["date"] == "date" else F.to_date("date") if kinds["date"].startswith("timestamp") else F.expr("to_date(try_to_timestamp(date))")
    out = df.withColumns({"symbol": F.regexp_replace(F.col("symbol").cast("string"), r"^\s+|\s+$", ""), "date": day})
    return out.withColumns({c: F.expr(f"nullif(try_cast(`{c}` AS double), double('NaN'))") for c in NUMBERS})


def keep_last(df: DataFrame, order: str) -> DataFrame:
    """One row of each (symbol, date): the last by `order`."""
    w = Window.partitionBy("symbol", "date").orderBy(F.col(order).desc())
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def swap_high_low(df: DataFrame) -> DataFrame:
    """Where both are known and high < low, they change places."""
    bad = F.col("high") < F.col("low")
    return df.withColumns({"high": F.when(bad, F.col("low")).otherwise(F.col("high")), "low": F.when(bad, F.col("high")).otherwise(F.col("low"))})


def fill_pct_chg(df: DataFrame, share: float = 0.9) -> DataFrame:
    """pct_chg from closes where more than `share` of the whole column is null; else as it is."""
    missing = df.agg(F.avg(F.col("pct_chg").isNull().cast("int"))).first()[0]
    if missing is None or missing <= share:
        return df
    return with_change(df, "close", "pct_chg", by("symbol", order="date"), 100.0)


def clean_daily(df: DataFrame, order: str | None = None) -> DataFrame:
    """Canonical daily panel: renamed, coerced, keyed once by (symbol, date), repaired.

    order names an ingest ordinal; without it the rows of a key are told apart by their values.
    """
    named = rename_aliases(df)
    out = coerce(add_missing(named)).na.drop(subset=["symbol", "date"]).repartition("symbol")  # keys and changes need no other exchange
    out = keep_last(out, order) if order else keep_last(out.withColumn("__o", F.struct(*NUMBERS)), "__o").drop("__o")
    out = swap_high_low(out).select(*COLUMNS)
    return fill_pct_chg(out) if "pct_chg" in named.columns else with_change(out, "close", "pct_chg", by("symbol", order="date"), 100.0)


def quality_profile(df: DataFrame) -> DataFrame:
    """One row: rows, symbols, dates, repeated rows and keys, negative prices, high below low, and null shares.

    Repeats are counted by grouping, never by collecting the distinct rows of one task.
    """
    cols = [c for c in COLUMNS if c in df.columns]
    once = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    keys = once.groupBy("symbol", "date").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("kinds"),
        F.sum(F.when((F.col("open") < 0) | (F.col("high") < 0) | (F.col("low") < 0) | (F.col("close") < 0), F.col("n")).otherwise(0)).alias("negative"),
        F.sum(F.when(F.col("high") < F.col("low"), F.col("n")).otherwise(0)).alias("crossed"),
        *[F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0)).alias(f"null_{c}") for c in cols],
    )
    per_symbol = keys.groupBy("symbol").agg(
        F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.count(F.lit(1)).alias("keys"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.sum("negative").alias("negative"), F.sum("crossed").alias("crossed"), *[F.sum(f"null_{c}").alias(f"null_{c}") for c in cols],
    )
    return per_symbol.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("symbol").isNotNull(), 1).otherwise(0)).cast("long").alias("symbols"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        (F.sum("n") - F.sum("kinds")).alias("repeated_rows"),
        (F.sum("n") - F.sum("keys")).alias("repeated_keys"),
        F.sum("negative").alias("negative_rows"),
        F.sum("crossed").alias("crossed_rows"),
        *[(F.sum(f"null_{c}") / F.sum("n")).alias(f"null_{c}") for c in cols],
    )


def winsorize_global(df: DataFrame, value: str, out: str, lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    lo, hi = global_quantiles(written(df.select(value), "values"), value, [lower, upper])
    v = F.col(value)
    return df.withColumn(out, v if lo is None else F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi))))


def winsorize_by_symbol(df: DataFrame, value: str, out: str, lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    w = Window.partitionBy("symbol")
    lo, hi = F.percentile(value, F.lit(lower)).over(w), F.percentile(value, F.lit(upper)).over(w)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), lo), hi)))


def outlier_flags(df: DataFrame, value: str, z: float = 3.0, k: float = 1.5) -> DataFrame:
    """flag_z and flag_iqr against the whole column; false for null, and all false for a constant column."""
    values = written(df.select(value), "values")
    mean, sd = values.agg(F.avg(value), F.stddev_pop(value)).first()
    q1, q3 = global_quantiles(values, value, [0.25, 0.75])
    v = F.col(value)
    flag_z = F.abs((v - F.lit(mean)) / F.lit(sd)) > z if sd else F.lit(False)
    flag_i = (v < q1 - k * (q3 - q1)) | (v > q3 + k * (q3 - q1)) if q1 is not None and q3 != q1 else F.lit(False)
    return df.withColumns({"flag_z": F.coalesce(flag_z, F.lit(False)), "flag_iqr": F.coalesce(flag_i, F.lit(False))})


def outlier_flags_by_symbol(df: DataFrame, value: str, z: float = 3.0, k: float = 1.5) -> DataFrame:
    w, v = Window.partitionBy("symbol"), F.col(value)
    score = F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w))
    q1, q3 = F.percentile(v, F.lit(0.25)).over(w), F.percentile(v, F.lit(0.75)).over(w)
    flag_i = (q3 != q1) & ((v < q1 - k * (q3 - q1)) | (v > q3 + k * (q3 - q1)))
    return df.withColumns({"flag_z": F.coalesce(F.abs(score) > z, F.lit(False)), "flag_iqr": F.coalesce(flag_i, F.lit(False))})


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max, and bias-corrected skewness and kurtosis of a column."""
    v, n = F.col(value), F.count(value)
    df = written(df.select(value), "values")
    q = global_quantiles(df, value, [0.25, 0.5, 0.75])
    return df.agg(
        n.alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        *[F.lit(x).cast("double").alias(name) for x, name in zip(q, ("p25", "p50", "p75"))], F.max(v).alias("max"),
        F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)).alias("kurt"),
    )


def seeded_sample(df: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), rows: int = 5000, seed: int = 42) -> DataFrame:
    """`rows` rows drawn by a hash of their keys and the seed: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(rows)
