"""File sources of the panel: daily CSVs, candidate paths, optional and missing inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) names something in its own file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def read_csv(spark: SparkSession, path: str, dates: tuple[str, ...] = ("date", "month_end"), strings: tuple[str, ...] = ("symbol", "code", "代码"), schema: StructType | str | None = None, skip_bad: bool = False) -> DataFrame:
    """A CSV with a header, with or without a byte-order mark.

    Without a schema every column is read as text (one pass, leading zeros stay); names in `dates` become dates, names
    in `strings` stay text, all else becomes a double where it can be read as one. skip_bad leaves out unreadable files.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreCorruptFiles", str(skip_bad).lower())
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    kept = set(strings)
    typed = {c: F.expr(f"to_date(try_to_timestamp(`{c}`))") if c in dates else F.expr(f"nullif(try_cast(`{c}` AS double), double('NaN'))") for c in raw.columns if c not in kept}
    return raw.withColumns(typed)


def read_optional(spark: SparkSession, candidates: list[str], **options) -> DataFrame | None:
    """The first candidate that exists, or None."""
    path = next((p for p in candidates if exists(spark, p)), None)
    return None if path is None else read_csv(spark, path, **options)


def read_or_empty(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """The file, or an empty table with the schema where it is missing."""
    return read_csv(spark, path, schema=schema, **options) if exists(spark, path) else spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks the columns {missing}")
    return df


def intraday_bars(spark: SparkSession, pattern: str) -> DataFrame:
    """Minute files minute_<n>m.csv under a glob: symbol, ts and prices; unreadable files and rows without a price drop out."""
    try:
        raw = read_csv(spark, pattern, dates=(), strings=("symbol", "code", "ts", "day", "time"), skip_bad=True)
    except AnalysisException as e:
        raise FileNotFoundError(pattern) from e
    stamp = next(c for c in ("ts", "day", "time") if c in raw.columns)
    out = raw.withColumnsRenamed({stamp: "ts", "code": "symbol"}) if "symbol" not in raw.columns else raw.withColumnRenamed(stamp, "ts")
    return out.withColumn("ts", F.expr("try_to_timestamp(ts)")).na.drop(subset=["ts", "open", "high", "low", "close"])


def daily_from_minutes(minutes: DataFrame) -> DataFrame:
    rows = minutes.withColumn("date", F.to_date("ts"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.lit(None).cast("double").alias("amount"),
    )
