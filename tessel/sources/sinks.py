"""Sinks: tables by Spark's own commits, and small reports as single files replaced whole."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a report may hold.
REPORT_ROWS = 10_000


def atomic_write(path: str | Path, write: Callable[[Path], None]) -> Path:
    """Write beside the target, then rename; a failure leaves the target as it was."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    os.close(handle)
    try:
        write(Path(name))
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def write_text(path: str | Path, text: str) -> Path:
    return atomic_write(path, lambda p: p.write_text(text, encoding="utf-8"))


def write_json(path: str | Path, value) -> Path:
    return write_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def small(df: DataFrame, rows: int = REPORT_ROWS) -> list:
    """A report's rows; a larger table belongs in write_table."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows for a report")
    return found


def write_csv(path: str | Path, df: DataFrame, decimals: int | None = None) -> Path:
    """A small table as one CSV with a byte-order mark."""
    import csv

    def write(p: Path) -> None:
        with p.open("w", newline="", encoding="utf-8-sig") as out:
            rows = csv.writer(out)
            rows.writerow(df.columns)
            for r in small(df):
                rows.writerow([f"{v:.{decimals}f}" if decimals is not None and isinstance(v, float) else "" if v is None else v for v in r])

    return atomic_write(path, write)


def markdown(df: DataFrame, decimals: int = 6) -> str:
    """A small table as a Markdown table."""
    shown = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in small(df)])


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a catalogue table."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stored_tables(spark: SparkSession, rows: int = 5) -> dict[str, tuple[int, list]]:
    """Row count and first rows of every catalogue table, by SQL."""
    names = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    return {n: (spark.sql(f"SELECT count(*) FROM `{n}`").first()[0], spark.sql(f"SELECT * FROM `{n}` LIMIT {rows}").collect()) for n in names}


def strategies_wide(returns: DataFrame, value: str, strategies: tuple[str, ...]) -> DataFrame:
    """month_end and one column per (known) strategy."""
    return returns.groupBy("month_end").pivot("strategy", list(strategies)).agg(F.first(value))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin, low, high, count: a plot's data."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    width = ((hi - lo) / bins if hi is not None and hi > lo else 1.0) or 1.0
    rows = df.where(F.col(value).isNotNull()).select(F.least(F.floor((F.col(value) - (lo or 0.0)) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy("bin").count().select("bin", (F.lit(lo or 0.0) + F.col("bin") * width).alias("low"), (F.lit(lo or 0.0) + (F.col("bin") + 1) * width).alias("high"), "count")
