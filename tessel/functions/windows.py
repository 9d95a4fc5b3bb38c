"""Window and aggregate expressions with the panel's null rules: nulls are skipped, zero denominators give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def positive_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def forward_fill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def with_change(df: DataFrame, value: str, out: str, w: WindowSpec, scale: float = 1.0, fill: bool = True) -> DataFrame:
    """Column `out`: relative change of `value` to the row before, gaps filled forward first unless fill is False."""
    df = df.withColumn("__ff", forward_fill(F.col(value), w) if fill else F.col(value))
    return df.withColumn(out, (ratio(F.col("__ff"), F.lag("__ff").over(w)) - 1) * scale).drop("__ff")


def rolling(fn, c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """fn over the last n rows, null with fewer than `least` values (default: n)."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (least or n), fn(c).over(frame))


def average_rank(value: str, *keys: str) -> Column:
    """1-based ascending rank within keys, ties sharing their mean; null for null."""
    v = F.col(value)
    order = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    return F.when(v.isNotNull(), F.rank().over(order) + (F.count(v).over(ties) - 1) / 2.0)


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of complete pairs; null for a constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quantile_bucket(rank: Column, n: Column, q: int) -> Column:
    """Bucket 1..q of a 1-based rank among n, with edges at linear quantiles of the ranks 1..n.

    The share goes through percent, as quantile cuts do, since its last bit decides for ranks on an edge.
    """
    out = F.lit(1)
    for k in range(1, q):
        edge = 1 + (n - 1) * F.lit(k * (1.0 / q) * 100.0 / 100.0)
        out = out + F.when(rank > edge, 1).otherwise(0)
    return out


def winsorize_over(value: str, p: float, *keys: str) -> Column:
    """value clipped to its [p, 1 - p] quantiles within keys; null for null."""
    w = Window.partitionBy(*keys)
    lo, hi = F.percentile(F.col(value), F.lit(p)).over(w), F.percentile(F.col(value), F.lit(1 - p)).over(w)
    return F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), lo), hi))


def zscore_over(value: str, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)
