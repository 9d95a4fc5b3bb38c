"""What a figure shows, as tables whose size doesn't grow with the rows: boxes and two-dimensional bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.crosssections import global_quantiles, is_large, pooled_quantiles
from tessel.functions.tables import written


def box_stats(df: DataFrame, value: str, *keys: str, reach: float = 1.5, spread: bool | None = None) -> DataFrame:
    """keys, n, mean, q1, median, q3, whisker_low, whisker_high, outliers: a box for each group of `value` (or for the whole column).

    Whiskers end at the outermost values within `reach` interquartile ranges of the box, or at the box where there are
    none; values beyond are counted as outliers. Nulls are left out; a group without values has no row.
    """
    rows = df.select(F.struct(*keys).alias("__k") if keys else F.struct(F.lit(0).alias("all")).alias("__k"), F.col(value).cast("double").alias("__x"))
    rows, quarters = written(rows, "boxes").where("__x is not null"), [0.25, 0.5, 0.75]
    if not keys:
        at = global_quantiles(rows, "__x", quarters, **({} if spread is None else {"small": 0 if spread else rows.count()}))
        boxed = rows.withColumn("__q", F.array(*[F.lit(q).cast("double") for q in at]))
    elif is_large(rows, "__k") if spread is None else spread:
        boxed = rows.join(pooled_quantiles(rows.select("__k.*", "__x"), ["__x"], quarters, *keys).withColumnRenamed("__x", "__q"), "__k")
    else:
        boxed = rows.join(rows.groupBy("__k").agg(F.percentile("__x", F.array(*map(F.lit, quarters))).alias("__q")), "__k")
    q1, median, q3 = (F.get("__q", F.lit(i)) for i in range(3))
    x, inner = F.col("__x"), reach * (q3 - q1)
    within = (x >= q1 - inner) & (x <= q3 + inner)
    out = boxed.groupBy("__k", q1.alias("q1"), median.alias("median"), q3.alias("q3")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(F.when(within, x)).alias("__lo"), F.max(F.when(within, x)).alias("__hi"), F.count_if(~within).alias("outliers")
    )
    low, high = F.least(F.coalesce("__lo", "q1"), F.col("q1")), F.greatest(F.coalesce("__hi", "q3"), F.col("q3"))
    return out.select(*[F.col("__k")[k].alias(k) for k in keys], "n", "mean", "q1", "median", "q3", low.alias("whisker_low"), high.alias("whisker_high"), "outliers")


def _bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    """0..bins-1 in equal widths from lo to hi; all in bin 0 where they are equal."""
    return F.least(F.floor((c - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int") if hi > lo else F.lit(0)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """x_bin, y_bin, x_low, y_low, count of all rows with both values; at most bins squared rows. Bins span the values in equal widths."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    x0, x1, y0, y1 = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        x0 = x1 = y0 = y1 = 0.0
    found = rows.groupBy(_bin(F.col("x"), x0, x1, bins).alias("x_bin"), _bin(F.col("y"), y0, y1, bins).alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))
    low = lambda c, lo, hi: F.lit(lo) + F.col(c) * F.lit((hi - lo) / bins)
    return found.select("x_bin", "y_bin", low("x_bin", x0, x1).alias("x_low"), low("y_bin", y0, y1).alias("y_low"), "count")
