"""Ranks, places, quantiles and z-scores within groups of any size.

A window holds a whole group in one task, which suits months of thousands of names. A larger group is cut into buckets
of successive values; each bucket is worked on in its own task, after the counts of the buckets before it, and equal
values share one counted row. Cut points come from values drawn by a hash, so a task that is run again finds the same
ones. Both ways give the same results: `spread` only chooses the plan, and by default the size of the largest group does.

Null values have no rank, no place and no part in quantiles; null keys are a group; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.windows import average_rank, by, winsorize_over, zscore_over

#: Rows of a group that a window's task may hold.
LARGE = 1_000_000
#: Planned size of a table up to which its groups are not even counted.
UNCOUNTED_BYTES = 64 << 20
#: Values drawn for each bucket, and the most buckets of a group; together they bound what is gathered for its cut points.
DRAWN = 20
BUCKETS = 1000
PER_BUCKET = 50_000


def is_large(df: DataFrame, *keys: str, rows: int | None = None, uncounted: int | None = None) -> bool:
    """Whether a group of df has more than `rows` rows (LARGE). A table planned at no more than `uncounted` bytes isn't counted."""
    rows, uncounted = LARGE if rows is None else rows, UNCOUNTED_BYTES if uncounted is None else uncounted
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= uncounted:
        return False
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > rows


def _group(keys: Sequence[str]) -> Column:
    """The keys as one value; null keys equal each other in it."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _placed(rows: DataFrame, per_bucket: int | None, buckets: int) -> tuple[DataFrame, DataFrame]:
    """rows (__g, __v, __rows, ...) with their bucket __b, and its sizes: __g, __b, __base (rows before it), __size, __total."""
    count = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__d"))
    wanted = F.least(F.lit(buckets), F.ceil(F.col("__d") / (per_bucket or PER_BUCKET))).cast("int")
    count = count.select("__g", wanted.alias("__k"), F.greatest(F.lit(1), F.floor(F.col("__d") / (wanted * DRAWN))).alias("__step")).where("__k > 1")
    drawn = rows.join(count, "__g").where(F.pmod(F.xxhash64("__v"), F.col("__step")) == 0)
    drawn = drawn.groupBy("__g").agg(F.sort_array(F.collect_list("__v")).alias("__s"), F.max("__k").alias("__k"))
    at = lambda i: F.get("__s", F.floor(i * F.size("__s") / F.col("__k")).cast("int"))
    cuts = drawn.select("__g", F.transform(F.sequence(F.lit(1), F.col("__k") - 1), at).alias("__cuts"))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, buckets).bit_length()))])
    forward = lambda b, h: F.when(F.get("__cuts", b + h - 1) < F.col("__v"), b + h).otherwise(b)
    bucket = F.when(F.col("__cuts").isNotNull(), F.aggregate(halves, F.lit(0), forward)).otherwise(0)  # cuts below the value, by halving
    out = rows.join(cuts, "__g", "left").withColumn("__b", bucket).drop("__cuts")
    sizes = out.groupBy("__g", "__b").agg(F.sum("__rows").alias("__size"))
    before = by("__g", order="__b").rowsBetween(Window.unboundedPreceding, -1)
    return out, sizes.withColumns({"__base": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__total": F.sum("__size").over(Window.partitionBy("__g"))})


def pooled_rank(df: DataFrame, value: str, out: str, *keys: str, per_bucket: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with `out`, the average rank of `value` within keys, by counted values in buckets."""
    rows = df.where(F.col(value).isNotNull()).groupBy(_group(keys).alias("__g"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__rows"))
    placed, sizes = _placed(rows, per_bucket, buckets)
    inside = F.sum("__rows").over(by("__g", "__b", order="__v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = placed.join(sizes.select("__g", "__b", "__base"), ["__g", "__b"]).select("__g", "__v", (F.col("__base") + inside - (F.col("__rows") - 1) / 2.0).alias(out))
    here = df.withColumns({"__g": _group(keys), "__v": F.col(value)})
    return here.join(ranks, ["__g", "__v"], "left").drop("__g", "__v")


def pooled_place(df: DataFrame, order: Sequence[Column], place: str, total: str, *keys: str, per_bucket: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with `place`, 1 for the first row of its group by `order` (ascending, no nulls), and `total`, the group's rows."""
    rows = df.withColumns({"__g": _group(keys), "__v": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), "__rows": F.lit(1)})
    placed, sizes = _placed(rows, per_bucket, buckets)
    placed = placed.join(sizes, ["__g", "__b"])
    own = F.col("__base") + F.row_number().over(by("__g", "__b", order="__v"))
    return placed.withColumns({place: own, total: F.col("__total")}).drop("__g", "__v", "__rows", "__b", "__base", "__size", "__total")


def pooled_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], *keys: str, per_bucket: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """__k (the keys as one value) and for each column its array of exact linear quantiles `qs` within keys.

    All columns and quantiles share one count of values; only the buckets that hold a wanted rank are sorted.
    """
    named = {c: f"c{i}" for i, c in enumerate(columns)}
    tall = df.select(_group(keys).alias("__k"), *[F.col(c).cast("double").alias(n) for c, n in named.items()]).unpivot(["__k"], list(named.values()), "__c", "__v")
    rows = tall.where("__v is not null").groupBy(F.struct("__k", "__c").alias("__g"), "__v").agg(F.count(F.lit(1)).alias("__rows"))
    placed, sizes = _placed(rows, per_bucket, buckets)
    at = [(F.col("__total") - 1) * F.lit(float(q)) for q in qs]
    ends = [(F.floor(a), F.ceil(a)) for a in at]
    first, past = F.col("__base"), F.col("__base") + F.col("__size")
    held = F.lit(False)
    for r in (r for pair in ends for r in pair):
        held = held | ((r >= first) & (r < past))
    after = F.col("__base") + F.sum("__rows").over(by("__g", "__b", order="__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.join(sizes.where(held), ["__g", "__b"]).withColumn("__after", after)
    value = lambda r: F.max(F.when((r < F.col("__after")) & (r >= F.col("__after") - F.col("__rows")), F.col("__v")))
    picked = rows.groupBy("__g").agg(F.max("__total").alias("__total"), *[value(r).alias(f"v{i}_{j}") for i, pair in enumerate(ends) for j, r in enumerate(pair)])
    between = [F.when(F.col(f"v{i}_0") == F.col(f"v{i}_1"), F.col(f"v{i}_0")).otherwise((hi - a) * F.col(f"v{i}_0") + (a - lo) * F.col(f"v{i}_1")) for i, (a, (lo, hi)) in enumerate(zip(at, ends))]
    wide = picked.select("__g.__k", "__g.__c", F.array(*between).alias("q")).groupBy("__k").pivot("__c", list(named.values())).agg(F.first("q"))
    return wide.withColumnsRenamed({n: c for c, n in named.items()})


def with_rank(df: DataFrame, value: str, out: str, *keys: str, spread: bool | None = None) -> DataFrame:
    """df with the average rank of `value` within keys."""
    spread = is_large(df, *keys) if spread is None else spread
    return pooled_rank(df, value, out, *keys) if spread else df.withColumn(out, average_rank(value, *keys))


def with_percent_rank(df: DataFrame, value: str, out: str, *keys: str, spread: bool | None = None) -> DataFrame:
    """df with the average rank of `value` over the number of values within keys."""
    spread = is_large(df, *keys) if spread is None else spread
    if not spread:
        return df.withColumn(out, average_rank(value, *keys) / F.count(value).over(Window.partitionBy(*keys)))
    counts = df.groupBy(_group(keys).alias("__k")).agg(F.count(value).alias("__rows"))
    ranked = pooled_rank(df, value, out, *keys).withColumn("__k", _group(keys)).join(counts, "__k")
    return ranked.withColumn(out, F.col(out) / F.col("__rows")).drop("__k", "__rows")


def with_place(df: DataFrame, order: Sequence[Column], place: str, total: str, *keys: str, spread: bool | None = None) -> DataFrame:
    """df with `place`, 1 for the first row of its group by `order`, and `total`, the group's rows."""
    spread = is_large(df, *keys) if spread is None else spread
    if spread:
        return pooled_place(df, order, place, total, *keys)
    group = Window.partitionBy(*keys)
    return df.withColumns({place: F.row_number().over(group.orderBy(*order)), total: F.count(F.lit(1)).over(group)})


def with_zscores(df: DataFrame, columns: Sequence[str], p: float, *keys: str, spread: bool | None = None) -> DataFrame:
    """z_ columns: clipped to the group's [p, 1 - p] quantiles, then to zero mean and unit population deviation."""
    spread = is_large(df, *keys) if spread is None else spread
    if not spread:
        out = df.withColumns({f"__w_{c}": winsorize_over(c, p, *keys) for c in columns})
        out = out.withColumns({f"z_{c}": zscore_over(f"__w_{c}", *keys) for c in columns})
        return out.drop(*[f"__w_{c}" for c in columns])
    bounds = pooled_quantiles(df, columns, [p, 1 - p], *keys).withColumnsRenamed({c: f"__q_{c}" for c in columns})
    clip = {f"__w_{c}": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.get(f"__q_{c}", F.lit(0))), F.get(f"__q_{c}", F.lit(1)))) for c in columns}
    clipped = df.withColumn("__k", _group(keys)).join(bounds, "__k", "left").withColumns(clip)
    moments = clipped.groupBy("__k").agg(*[f(f"__w_{c}").alias(f"__{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("sd", F.stddev_pop))])
    scale = lambda c: F.when(F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__sd_{c}"))
    out = clipped.join(moments, "__k").withColumns({f"z_{c}": (F.col(f"__w_{c}") - F.col(f"__avg_{c}")) / scale(c) for c in columns})
    return out.select(*df.columns, *[f"z_{c}" for c in columns])


def global_quantiles(df: DataFrame, value: str, qs: Sequence[float], small: int = 2_000_000, per_bucket: int | None = None) -> list[float | None]:
    """Exact linear quantiles of a whole column: one aggregate for up to `small` values, beyond it by narrowing ranges.

    df is read several times, so a column that takes long to compute should be written before.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = rows.count()
    if not n:
        return [None] * len(qs)
    if n <= small:
        return list(rows.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in qs]))).first()[0])
    at = [(n - 1) * float(q) for q in qs]
    found = values_at(rows, n, {r for a in at for r in (math.floor(a), math.ceil(a))}, per_bucket or PER_BUCKET)
    ends = [(found[math.floor(a)], found[math.ceil(a)]) for a in at]
    return [lo if lo == hi else (math.ceil(a) - a) * lo + (a - math.floor(a)) * hi for a, (lo, hi) in zip(at, ends)]


@dataclass
class _Range:
    """Where the value of a rank lies: between two values, or anywhere; `base` values are below the range, `size` in it."""

    rank: int
    base: int
    size: int
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        v = F.col("v")
        return (F.lit(True) if self.low is None else v > F.lit(self.low)) & (F.lit(True) if self.high is None else v < F.lit(self.high))


def values_at(rows: DataFrame, n: int, ranks: set[int], held: int = 50_000, accuracy: int = 10_000) -> dict[int, float]:
    """The values at 0-based ranks of rows' n values `v`, none of them null.

    Approximate quantiles give two values about each rank, and an exact count says on which side of them, or on which of
    them, it lies; so its range shrinks a thousand times with two passes, until `held` values at most are left to sort.
    """
    found: dict[int, float] = {}
    todo = [_Range(r, 0, n) for r in sorted(ranks)]
    while wide := [t for t in todo if t.size > held]:
        share = lambda t, by: min(1.0, max(0.0, (t.rank - t.base + 0.5) / t.size + by / accuracy))
        pivots = rows.agg(*[F.percentile_approx(F.when(t.holds(), F.col("v")), [share(t, -2), share(t, 2)], accuracy) for t in wide]).first()
        v = F.col("v")
        counts = rows.agg(*[F.count_if(t.holds() & c) for t, (a, b) in zip(wide, pivots) for c in (v < F.lit(a), v <= F.lit(a), v < F.lit(b), v <= F.lit(b))]).first()
        for i, (t, (a, b)) in enumerate(zip(wide, pivots)):
            place = t.rank - t.base
            under_a, to_a, under_b, to_b = counts[4 * i : 4 * i + 4]
            if under_a <= place < to_a or under_b <= place < to_b:
                found[t.rank] = a if place < to_a else b
                todo.remove(t)
            elif place < under_a:
                t.high, t.size = a, under_a
            elif place < under_b:
                t.low, t.high, t.base, t.size = a, b, t.base + to_a, under_b - to_a
            else:
                t.low, t.base, t.size = b, t.base + to_b, t.size - to_b
    if todo:
        sort = lambda t: F.get(F.sort_array(F.collect_list(F.when(t.holds(), F.col("v")))), F.lit(t.rank - t.base))
        found |= {t.rank: x for t, x in zip(todo, rows.agg(*map(sort, todo)).first())}
    return found
