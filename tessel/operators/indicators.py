"""Technical indicators of the daily panel: trailing windows within a symbol, one exchange for all of them.

Exponential averages are a recursion over a symbol's days: each step is an affine map of the value before. They are
computed as a scan over chunks of CHUNK_DAYS calendar days. Within a chunk, windows give each row the map from the chunk's
first value to its own; a symbol's chunks, one small row each, are composed in order; and each row applies its map to its
chunk's first value. All of it is built-in functions, and a task holds a chunk's rows, not a symbol's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.tables import written
from tessel.functions.windows import by, ratio, rolling, with_change

#: Calendar days of a chunk: so few that the product of a chunk's factors stays far from the least double for any span.
CHUNK_DAYS = 512


def days():
    return by("symbol", order="date")


def returns(df: DataFrame) -> DataFrame:
    """ret (gaps filled forward), log_ret (both closes positive) and abs_ret."""
    out = with_change(df, "close", "ret", days()).withColumn("__p", F.lag("close").over(days()))
    log_ret = F.when((F.col("close") > 0) & (F.col("__p") > 0), F.ln(F.col("close") / F.col("__p")))
    return out.withColumn("log_ret", log_ret).withColumn("abs_ret", F.abs("ret")).drop("__p")


def moving_averages(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    return df.withColumns({"ma_5": rolling(F.avg, F.col("close"), days(), short), "ma_20": rolling(F.avg, F.col("close"), days(), long)})


def volatility(df: DataFrame, n: int = 20, year: int = 252) -> DataFrame:
    """vol_20: population deviation of ret over n rows, per year."""
    return df.withColumn("vol_20", rolling(F.stddev_pop, F.col("ret"), days(), n) * F.sqrt(F.lit(float(year))))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """rsi_14 by simple averages of gains and losses; null without a loss."""
    out = df.withColumn("__d", F.col("close") - F.lag("close").over(days()))
    gain, loss = F.when(F.col("__d") > 0, F.col("__d")).when(F.col("__d").isNotNull(), 0.0), F.when(F.col("__d") < 0, -F.col("__d")).when(F.col("__d").isNotNull(), 0.0)
    strength = ratio(rolling(F.avg, gain, days(), n), rolling(F.avg, loss, days(), n))
    return out.withColumn("rsi_14", 100 - 100 / (1 + strength)).drop("__d")


def exponential_averages(df: DataFrame, value: str, spans: dict[str, int]) -> DataFrame:
    """df with an exponential average of `value` for each span, null before as many values as the span.

    The weight of the past falls by 1 - 2 / (span + 1) with every row, also over rows without a value, where the average
    stays as it was.
    """
    if min(spans.values()) < 2:
        raise ValueError("a span is 2 at least")
    names, keep = list(spans), [1 - 2 / (n + 1) for n in spans.values()]
    chunk = Window.partitionBy("symbol", "__chunk").orderBy("date")
    upto, before = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value).cast("double")
    rows = df.withColumn("__chunk", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / CHUNK_DAYS))
    rows = rows.withColumn("__at", F.row_number().over(chunk))
    rows = rows.withColumns({"__seen": F.count(v).over(upto), "__gap": F.col("__at") - F.last(F.when(v.isNotNull(), F.col("__at")), ignorenulls=True).over(before)})
    follows = v.isNotNull() & F.col("__gap").isNotNull()

    def of_past(q: float, gap: Column) -> Column:
        """Share of the value before in the next one, after a gap of so many rows."""
        kept = F.pow(F.lit(q), gap)
        return kept / (kept + (1 - q))

    rows = rows.withColumns({f"__p{i}": F.exp(F.sum(F.when(follows, F.ln(of_past(q, F.col("__gap")))).otherwise(0.0)).over(upto)) for i, q in enumerate(keep)})
    rows = rows.withColumns({f"__r{i}": F.col(f"__p{i}") * F.sum(F.when(follows, (1 - of_past(q, F.col("__gap"))) * v / F.col(f"__p{i}")).otherwise(0.0)).over(upto) for i, q in enumerate(keep)})

    rows = written(rows, "chunk-maps")  # read twice, by the summaries and by the rows that wait for them
    # a chunk's summary: rows, values, places of the first and the last value, the first value, and the map to its last
    has = v.isNotNull()
    chunks = rows.groupBy("symbol", "__chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("seen"), F.min(F.when(has, F.col("__at"))).alias("first_at"), F.max(F.when(has, F.col("__at"))).alias("last_at"), F.min_by(v, F.when(has, F.col("__at"))).alias("first"),
        F.array(*[F.max_by(F.col(f"__p{i}"), "__at") for i in range(len(keep))]).alias("p"), F.array(*[F.max_by(F.col(f"__r{i}"), "__at") for i in range(len(keep))]).alias("r"),
    )
    state = "struct<y: array<double>, since: bigint, seen: bigint, out: array<struct<chunk: bigint, start: array<double>, before: array<double>, seen: bigint>>>"

    def compose(s: Column, c: Column) -> Column:
        gap = s["since"] + c["first_at"]
        start = F.array(*[F.when(s["seen"] > 0, of_past(q, gap) * s["y"][i] + (1 - of_past(q, gap)) * c["first"]).otherwise(c["first"]) for i, q in enumerate(keep)])
        last = F.array(*[c["p"][i] * start[i] + c["r"][i] for i in range(len(keep))])
        some = c["seen"] > 0
        entry = F.struct(c["__chunk"].alias("chunk"), start.alias("start"), s["y"].alias("before"), s["seen"].alias("seen"))
        return F.struct(
            F.when(some, last).otherwise(s["y"]).alias("y"), F.when(some, c["n"] - c["last_at"]).otherwise(s["since"] + c["n"]).alias("since"), (s["seen"] + c["seen"]).alias("seen"), F.concat(s["out"], F.array(entry)).alias("out")
        ).cast(state)

    nothing = F.struct(F.array(*[F.lit(None).cast("double")] * len(keep)).alias("y"), F.lit(0).alias("since"), F.lit(0).alias("seen"), F.array().alias("out")).cast(state)
    listed = chunks.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("__chunk", "n", "seen", "first_at", "last_at", "first", "p", "r"))).alias("chunks"))
    starts = listed.select(F.col("symbol").alias("__s"), F.explode(F.aggregate("chunks", nothing, compose)["out"]).alias("__in"))
    starts = starts.select("__s", F.col("__in.chunk").alias("__c"), F.col("__in.start").alias("__start"), F.col("__in.before").alias("__before"), F.col("__in.seen").alias("__had"))
    met = rows.join(starts, (F.col("symbol") == F.col("__s")) & (F.col("__chunk") == F.col("__c")))
    for i, (name, n) in enumerate(spans.items()):
        now = F.when(F.col("__seen") > 0, F.col(f"__p{i}") * F.col("__start")[i] + F.col(f"__r{i}")).otherwise(F.col("__before")[i])
        met = met.withColumn(name, F.when(F.col("__had") + F.col("__seen") >= n, now))
    return met.select(*df.columns, *names)


def moving_convergence(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """ema12, ema26, macd and macd_signal."""
    out = exponential_averages(df, "close", {"ema12": fast, "ema26": slow}).withColumn("macd", F.col("ema12") - F.col("ema26"))
    return exponential_averages(out, "macd", {"macd_signal": signal})


def indicators(df: DataFrame) -> DataFrame:
    """All indicators but the global flags."""
    return rsi(volatility(moving_averages(returns(df))))
