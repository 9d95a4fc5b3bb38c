"""Acquisition of daily bars from a remote service: cached, rate-limited, resumable, one symbol a row.

Symbols to fetch are found by an anti join with the checkpoint; the fetches run in tasks (mapInPandas over symbols),
each task spacing its own requests so that all tasks together keep to the rate. A symbol's failure is a row of the
result, never a failed job. Results are Parquet partitions by symbol, written before the checkpoint.

The checkpoint is a log of numbered batches of statuses (kind=log/seq=N), each committed whole by Spark. Every
COMPACT_AFTER batches the last status of each symbol is written as a base (kind=base/seq=N), which stands for all
batches up to its number. Bars carry the number of the batch that announced them, so that a run which broke off
between bars and outcome is known to have fetched them.
"""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.tables import names_in, remove, written
from tessel.sources.files import exists

Fetch = Callable[[str, str, str], pd.DataFrame]
BARS = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"
CHECKPOINT = "symbol string, status string, error string, rows string, cache_path string, updated_at string"
COMPACT_AFTER = 20


def prefixed(code: str) -> str:
    """A six-digit code with its exchange's prefix."""
    code = code.zfill(6)
    return ("sh" if code.startswith(("6", "9", "5")) else "sz") + code


def with_retries(fetch: Fetch, fallbacks: tuple[Fetch, ...] = (), retries: int = 3, base_delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """fetch, tried again after network errors with doubling pauses, then each fallback; other errors move on at once.

    Fallbacks may not know the range, so their rows are filtered.
    """

    def run(symbol: str, start: str, end: str) -> pd.DataFrame:
        last: Exception | None = None
        for attempt in range(max(1, retries)):
            try:
                return fetch(symbol, start, end)
            except (ConnectionError, TimeoutError, OSError) as e:
                last = e
                if attempt + 1 < retries:
                    sleep(base_delay * 2**attempt)
            except Exception as e:  # not the network: another try would fail alike
                last = e
                break
        for other in fallbacks:
            try:
                rows = other(symbol, start, end)
            except Exception as e:
                last = e
                continue
            day = pd.to_datetime(rows["date"])
            return rows[(day >= pd.Timestamp(start)) & (day <= pd.Timestamp(end))]
        raise last or RuntimeError(symbol)

    return run


def _numbers(spark: SparkSession, path: str, kind: str, finished: bool = True) -> list[int]:
    """Numbers of the checkpoint's batches or bases; unfinished ones have no _SUCCESS file."""
    found = [n for n in names_in(spark, f"{path}/kind={kind}") if n.startswith("seq=")]
    return sorted(int(n[4:]) for n in found if not finished or "_SUCCESS" in names_in(spark, f"{path}/kind={kind}/{n}"))


def _last_status(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each symbol and its batch's number `seq`."""
    base = _numbers(spark, path, "base")[-1:]
    parts = [f"{path}/kind=base/seq={n}" for n in base] + [f"{path}/kind=log/seq={n}" for n in _numbers(spark, path, "log") if not base or n > base[0]]
    rows = spark.read.option("basePath", path).schema(CHECKPOINT + ", kind string, seq long").parquet(*parts).drop("kind") if parts else spark.createDataFrame([], CHECKPOINT + ", seq long")
    if any(n.endswith(".parquet") for n in names_in(spark, path)):  # a checkpoint without numbers comes before all batches
        rows = rows.unionByName(spark.read.schema(CHECKPOINT).parquet(f"{path}/*.parquet").withColumn("seq", F.lit(0).cast("long")))
    values = F.struct("status", "error", "rows", "cache_path", "updated_at", "seq")
    return rows.groupBy("symbol").agg(F.max_by(values, F.struct("seq", "updated_at")).alias("s")).select("symbol", "s.*")


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each symbol; what was running when a run broke off is pending again."""
    return _last_status(spark, path).drop("seq").withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def append_status(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Commit one batch of statuses under the next number; returns it."""
    number = max([0, *_numbers(spark, path, "log", False), *_numbers(spark, path, "base", False)]) + 1
    rows.coalesce(8).write.mode("overwrite").parquet(f"{path}/kind=log/seq={number}")
    return number


def compact(spark: SparkSession, path: str, after: int | None = None) -> bool:
    """Replace the batches by one base, if there are `after` of them (COMPACT_AFTER). A crash leaves batches that the base makes void."""
    base = max(_numbers(spark, path, "base"), default=0)
    logs, bases = _numbers(spark, path, "log"), _numbers(spark, path, "base", False)
    if sum(n > base for n in logs) < (COMPACT_AFTER if after is None else max(1, after)):
        return False
    load_checkpoint(spark, path).write.mode("overwrite").parquet(f"{path}/kind=base/seq={logs[-1]}")
    for kind, numbers in (("log", logs), ("base", [n for n in bases if n < logs[-1]])):
        for n in numbers:
            remove(spark, f"{path}/kind={kind}/seq={n}")
    return True


def recover(spark: SparkSession, cache: str, checkpoint: str) -> None:
    """Give symbols whose bars were written by a run that broke off before their outcome that outcome."""
    running = _last_status(spark, checkpoint).where("status = 'running'").select("symbol", "seq")
    if not exists(spark, f"{cache}/part=*") or not running.take(1):
        return
    rows = spark.read.option("ignoreCorruptFiles", True).schema(BARS + ", batch long").parquet(cache)
    done = written(rows.join(running, "symbol").where("batch = seq").groupBy("symbol").agg(F.count("date").cast("string").alias("n")), "recovered")
    if done.take(1):
        append_status(spark, checkpoint, _status(done, F.lit("succeeded"), F.lit(""), F.col("n"), F.concat(F.lit(f"{cache}/part="), "symbol")))


def universe_of(raw: DataFrame, first: int | None = None) -> DataFrame:
    """symbol (six digits), name and the time of reading, from a listing with code and name; the first ones by symbol if a number is given."""
    names = {c.lower(): c for c in raw.columns}
    code = next((names[c] for c in ("symbol", "code", "代码") if c in names), None)
    if code is None:
        raise KeyError("a universe needs a column symbol or code")
    name = F.col(names["name"]).cast("string") if "name" in names else F.lit(None).cast("string")
    digits = F.trim(F.col(code).cast("string"))
    rows = raw.select(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits).alias("symbol"), name.alias("name")).where("symbol is not null and symbol <> ''")
    rows = rows.groupBy("symbol").agg(F.min("name").alias("name")).withColumn("read_at", F.current_timestamp())
    return rows if first is None else rows.orderBy("symbol").limit(first)


def last_day(end: str | None) -> str:
    """The given end date, or today in UTC+8."""
    return end or (dt.datetime.now(dt.UTC) + dt.timedelta(hours=8)).strftime("%Y%m%d")


def load_fetch(name: str) -> Fetch:
    """The function that 'package.module:function' names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def cached_symbols(spark: SparkSession, cache: str) -> DataFrame:
    """Symbols with bars in the cache; files that can't be read count as missing."""
    if not exists(spark, f"{cache}/part=*"):
        return spark.createDataFrame([], "symbol string")
    return spark.read.option("ignoreCorruptFiles", True).schema(BARS).parquet(cache).where("symbol is not null").select("symbol").distinct()


def to_fetch(universe: DataFrame, checkpoint: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Symbols without a success in the checkpoint; with a cache, also those whose bars it lacks."""
    done = checkpoint.where("status = 'succeeded'").select("symbol")
    done = done if cached is None else done.join(cached, "symbol", "left_semi")
    return universe.select("symbol").distinct().join(done, "symbol", "left_anti")


def _status(rows: DataFrame, status, error, count, path) -> DataFrame:
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.select("symbol", status.alias("status"), error.alias("error"), count.alias("rows"), path.alias("cache_path"), stamp.alias("updated_at"))


def fetch_symbols(spark: SparkSession, universe: DataFrame, fetch: Fetch, start: str, end: str, cache: str, checkpoint: str, tasks: int = 4, per_second: float | None = 2.0, resume: bool = True, use_cache: bool = True, every: int = 200) -> DataFrame:
    """Fetch into `cache` what the checkpoint or the cache lacks; returns the checkpoint's rows after the run.

    Symbols go in rounds of about `every`, each marked as running before it and with its outcome after it. Without
    resume everything is fetched anew; without use_cache a success in the checkpoint is enough.
    """
    recover(spark, cache, checkpoint)
    known = load_checkpoint(spark, checkpoint)
    work = to_fetch(universe, known, cached_symbols(spark, cache) if use_cache else None) if resume else universe.select("symbol").distinct()
    columns = ["symbol", "date", "open", "high", "low", "close", "volume", "amount", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pause, due = tasks / per_second if per_second else 0.0, 0.0
        for frame in frames:
            for symbol in frame["symbol"]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + pause
                try:
                    rows = fetch(symbol, start, end)
                    if not len(rows):
                        raise ValueError("no rows")
                    out = rows.assign(symbol=symbol, date=pd.to_datetime(rows["date"]).dt.date, error=None).reindex(columns=columns)
                except Exception as e:  # one row of empty objects: no column is a float that Arrow can't take for a date
                    out = pd.DataFrame([dict.fromkeys(columns) | {"symbol": symbol, "error": f"{type(e).__name__}: {e}"}], columns=columns, dtype=object)
                yield out

    work = written(work, "work")
    rounds = max(1, -(-work.count() // max(1, every)))
    for i in range(rounds):
        part = work.where(F.pmod(F.xxhash64("symbol"), F.lit(rounds)) == i)
        blank = F.lit("")
        batch = append_status(spark, checkpoint, _status(part, F.lit("running"), blank, blank, blank))
        got = written(part.repartition(tasks).mapInPandas(run, BARS + ", error string"), "fetched")
        bars = got.where("error is null").drop("error").withColumns({"part": F.col("symbol"), "batch": F.lit(batch).cast("long")})
        bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(cache)
        ended = got.groupBy("symbol").agg(F.max("error").alias("error"), F.count("date").cast("string").alias("n"))
        status = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
        append_status(spark, checkpoint, _status(ended, status, F.coalesce("error", blank), F.col("n"), F.concat(F.lit(f"{cache}/part="), "symbol")))
        compact(spark, checkpoint)
    return load_checkpoint(spark, checkpoint)


def read_cache(spark: SparkSession, cache: str, symbols: list[str] | None = None) -> DataFrame:
    """Cached bars; a list of symbols prunes partitions."""
    rows = spark.read.schema(BARS + ", part string").parquet(cache)
    return (rows if symbols is None else rows.where(F.col("part").isin(symbols))).drop("part")


def summary(checkpoint: DataFrame, universe: DataFrame) -> DataFrame:
    """status, symbols, share of the universe."""
    total = universe.select("symbol").distinct().agg(F.count(F.lit(1)).alias("total"))
    counted = checkpoint.groupBy("status").agg(F.count(F.lit(1)).alias("symbols"))
    return counted.crossJoin(F.broadcast(total)).select("status", "symbols", (F.col("symbols") / F.col("total")).alias("share"))
