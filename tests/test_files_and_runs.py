"""Sources, sinks, settings, manifests, acquisition, streaming and the command line."""

import datetime as dt
import math
import json
import zipfile
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__
from tessel import artifacts, cli, config
from tessel.sources import acquire, files, sinks
from tessel.sources import bars as made
from tessel.streaming.bars import stream_bars


def test_csv_with_mark_and_leading_zeros(spark, tmp_path):
    p = tmp_path / "daily.csv"
    p.write_text("symbol,date,close,note\n000001,2020-01-02,1.5,x\n000002,bad,nan,2\n", encoding="utf-8-sig")
    rows = files.read_csv(spark, str(p)).collect()
    assert [(r["symbol"], r["date"], r["close"]) for r in rows] == [("000001", dt.date(2020, 1, 2), 1.5), ("000002", None, None)]


def test_candidates(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a\n1\n")
    assert files.first_existing(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).endswith("b.csv")
    with pytest.raises(FileNotFoundError, match="a.csv.*c.csv"):
        files.first_existing(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/c.csv"])
    assert files.read_optional(spark, [f"{tmp_path}/a.csv"]) is None
    assert files.read_or_empty(spark, f"{tmp_path}/a.csv", "x int").count() == 0
    with pytest.raises(KeyError):
        files.require_columns(spark.range(1), ["id", "other"])


def test_minutes(spark, tmp_path):
    (tmp_path / "minute_5m.csv").write_text("symbol,ts,open,high,low,close,volume\n000001,2020-01-02 09:30:00,1,3,1,2,10\n000001,2020-01-02 09:35:00,2,4,0.5,3,5\n000001,2020-01-02 09:40:00,,4,0.5,3,5\n")
    r = files.daily_from_minutes(files.intraday_bars(spark, f"{tmp_path}/minute_*m.csv")).collect()
    assert [(x["open"], x["high"], x["low"], x["close"], x["volume"]) for x in r] == [(1.0, 4.0, 0.5, 3.0, 15.0)]


def test_atomic_write_keeps_the_target(tmp_path):
    p = sinks.write_text(tmp_path / "a.txt", "old")

    def fail(_):
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        sinks.atomic_write(p, fail)
    assert p.read_text() == "old" and [x.name for x in tmp_path.iterdir()] == ["a.txt"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 0.123456789, 2)], "s string, v double, n int")
    assert sinks.markdown(df, 2).splitlines()[2:] == ["| a | 1.00 |  |", "| b | 0.12 | 2 |"]
    assert sinks.write_csv(tmp_path / "x.csv", df, 3).read_text(encoding="utf-8-sig").splitlines() == ["s,v,n", "a,1.000,", "b,0.123,2"]
    with pytest.raises(ValueError):
        sinks.small(spark.range(20), 10)
    sinks.write_table(df, "t_report")
    assert spark.table("t_report").count() == 2
    h = {r["bin"]: r["count"] for r in sinks.histogram(spark.range(100).selectExpr("cast(id as double) v"), "v", 10).collect()}
    assert sum(h.values()) == 100 and len(h) == 10


def test_settings(tmp_path):
    assert config.from_mapping({}).backtest.top_quantile == 0.2
    c = config.from_mapping({"backtest": {"top_quantile": 0.3}, "ml": {"models": ["ridge"]}, "validation": {"unknown": 1}})
    assert c.backtest.top_quantile == 0.3 and c.ml.models == ("ridge",) and c.backtest.freq == 12
    for bad in ({"backtest": {"top_quantile": 1.5}}, {"backtest": {"top_quantile": True}}, {"ml": {"models": ["other"]}}, {"validation": {"method": "x"}}, {"research": {"train_end": "2025-01-01"}}, {"cleaning": {"winsor_lower_q": 0.9, "winsor_upper_q": 0.1}}, {"decision": []}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)
    p = tmp_path / "c.yaml"
    p.write_text("stress:\n  high_cost_bps: 50\n")
    assert config.load(p, output_dir="x").stress.high_cost_bps == 50 and config.load(p, output_dir="x").data.output_dir == "x"


def test_missing_config_ends_with_2(spark):
    with pytest.raises(SystemExit) as e:
        cli.main(["clean", "--config", "/nowhere.yaml"], spark)
    assert e.value.code == 2


def test_manifest(tmp_path):
    m = artifacts.Manifest(tmp_path / "m.json", "cmd", {"a": 1})
    m.started("clean", ["/x", "/x"])
    m.finished("clean", [str(tmp_path)])
    m.started("ml")
    m.finished("ml", error="broke")
    m.skipped("fetch", "not asked for")
    m.close("failed")
    v = json.loads((tmp_path / "m.json").read_text())
    assert v["status"] == "failed" and v["stages"]["clean"]["status"] == "succeeded" and len(v["stages"]["clean"]["inputs"]) == 1
    assert v["stages"]["ml"]["error"] == "broke" and v["stages"]["fetch"]["status"] == "skipped"


def test_stages_end_to_end(spark, daily, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    daily.to_csv(src / "daily_price_50.csv", index=False, encoding="utf-8-sig")
    c = tmp_path / "c.yaml"
    c.write_text(
        "research: {train_end: '2021-06-30', valid_end: '2022-03-31', test_start: '2022-04-01', bootstrap_samples: 50}\n"
        "validation: {min_train_months: 6, test_window_months: 6}\nml: {models: [ridge, logistic]}\ntuning: {risk_aversion: [1.0], turnover_penalty: [0.0], factor_weight_sets: [{z_VALUE: 1.0}]}\n"
        "factors: {quantile_groups: 2, ic_decay_horizons: [1]}\ndecision: {max_weight: 0.5}\n"
    )
    out = tmp_path / "out" / "latest"
    assert cli.main(["run-all", "--config", str(c), "--input-dir", str(src), "--output-dir", str(out)], spark) == 0
    m = json.loads((out / "manifest.json").read_text())
    assert m["status"] == "succeeded" and list(m["stages"]) == list(cli.STAGES)
    assert m["stages"]["fetch"]["status"] == "skipped"
    assert [(Path(i["path"]).name, i["files"]) for i in m["stages"]["clean"]["inputs"]] == [("daily_price*.csv", 1)]
    assert {Path(i["path"]).name for i in m["stages"]["stress"]["inputs"]} == {"factor_panel", "daily_price"}
    assert m["stages"]["benchmarks"]["metrics"]["registry"]["rows"] > 0 and "category" in m["stages"]["benchmarks"]["metrics"]["registry"]["columns"]
    with zipfile.ZipFile(out / "reports.zip") as z:
        assert {"registry.csv", "registry.md", "manifest.json"} <= set(z.namelist())
    assert (out / "registry.csv").exists() and "| benchmark |" in (out / "registry.md").read_text()
    reg = pd.read_csv(out / "registry.csv", encoding="utf-8-sig")
    assert {"factor_strategy", "ml_model", "decision_optimizer", "tuned_candidate"} == set(reg["category"])
    assert cli.main(["stress", "--config", str(c), "--input-dir", str(src), "--output-dir", str(out)], spark) == 0
    assert (out / "registry.csv").exists() and (out / "stress_metrics.csv").exists()


def make_stub():
    """A fetcher that tasks can load without this module."""

    def stub(symbol, start, end):
        if symbol == "000009":
            raise ValueError("unknown symbol")
        return pd.DataFrame({"date": ["2020-01-02"], "open": [1.0], "high": [1.0], "low": [1.0], "close": [2.0], "volume": [3.0], "amount": [6.0]})

    return stub


def test_acquisition_resumes(spark, tmp_path):
    stub = make_stub()
    universe = spark.createDataFrame([("000001",), ("000002",), ("000009",)], "symbol string")
    cache, point = f"{tmp_path}/cache", f"{tmp_path}/checkpoint"
    first = {r["symbol"]: r for r in acquire.fetch_symbols(spark, universe, stub, "2020-01-01", "2020-12-31", cache, point, 2, 0).collect()}
    assert first["000001"]["status"] == "succeeded" and first["000009"]["status"] == "failed" and "unknown symbol" in first["000009"]["error"]
    assert [r["symbol"] for r in acquire.to_fetch(universe, acquire.load_checkpoint(spark, point)).collect()] == ["000009"]
    fixed = lambda s, a, b: stub("000001", a, b)
    second = {r["symbol"]: r["status"] for r in acquire.fetch_symbols(spark, universe, fixed, "2020-01-01", "2020-12-31", cache, point, 2, 0).collect()}
    assert set(second.values()) == {"succeeded"}
    assert acquire.read_cache(spark, cache).count() == 3 and acquire.read_cache(spark, cache, ["000009"]).first()["symbol"] == "000009"
    assert {r["status"]: r["share"] for r in acquire.summary(acquire.load_checkpoint(spark, point), universe).collect()} == {"succeeded": 1.0}


def test_acquisition_by_rounds_and_cache(spark, tmp_path):
    universe = acquire.universe_of(spark.createDataFrame([("1", "a"), (" 2", "b"), ("000002", "c"), ("300000", "d"), (None, "e")], "code string, name string"))
    assert [(r["symbol"], r["name"]) for r in universe.orderBy("symbol").collect()] == [("000001", "a"), ("000002", "b"), ("300000", "d")]
    assert [r["symbol"] for r in acquire.universe_of(universe, 2).collect()] == ["000001", "000002"]
    cache, point = f"{tmp_path}/cache", f"{tmp_path}/checkpoint"
    stub = make_stub()
    fixed = lambda s, a, b: stub("000001", a, b)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    done = acquire.fetch_symbols(spark, universe, fixed, "2020-01-01", "2020-12-31", cache, point, 2, None, every=1)
    assert {r["status"] for r in done.collect()} == {"succeeded"} and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert spark.read.parquet(point).where("status = 'running'").count() == 3
    for part in (tmp_path / "cache" / "part=000002").glob("*.parquet"):
        part.write_bytes(b"not parquet")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    left = acquire.to_fetch(universe, acquire.load_checkpoint(spark, point), acquire.cached_symbols(spark, cache))
    assert [r["symbol"] for r in left.collect()] == ["000002"]
    assert acquire.last_day("20200101") == "20200101" and len(acquire.last_day(None)) == 8


def test_sample_and_stored_tables(spark):
    from tessel.operators.cleaning import seeded_sample

    df = spark.range(500).selectExpr("cast(id as string) symbol", "current_date() date")
    a, b = (sorted(r["symbol"] for r in seeded_sample(d, rows=20).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(set(a)) == 20 and a != sorted(r["symbol"] for r in seeded_sample(df, rows=20, seed=1).collect())
    sinks.write_table(spark.range(9), "stored_numbers")
    try:
        count, first = sinks.stored_tables(spark)["stored_numbers"]
        assert count == 9 and len(first) == 5
    finally:
        spark.sql("DROP TABLE stored_numbers")


def test_settings_that_nothing_reads():
    with pytest.warns(UserWarning, match="backtest.nonsense"):
        c = config.from_mapping({"backtest": {"nonsense": 1, "factor_weights": {"z_SIZE": 2.0}}})
    assert c.backtest.factor_weights["z_SIZE"] == 2.0 and c.backtest.factor_weights["z_VALUE"] == 1.0
    with pytest.raises(config.ConfigError):
        config.from_mapping({"data": 3})


def test_pooled_ranks_and_narrow_bands(spark):
    import random

    from tessel.functions.crosssections import global_quantiles, pooled_rank

    rng = random.Random(1)
    values = [rng.choice([0.0, 1.0, rng.random() * 100]) for _ in range(3000)] + [None, None]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, v double")
    for k in (0, 1):
        want = pd.Series([v for i, v in enumerate(values) if i % 2 == k]).rank()
        got = sorted((r["v"], r["rank"]) for r in pooled_rank(df, "v", "rank", "k", per_bucket=40).where(f"k = {k} and v is not null").collect())
        assert got == sorted((v, r) for v, r in zip([v for i, v in enumerate(values) if i % 2 == k], want) if v is not None)
    qs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    assert global_quantiles(df, "v", qs, small=50, per_bucket=40) == pytest.approx(list(pd.Series(values).quantile(qs)))


def test_retries_and_fallback():
    calls, pauses = [], []

    def down(s, a, b):
        calls.append("net")
        raise ConnectionError("down")

    def wrong(s, a, b):
        calls.append("bad")
        raise ValueError("bad")

    def other(s, a, b):
        return pd.DataFrame({"date": ["2019-01-01", "2020-05-05"]})

    assert len(acquire.with_retries(down, (wrong, other), 3, 1.0, pauses.append)("x", "2020-01-01", "2020-12-31")) == 1
    assert calls == ["net"] * 3 + ["bad"] and pauses == [1.0, 2.0]
    with pytest.raises(ValueError):
        acquire.with_retries(wrong, (), 3, 1.0, pauses.append)("x", "a", "b")
    assert acquire.prefixed("600000") == "sh600000" and acquire.prefixed("1") == "sz000001"


def test_sample_panel(spark):
    p = made.sample_panel(spark, 2, "2020-01-01", "2020-01-31").toPandas()
    assert len(p) == 46 and p["symbol"].nunique() == 2 and p["pct_chg"].isna().sum() == 2
    assert p[p["symbol"] == "000001"].sort_values("date")["close"].iloc[0] == pytest.approx(10.0)


def test_sample_of_given_days(spark):
    days = [("000002", "2020-01-03"), ("000002", "2020-01-01"), ("000002", "2020-01-03"), ("abc", "2020-01-02"), (None, "2020-01-02"), ("000001", None)]
    given = spark.createDataFrame(days, "symbol string, date string").selectExpr("symbol", "CAST(date AS DATE) AS date", "1.0 AS close")
    got = {(r["symbol"], str(r["date"])): r for r in made.sample_like(given).collect()}
    assert sorted(got) == [("000002", "2020-01-01"), ("000002", "2020-01-03"), ("abc", "2020-01-02")]
    assert got["000002", "2020-01-01"]["close"] == pytest.approx(12 * (1 + 0.02 * math.sin(2))) and got["000002", "2020-01-01"]["pct_chg"] is None
    assert got["000002", "2020-01-03"]["volume"] == 102010.0 and got["abc", "2020-01-02"]["volume"] == 103000.0
    assert made.sample_like(given.where("false")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, d, h), float(d * 10 + h)) for d in (1, 2, 3, 9) for h in (9, 12)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(f"{tmp_path}/e")
    q = stream_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r["date"]: (r["open"], r["high"], r["close"]) for r in spark.table("bars_out").collect()}
    assert got == {dt.date(2020, 1, d): (d * 10.0 + 9, d * 10.0 + 12, d * 10.0 + 12) for d in (1, 2, 3)}


def test_entry_point():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len([n for n in q if n.startswith("q_")]) > 60


def test_pointers(spark, tmp_path):
    """Tables are published where they lie, over any Hadoop file system; unfinished pointers are passed over."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.default.link./out", f"file://{tmp_path}/other")
    (tmp_path / "other").mkdir()
    for root in (f"{tmp_path}/latest", "viewfs:///out/latest"):
        assert artifacts.current_tables(spark, root) == {}
        spark.range(3).write.parquet(f"{root}-run/a")
        assert artifacts.point_to(spark, root, {"a": f"{root}-run/a", "b": "1"}) == 1 and artifacts.point_to(spark, root, {"b": "2"}) == 2
        fs, unfinished = artifacts.file_system(spark, f"{root}/pointers/00000003.json")
        fs.create(unfinished, False).close()
        assert artifacts.current_tables(spark, root) == {"a": f"{root}-run/a", "b": "2"}
        assert artifacts.point_to(spark, root, {"c": "4"}, patience=0) == 4
        assert spark.read.parquet(artifacts.current_tables(spark, root)["a"]).count() == 3 and artifacts.current_tables(spark, root)["c"] == "4"
        for i in range(artifacts.KEPT_POINTERS):
            last = artifacts.point_to(spark, root, {"c": str(i)})
        assert len(artifacts._pointers(spark, root)) == artifacts.KEPT_POINTERS and artifacts._pointers(spark, root)[-1] == last
        assert artifacts.names_in(spark, root) == ["pointers"]


def test_two_publishers(spark, tmp_path, monkeypatch):
    """The one whose number is taken starts again from the other's tables."""
    root, seen, first = f"{tmp_path}/latest", artifacts._pointers, [True]
    artifacts.point_to(spark, root, {"a": "1"})
    monkeypatch.setattr(artifacts, "_pointers", lambda *a: [] if first and first.pop() else seen(*a))
    assert artifacts.point_to(spark, root, {"b": "2"}) == 2
    assert artifacts.current_tables(spark, root) == {"a": "1", "b": "2"}


def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    """Bars written before a crash aren't fetched again, those not written are; unfinished batches don't count."""
    universe = spark.createDataFrame([(f"{i:06d}",) for i in range(6)], "symbol string")
    cache, point, calls = f"{tmp_path}/cache", f"{tmp_path}/checkpoint", f"{tmp_path}/calls"
    Path(calls).mkdir()

    def make(calls):  # tasks load it without this module
        def fetch(symbol, start, end):
            import uuid

            open(f"{calls}/{symbol}-{uuid.uuid4().hex}", "w").close()
            return pd.DataFrame({"date": ["2020-01-02"], "open": [1.0], "high": [1.0], "low": [1.0], "close": [2.0], "volume": [3.0], "amount": [6.0]})

        return fetch

    append = acquire.append_status

    def broken(spark, path, rows):
        if rows.where("status <> 'running'").take(1):
            raise RuntimeError("crash between bars and outcome")
        return append(spark, path, rows)

    monkeypatch.setattr(acquire, "append_status", broken)
    with pytest.raises(RuntimeError, match="crash"):
        acquire.fetch_symbols(spark, universe, make(calls), "2020-01-01", "2020-12-31", cache, point, 2, None, every=3)
    monkeypatch.setattr(acquire, "append_status", append)
    first = len(list(Path(calls).iterdir()))
    assert 0 < first < 6 and acquire.load_checkpoint(spark, point).where("status = 'pending'").count() == first
    (tmp_path / "checkpoint" / "kind=log" / "seq=7").mkdir()  # begun, never committed
    done = acquire.fetch_symbols(spark, universe, make(calls), "2020-01-01", "2020-12-31", cache, point, 2, None, every=3)
    assert {r["symbol"]: r["status"] for r in done.collect()} == {f"{i:06d}": "succeeded" for i in range(6)}
    assert sorted(p.name[:6] for p in Path(calls).iterdir()) == [f"{i:06d}" for i in range(6)]


def test_checkpoint_stays_small(spark, tmp_path):
    """Batches are compacted without a change of any status; older checkpoints are read; the base outlives a crash before its clearing."""
    point = f"{tmp_path}/checkpoint"
    row = lambda s, status, at: spark.createDataFrame([(s, status, "", "1", "", at)], acquire.CHECKPOINT)
    row("000001", "failed", "2020").write.parquet(point)
    row("000002", "succeeded", "2020").write.mode("append").parquet(point)
    for i, status in enumerate(["running", "succeeded", "failed"]):  # the batch's number decides, not the clock
        acquire.append_status(spark, point, row("000001", status, f"{2030 - i}"))
    acquire.append_status(spark, point, row("000003", "running", "2020"))
    want = {"000001": "failed", "000002": "succeeded", "000003": "pending"}
    state = lambda: {r["symbol"]: r["status"] for r in acquire.load_checkpoint(spark, point).collect()}
    assert state() == want and not acquire.compact(spark, point)
    assert acquire.compact(spark, point, after=4) and state() == want
    assert acquire._numbers(spark, point, "log") == [] and acquire._numbers(spark, point, "base") == [4]
    row("000001", "succeeded", "2040").write.parquet(f"{point}/kind=log/seq=2")  # what a crash would have left
    assert state() == want and not acquire.compact(spark, point, after=1)
    assert acquire.append_status(spark, point, row("000003", "succeeded", "2019")) == 5 and state() == want | {"000003": "succeeded"}
    assert acquire.compact(spark, point, after=1) and acquire._numbers(spark, point, "base") == [5] and acquire._numbers(spark, point, "log") == []
