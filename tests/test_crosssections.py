"""Groups spread over buckets give what a window over the whole group gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel.functions import crosssections as cs


@pytest.fixture(scope="module")
def values(spark):
    """Three groups, one of them null: a large one with a value that a third of its rows share, a constant one, one of three rows."""
    rng = random.Random(3)
    rows = [("a", f"s{i:05d}", 7.0 if i % 3 == 0 else rng.gauss(0, 1) ** 3, rng.choice([None, 1.0, rng.random()])) for i in range(4000)]
    rows += [("b", f"s{i:05d}", 2.0, None) for i in range(300)] + [(None, f"s{i:05d}", float(i), float(-i)) for i in range(3)]
    return spark.createDataFrame(rows, "k string, symbol string, v double, u double").persist()


def same(a, b, keys=("k", "symbol")):
    left, right = (d.toPandas().sort_values(list(keys), na_position="first").reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(left[sorted(left)], right[sorted(right)], rtol=1e-12, check_dtype=False)


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(cs, "PER_BUCKET", 100)


@pytest.mark.parametrize("value", ["v", "u"])
def test_ranks(values, value):
    same(cs.with_rank(values, value, "r", "k", spread=True), cs.with_rank(values, value, "r", "k", spread=False))
    same(cs.with_percent_rank(values, value, "r", "k", spread=True), cs.with_percent_rank(values, value, "r", "k", spread=False))


def test_places_break_ties_by_the_next_column(values):
    order = [-F.col("v"), F.col("symbol")]
    same(cs.with_place(values, order, "r", "n", "k", spread=True), cs.with_place(values, order, "r", "n", "k", spread=False))


def test_zscores_and_quantiles(values):
    same(cs.with_zscores(values, ["v", "u"], 0.01, "k", spread=True), cs.with_zscores(values, ["v", "u"], 0.01, "k", spread=False))
    qs = [0.0, 0.013, 0.5, 0.75, 1.0]
    got = {r["__k"]["k"]: r for r in cs.pooled_quantiles(values, ["v", "u"], qs, "k").collect()}
    want = values.groupBy("k").agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in ("v", "u")]).collect()
    assert {k: (r["v"], r["u"]) for k, r in got.items()} == {r["k"]: (r["v"], r["u"]) for r in want}


def test_values_at_ranks_by_narrowing(spark):
    """Ties, infinities and values that no pivot meets; every range is narrowed until few values are left."""
    rng = np.random.default_rng(3)
    v = [*rng.standard_t(1, 3000), *[0.25] * 900, *[-np.inf] * 40, *[np.inf] * 30, *np.round(rng.normal(size=2000), 1)]
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3).persist()
    ranks = {0, 1, 39, 40, 41, 700, 2500, 2985, 4000, len(v) - 31, len(v) - 30, len(v) - 1}
    want = sorted(v)
    for accuracy in (20, 10_000):
        assert cs.values_at(rows, len(v), ranks, 5, accuracy) == {r: want[r] for r in ranks}


@pytest.mark.parametrize("name, passes", [("describe", 1), ("outlier_flags", 2), ("winsorize_global", 2)])
def test_whole_column_statistics_write_their_column(spark, name, passes):
    """The column is computed once for its statistics, and once more for rows that are returned with it."""
    from tessel.operators import cleaning

    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x * 0.5

    rows = spark.range(1000, numPartitions=2).select(F.udf(costly, "double")("id").alias("v"))
    more = ["out"] if name == "winsorize_global" else []
    assert getattr(cleaning, name)(rows, "v", *more).collect() and seen.value == 1000 * passes


def test_one_task_holds_one_bucket(values):
    rows = values.select(F.struct("k").alias("__g"), F.struct("v", "symbol").alias("__v"), F.lit(1).alias("__rows"))
    _, sizes = cs._placed(rows, 100, 1000)
    found = {r["__g"]["k"]: (r["n"], r["most"]) for r in sizes.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.max("__size").alias("most")).collect()}
    assert found["a"][0] >= 35 and found["a"][1] < 300 and found[None] == (1, 3)


def test_the_largest_group_decides(values):
    assert not cs.is_large(values, "k") and not cs.is_large(values, "k", rows=3999)  # planned to be small
    assert cs.is_large(values, "k", rows=3999, uncounted=0) and not cs.is_large(values, "k", rows=4000, uncounted=0)
    empty = values.where("false")
    assert not cs.is_large(empty, "k", uncounted=0)
    assert cs.with_rank(empty, "v", "r", "k", spread=True).count() == cs.with_zscores(empty, ["v"], 0.01, "k", spread=True).count() == 0


def test_operators_over_large_months(spark, bars, monkeypatch):
    """Scores, information coefficients, groups and baskets are the same when every month counts as large."""
    from tessel.operators import factors, portfolio, research, stress

    def results():
        panel = factors.factor_panel(bars)
        z = ["z_VALUE", "z_SIZE"]
        scores = portfolio.scored_panel(panel)
        thin = stress.liquidity_filtered(scores, panel.select("month_end", "symbol", "SIZE"))
        frames = (panel, factors.rank_ic(panel, z), research.group_returns(panel, z, 2), portfolio.weights(scores), thin)
        keys = (("month_end", "symbol"), ("month_end", "factor"), ("month_end", "factor", "quantile"), ("month_end", "symbol"), ("month_end", "symbol"))
        return [d.toPandas()[sorted(d.columns)].sort_values(list(k)).reset_index(drop=True) for d, k in zip(frames, keys)]

    plain = results()
    monkeypatch.setattr(cs, "LARGE", 1)
    monkeypatch.setattr(cs, "UNCOUNTED_BYTES", 0)
    monkeypatch.setattr(cs, "PER_BUCKET", 2)
    for a, b in zip(plain, results()):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12, check_dtype=False)
