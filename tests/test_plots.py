"""Boxes and bins against numpy."""

import numpy as np
import pytest
from pyspark.sql.functions import udf

from tessel.functions import crosssections
from tessel.operators import plots


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = [("a", float(v), float(w)) for v, w in zip(rng.standard_t(2, 2000), rng.normal(size=2000))]
    return spark.createDataFrame([*out, ("b", 4.0, 1.0), ("b", 4.0, None), ("c", None, 2.0)], "k string, v double, w double").persist()


@pytest.mark.parametrize("spread", [False, True])
def test_boxes(rows, monkeypatch, spread):
    monkeypatch.setattr(crosssections, "PER_BUCKET", 90)
    got = {r["k"]: r for r in plots.box_stats(rows, "v", "k", spread=spread).collect()}
    assert set(got) == {"a", "b"}
    assert [got["b"][c] for c in ("n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")] == [2, 4.0, 4.0, 4.0, 4.0, 4.0, 0]
    v = np.array([r["v"] for r in rows.where("k = 'a'").collect()])
    q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    want = [len(v), v.mean(), q1, med, q3, inside.min(), inside.max(), len(v) - len(inside)]
    assert [got["a"][c] for c in ("n", "mean", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")] == pytest.approx(want)
    assert plots.box_stats(rows, "v", spread=spread).first()["n"] == 2002
    assert plots.box_stats(rows.where("false"), "v", spread=spread).count() == 0


def test_bins(rows):
    got = {(r["x_bin"], r["y_bin"]): r["count"] for r in plots.scatter_bins(rows, "v", "w", 12).collect()}
    full = rows.where("v is not null and w is not null").toPandas()
    want, *_ = np.histogram2d(full["v"], full["w"], bins=12)
    assert got == {(i, j): int(n) for (i, j), n in np.ndenumerate(want) if n}
    assert plots.scatter_bins(rows.where("false"), "v", "w").count() == 0
    assert [(r["x_bin"], r["count"]) for r in plots.scatter_bins(rows.where("k = 'b'"), "v", "w").collect()] == [(0, 1)]


@pytest.mark.parametrize("spread", [None, True])
def test_a_box_computes_its_column_once(spark, spread):
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x * 0.5

    rows = spark.range(1000, numPartitions=2).select(udf(costly, "double")("id").alias("v"))
    box = plots.box_stats(rows, "v", spread=spread).first()
    assert (box["n"], box["q1"], box["median"], box["q3"], seen.value) == (1000, 124.875, 249.75, 374.625, 1000)
