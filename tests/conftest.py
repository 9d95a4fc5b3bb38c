import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def daily() -> pd.DataFrame:
    """Six symbols over three years of week days: growth times a sine."""
    rows = []
    for i in range(6):
        for t, day in enumerate(pd.bdate_range("2020-01-01", "2022-12-31")):
            close = (10 + i) * (1 + (1 + 0.00015 * i) * 0.0005) ** t * (1 + 0.02 * math.sin(t / 19 + i))
            rows.append((f"{i + 1:06d}", day.date(), close * 0.999, close * 1.01, close * 0.99, close, 100000.0 + 1000 * i + 10 * t, close * (100000 + 1000 * i + 10 * t)))
    return pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume", "amount"])


@pytest.fixture(scope="session")
def bars(spark, daily):
    return spark.createDataFrame(daily).persist()


@pytest.fixture(scope="session")
def month():
    return lambda y, m: (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1))
