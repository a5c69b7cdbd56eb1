"""One local session for all tests, and seeded frames with the properties under test."""

import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A Spark frame from columns; None and NaN become null."""

    def make(schema=None, **columns):
        pdf = pd.DataFrame(columns)
        if schema is None:
            return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).infer_objects())
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
        from granary.session import local_frame

        return local_frame(spark, rows, schema)

    return make


@pytest.fixture(scope="session")
def sales(frame):
    rng = np.random.default_rng(7)
    n = 300
    days = pd.date_range("2024-01-01", periods=n, freq="D").strftime("%Y-%m-%d")
    return frame(
        "order_date string, region string, channel string, revenue double, units long",
        order_date=days,
        region=rng.choice(["north", "south", "west"], n),
        channel=rng.choice(["web", "store"], n),
        revenue=np.round(rng.normal(100, 20, n) + np.arange(n) * 0.1, 2),
        units=rng.integers(1, 9, n),
    )


@pytest.fixture(scope="session")
def gappy(frame):
    return frame("n double, c string", n=[1.0, 2.0, None, 100.0], c=["a", "a", None, "b"])


@pytest.fixture(scope="session")
def houses(frame):
    rng = np.random.default_rng(1)
    n = 60
    size = rng.integers(50, 200, n)
    rooms = rng.integers(1, 6, n)
    price = 50.0 * size + 800 * rooms + rng.normal(0, 50, n)
    where = rng.choice(["east", "west", "centre"], n)
    table = pd.DataFrame({"price": price, "size": size.astype(float), "rooms": rooms, "area": where})
    table = pd.concat([table, table.head(3)], ignore_index=True)
    table.loc[10, "size"] = np.nan
    table.loc[11, "price"] = np.nan
    return frame("price double, size double, rooms long, area string", **table.to_dict("list"))


@pytest.fixture(scope="session")
def outcomes(frame):
    rng = np.random.default_rng(2)
    n = 240
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = np.where(2 * x1 + 1.5 * x2 + rng.normal(0, 0.5, n) > 0, "Yes", "No")
    plan = rng.choice(["basic", "plus"], n)
    x1[5] = x2[5] = np.nan
    return frame(
        "outcome string, x1 double, x2 double, plan string", outcome=y, x1=x1, x2=x2, plan=plan
    )


@pytest.fixture(scope="session")
def blobs(frame):
    rng = np.random.default_rng(3)
    spots = np.repeat([[0, 0, 0], [8, 8, 0], [0, 8, 8]], 20, axis=0)
    points = spots + rng.normal(0, 0.4, (60, 3))
    return frame(
        "col_a double, col_b double, col_c double",
        col_a=points[:, 0], col_b=points[:, 1], col_c=points[:, 2],
    )
