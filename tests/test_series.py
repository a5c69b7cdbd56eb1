import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import dates
from granary.functions.dates import parse_datetime

from granary.errors import ValidationError
from granary.operators.series import time_series


def line(frame, values, start="2023-01-01"):
    days = pd.date_range(start, periods=len(values), freq="D").strftime("%Y-%m-%d")
    return frame("d string, v double", d=days, v=values)


def test_rising_series_rises(frame):
    rng = np.random.default_rng(0)
    s = time_series(line(frame, np.arange(200) + rng.normal(0, 5, 200)), "d", "v", "mean")
    assert s.freq == "D"
    assert s.trend.first()["direction"] == "rising"
    assert s.fit.significant


def test_noise_is_flat(frame):
    s = time_series(line(frame, np.random.default_rng(1).normal(50, 5, 200)), "d", "v", "mean")
    assert s.fit.direction == "flat"


def test_spike_is_flagged(frame):
    values = np.random.default_rng(2).normal(50, 1, 120)
    values[60] = 500
    found = time_series(line(frame, values), "d", "v", "sum").anomalies.collect()
    assert [(str(r["period"]), r["direction"]) for r in found] == [("2023-03-02", "spike")]


@pytest.mark.parametrize("agg", ["sum", "mean", "median", "min", "max", "std", "count", "nunique"])
@pytest.mark.parametrize("freq", ["D", "W", "ME", "QE", "YE"])
def test_resampling_equals_pandas(frame, agg, freq):
    rng = np.random.default_rng(5)
    days = pd.to_datetime("2021-11-03") + pd.to_timedelta(np.sort(rng.choice(900, 120)), unit="D")
    values = np.round(rng.normal(10, 3, 120), 2)
    values[7] = np.nan
    df = frame("d string, v double", d=days.strftime("%Y-%m-%d"), v=values)
    want = pd.Series(values, index=days).resample(freq).agg(agg).dropna()
    got = time_series(df, "d", "v", agg, freq).line.collect()
    assert [str(r["period"]) for r in got] == [str(i.date()) for i in want.index]
    assert [r["value"] for r in got] == pytest.approx(list(want.astype(float)))


def test_points_change_and_moving_average(frame):
    values = [10.0, 20.0, 0.0, 5.0, 10.0, 40.0]
    points = time_series(line(frame, values), "d", "v").points.orderBy("position").collect()
    assert [r["change_pct"] for r in points] == [None, 100.0, -100.0, None, 100.0, 300.0]
    want = pd.Series(values).rolling(2, min_periods=1).mean()
    assert [r["moving_average"] for r in points] == pytest.approx(list(want))


def test_constant_line_has_no_trend(frame):
    s = time_series(line(frame, [5.0] * 30), "d", "v", "mean")
    assert s.fit.direction == "flat" and s.anomalies.count() == 0
    assert s.summary.first()["total_change_pct"] == 0.0


def test_seasonality_needs_a_long_span(frame):
    short = time_series(line(frame, [1.0] * 10), "d", "v")
    assert short.seasonality.count() == 0
    year = time_series(line(frame, np.arange(400.0)), "d", "v", "mean")
    assert year.seasonality.groupBy("cycle").count().count() == 2


def test_rejections(frame, sales):
    with pytest.raises(ValidationError, match="at least 4 rows"):
        time_series(line(frame, [1.0, 2.0]), "d", "v")
    with pytest.raises(ValidationError, match="one period"):
        time_series(line(frame, [1.0] * 6), "d", "v", "sum", "YE")
    with pytest.raises(ValidationError, match="numbers|non-numeric"):
        time_series(sales, "order_date", "region", "mean")
    with pytest.raises(ValidationError):
        time_series(sales, "units", "revenue")
    with pytest.raises(ValidationError, match="No column"):
        time_series(sales, "when", "revenue")


def test_dates_in_many_layouts(spark):
    texts = [
        "2024-01-05", "2024-01-05 10:00:00.123", "2024-01-05T10:00:00.123Z", "1/5/2024", "Jan 5, 2024", "05-Jan-2024",
        "20240105", "5.1.2024", "1/5/2024 9:30",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    found = [r[0] for r in df.select(parse_datetime(F.col("d")).cast("date").cast("string")).collect()]
    assert found == ["2024-01-05"] * len(texts)
    wrong = spark.createDataFrame([("2024-13-05",), ("20241305",), ("Jan",), ("12",), ("x 2024",)], "d string")
    assert [r[0] for r in wrong.select(parse_datetime(F.col("d"))).collect()] == [None] * 5


def test_the_order_of_day_and_month_is_the_columns_own(spark):
    rows = [
        ("13/02/2024", "02/13/2024", "03/02/2024", "13/02/2024", "3.2.2024"),
        ("03/02/2024", "02/03/2024", "04/02/2024 10:15", "02/13/2024", "x"),
        (None, "99/99/2024", "", "03/02/2024", "04/31/2024"),
    ]
    df = spark.createDataFrame(rows, "day string, month string, either string, both string, dots string")
    orders = dates.date_orders(df, df.columns)
    assert orders == {
        "day": dates.DAY_FIRST, "month": dates.MIXED, "either": dates.OPEN, "both": dates.MIXED, "dots": dates.MONTH_FIRST
    }
    assert dates.date_orders(df.limit(0), ["day"]) == {"day": dates.OPEN}
    found = df.select(*[dates.as_datetime(df, c).cast("date").cast("string").alias(c) for c in ("day", "month", "either", "both")])
    assert [tuple(r) for r in found.collect()] == [
        ("2024-02-13", "2024-02-13", "2024-03-02", "2024-02-13"),
        ("2024-02-03", "2024-02-03", "2024-04-02", "2024-02-13"),
        (None, None, None, "2024-03-02"),
    ]


def test_masks_of_long_and_foreign_texts(spark):
    df = spark.createDataFrame([("1" * 100,), ("Ab\u00e9 12",), ("Ab\u00e9 99",), (None,)], "t string")
    found = {r["mask"]: r["rows"] for r in dates.mask_counts(df, ["t"]).collect()}
    assert found == {None: 1, "aaa 00": 2}
