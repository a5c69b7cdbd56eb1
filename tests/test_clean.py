import numpy as np
import pytest

from granary.errors import ValidationError
from granary.functions.kinds import normalise_nulls
from granary.operators import clean as c


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_numbers_in_text_are_read(frame):
    df = frame(
        "value string, height string, weight string, rating string, name string",
        value=["€110.5M", "€7.5K", "€900"], height=["5'7", "6'0", "5'11"],
        weight=["159lbs", "1,250lbs", "70 lbs"], rating=["88+2", "70", "65+1"],
        name=["Ann", "Bob", "Cid"],
    )
    out, converted = c.coerce_numeric_columns(df)
    assert converted == ["value", "height", "weight", "rating"]
    assert column(out, "value") == [110_500_000.0, 7500.0, 900.0]
    assert column(out, "height") == [67.0, 72.0, 71.0]
    assert column(out, "weight") == [159.0, 1250.0, 70.0]
    assert column(out, "rating") == [90.0, 70.0, 66.0]
    assert column(out, "name") == ["Ann", "Bob", "Cid"]


def test_text_that_seldom_parses_or_never_varies_stays(frame):
    df = frame("a string, b string", a=["1", "two", "three", "4"], b=["7", "7", "7", "7"])
    assert c.coerce_numeric_columns(df)[1] == []


@pytest.mark.parametrize(
    ("numeric", "categorical", "n", "text"),
    [
        ("median", "mode", 2.0, "a"), ("mean", "constant", 103 / 3, "missing"),
        ("zero", "mode", 0.0, "a"),
    ],
)
def test_imputation(gappy, numeric, categorical, n, text):
    out, table = c.impute(gappy, numeric, categorical)
    assert column(out, "n")[2] == pytest.approx(n)
    assert column(out, "c")[2] == text
    assert table.count() == 2


def test_unknown_strategies_are_rejected(gappy):
    with pytest.raises(ValidationError):
        c.impute(gappy, "guess")
    with pytest.raises(ValidationError):
        c.clean_dataset(gappy, categorical="guess")


def test_tied_modes_take_the_smallest(frame):
    df = frame("t string, flag boolean", t=["b", "a", None], flag=[True, None, True])
    out, _ = c.impute(df)
    assert column(out, "t")[2] == "a"
    assert column(out, "flag")[1] is True


def test_full_clean(frame):
    df = frame(
        "a double, t string, empty double",
        a=[1.0, 1.0, None, 4.0, 8.0], t=["x", "x", "y", None, "x"], empty=[None] * 5,
    )
    out = c.clean_dataset(df)
    assert out.duplicates == 1 and out.removed == ["empty"]
    assert sorted(tuple(r) for r in out.frame.collect()) == [
        (1.0, "x"), (4.0, "x"), (4.0, "y"), (8.0, "x"),
    ]
    steps = {(r["step"], r["column"]): r["count"] for r in out.report.collect()}
    assert steps["rows_before", None] == 5 and steps["rows_after", None] == 4
    assert steps["impute_median", "a"] == 1


def test_clean_table_needs_no_shuffle(spark):
    df = spark.range(50).selectExpr("id", "id * 0.5 as half")
    out = c.clean_dataset(df)
    assert out.duplicates == 0 and not out.fills
    plan = out.frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.fixture(scope="module")
def clinical(frame):
    rng = np.random.default_rng(9)
    pressure = np.r_[[400.0] * 6, rng.normal(120, 10, 254)]
    return frame(
        "age long, pressure double, code long",
        age=rng.integers(20, 80, 260), pressure=pressure, code=[1, 2] * 130,
    )


def test_outlier_rows_and_limits(clinical):
    flagged = c.outlier_rows(clinical, ["age", "pressure", "code"]).where("is_outlier")
    assert flagged.where("pressure = 400").count() == 6
    trimmed = c.drop_outliers(clinical, ["pressure"])
    assert trimmed.frame.count() == 260 - trimmed.rows_removed and trimmed.rows_removed >= 6
    kept = c.drop_outliers(clinical, ["pressure"], max_loss=0.001)
    assert kept.rows_removed == 0 and kept.flagged == trimmed.flagged


def test_nan_and_infinity_become_null(spark):
    df = spark.sql("select double('NaN') x union all select double('-Infinity') union all select 2.5D")
    assert sorted(column(normalise_nulls(df), "x"), key=str) == [2.5, None, None]
