import numpy as np
import pandas as pd
import pytest

from granary.errors import ValidationError
from granary.operators import profiling as p
from granary.operators.reshape import box_summary, histogram, scatter_pairs, target_distribution


def test_profile_and_statistics_match_pandas(sales):
    pdf = sales.toPandas()
    columns = {r["column"]: r for r in p.analyze_dataset(sales).columns.collect()}
    for c in pdf.columns:
        assert columns[c]["distinct"] == pdf[c].nunique()
        assert columns[c]["missing"] == 0
    stats = {r["column"]: r for r in p.generate_statistics(sales).numeric.collect()}
    want = pdf.revenue.describe()
    assert stats["revenue"]["std"] == pytest.approx(want["std"])
    assert stats["revenue"]["q1"] == pytest.approx(want["25%"])


def test_missing_audit(gappy):
    audit = p.detect_missing_values(gappy)
    assert audit.totals.first().asDict() == {
        "total_missing": 2, "pct_missing": 25.0, "columns_affected": 2, "empty_columns": 0,
    }
    assert [r["imputation"] for r in audit.columns.collect()] == ["mode", "median"]


def test_duplicates_count_nulls_as_equal(frame):
    df = frame("a double, b string", a=[1.0, None, None, 1.0, 2.0], b=["x", None, None, "x", "y"])
    assert p.duplicate_rows(df).first()[0] == 2


def test_correlation_is_pairwise_complete(frame):
    rng = np.random.default_rng(4)
    a = rng.normal(size=50)
    b, c = a + rng.normal(0, 0.1, 50), rng.normal(size=50)
    b[:10] = np.nan
    df = frame("a double, b double, c double", a=a, b=b, c=c)
    want = pd.DataFrame({"a": a, "b": b, "c": c}).corr()
    found = p.generate_correlation_matrix(df)
    for r in found.matrix.collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]], abs=6e-4)
    assert tuple(found.top_pairs.first())[:2] == ("a", "b")
    assert p.generate_correlation_matrix(df.select("a")) is None


def test_codes_are_never_outliers(frame):
    df = frame("code long", code=[1] * 100 + [2] * 15 + [90] * 5)
    assert p.detect_outliers(df).count() == 0


@pytest.mark.parametrize(
    ("columns", "target", "task"),
    [
        ({"size": range(30), "price": [float(i * 3) for i in range(30)]}, "price", "regression"),
        ({"x": [0.5, 1.5, 2.5] * 4, "active": ["Yes", "No", "Yes"] * 4}, "active", "classification"),
        ({"a": [float(i) for i in range(20)], "b": [float(i * i) for i in range(20)]}, None, "clustering"),
    ],
)
def test_task_detection(frame, columns, target, task):
    found = p.detect_problem_type(frame(**columns))
    assert (found.target, found.problem_type) == (target, task)


def test_given_target_wins(frame):
    df = frame(a=[1.0, 2.0, 3.0] * 5, price=[float(i) for i in range(15)])
    found = p.detect_problem_type(df, "a")
    assert (found.target, found.problem_type, found.confidence) == ("a", "classification", "high")
    with pytest.raises(ValidationError):
        p.detect_problem_type(df, "nope")


def test_identifiers_and_constants_are_no_roles(frame):
    n = 300
    df = frame(
        "order_id long, region string, revenue double, constant string",
        order_id=range(1000, 1000 + n), region=["a", "b", "c"] * 100,
        revenue=np.random.default_rng(0).normal(50, 9, n), constant=["x"] * n,
    )
    roles = {r["column"]: r["role"] for r in p.dashboard_layout(df).collect()}
    assert roles == {"region": "dimension", "revenue": "measure"}
    assert p.is_identifier(df, "order_id") and not p.is_identifier(df, "revenue")


def test_a_counter_with_repeats_is_an_identifier(frame):
    df = frame("id long", id=[*range(1, 892), *range(1, 6)])
    assert p.is_identifier(df, "id")


def test_dates_are_found_in_text(sales, frame):
    assert p.detect_datetime_columns(sales) == ["order_date"]
    words = frame("created string", created=["soon", "later", "2024-01-01", "never", "x"])
    assert p.detect_datetime_columns(words) == []


def test_histogram_covers_every_value(sales):
    bins = histogram(sales, "revenue").collect()
    assert len(bins) == 30 and sum(b["count"] for b in bins) == 300
    assert histogram(sales.selectExpr("1.0 as x"), "x").first()["count"] == 300


def test_chart_tables(sales):
    boxes = {r["column"]: r for r in box_summary(sales).collect()}
    z = sales.toPandas().revenue
    z = (z - z.mean()) / z.std(ddof=0)
    assert boxes["revenue"]["median"] == pytest.approx(z.median())
    assert target_distribution(sales, "region").count() == 3
    assert scatter_pairs(sales, "revenue")[0][0] == "units"


def test_class_balance_of_a_lopsided_label(frame):
    df = frame("y long", y=[0] * 92 + [1] * 8)
    found = p.class_balance(df, "y").summary.first()
    assert (found["largest_share"], found["imbalanced"]) == (0.92, True)
