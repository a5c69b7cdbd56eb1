import numpy as np
import pytest

from granary.operators import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(frame):
    """A third of the rows are one value, one group holds most rows, some are missing."""
    rng = np.random.default_rng(11)
    n = 9000
    x = np.round(np.exp(rng.normal(0, 2, n)), 3)
    x[: n // 3] = 1.0
    group = np.where(rng.random(n) < 0.8, "big", rng.choice(["b", "c"], n)).astype(object)
    group[-50:] = None
    x[-5:] = np.nan
    return frame("g string, x double", g=group, x=x)


def expected(pdf):
    return {
        (None if k != k else k,): list(s.x.quantile(PROBS)) for k, s in pdf.groupby("g", dropna=False)
    }


@pytest.mark.parametrize("listed", [1, 50, 10_000])
def test_narrowing_equals_pandas(skewed, monkeypatch, listed):
    monkeypatch.setattr(q, "LISTED_VALUES", listed)
    monkeypatch.setattr(q, "GRID_STEPS", 20)
    want = expected(skewed.toPandas())
    narrow = q.quantiles_by_group(skewed, ["x"], PROBS, ["g"])
    for key, values in want.items():
        assert narrow[key]["x"] == pytest.approx(values)


def test_a_few_repeated_values_do_not_stall(frame, monkeypatch):
    monkeypatch.setattr(q, "LISTED_VALUES", 1)
    monkeypatch.setattr(q, "GRID_STEPS", 4)
    x = np.repeat([1.0, 2.0, 3.0, 4.0, 5.0], [700, 1, 700, 1, 700])
    df = frame("x double", x=x)
    got = q.quantiles(df, ["x"], PROBS)["x"]
    assert got == pytest.approx(list(np.quantile(x, PROBS)))


def test_empty_and_null_columns(frame):
    df = frame("x double, y double", x=[None, None], y=[3.0, None])
    assert q.quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [3.0]}
    assert q.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_non_finite_values_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(q, "LISTED_VALUES", 5)
    rows = [(float(i),) for i in range(100)] + [(float("nan"),)] * 40 + [(float("inf"),), (float("-inf"),)]
    df = spark.createDataFrame(rows, "x double")
    assert q.quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"] == [0.0, 49.5, 99.0]


def test_a_rank_of_a_group_is_all_that_is_fetched(spark, monkeypatch):
    fetched = []
    frame = type(spark.range(0))
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        fetched.extend(v for r in rows for v in r for v in (v if isinstance(v, list) else [v]))
        return rows

    df = spark.range(40_000).selectExpr("id % 200 as g", "cast(id as double) as x")
    monkeypatch.setattr(frame, "collect", counted)
    found = q.medians_by_group(df, ["x"], ["g"])
    assert found[(7,)]["x"] == 7 + 200 * 99.5
    assert len(fetched) <= 200 * 6


def test_two_scans_however_many_columns_and_groups(spark, monkeypatch):
    scans = []
    frame = type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: scans.append(1) or collect(self))
    df = spark.range(60_000).selectExpr("id % 7 as g", "cast(id as double) as x", "cast(hash(id) as double) as y")
    found = q.quantiles_by_group(df, ["x", "y"], [0.1, 0.9], ["g"])
    pdf = df.toPandas()
    for g, rows in pdf.groupby("g"):
        for c in ("x", "y"):
            assert found[(g,)][c] == pytest.approx(list(rows[c].quantile([0.1, 0.9])))
    assert len(scans) == 2


def test_a_missed_bracket_is_noticed_and_widened(frame, monkeypatch):
    monkeypatch.setattr(q, "sketch_widths", lambda size: [1e-9, 1e-3, 0.2, 1.0])
    x = np.random.default_rng(4).normal(size=5_000)
    got = q.quantiles(frame("x double", x=x), ["x"], PROBS)["x"]
    assert got == pytest.approx(list(np.quantile(x, PROBS)))
