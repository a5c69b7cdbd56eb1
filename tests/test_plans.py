import numpy as np
import pytest

from granary.errors import ValidationError
from granary.operators.features import Derived
from granary.operators.query import Filter
from granary.plans import advice, analysis, dashboard, improve, insights, training
from granary.sources import runs

FAST = (("logistic", None), ("decision_tree", None))


def test_insights_are_ranked_and_counted(sales):
    found = insights.generate_insights(sales)
    scores = [r["importance"] for r in found.findings.collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) <= 12
    assert found.skipped == []
    kinds = {r["kind"] for r in found.by_kind.collect()}
    assert "trend" in kinds


def test_dominant_value_and_empty_column_are_noticed(frame):
    rng = np.random.default_rng(41)
    a = np.full(300, np.nan)
    a[:60] = rng.normal(size=60)
    df = frame("flag string, a double, v double", flag=["x"] * 285 + ["y"] * 15, a=a, v=rng.normal(size=300))
    found = {(r["kind"], tuple(r["columns"])): r for r in insights.generate_insights(df).findings.collect()}
    assert found["imbalance", ("flag",)]["importance"] == 95.0
    assert found["data_quality", ("a",)]["importance"] == 95.0


def test_segments_outliers_and_duplicates_are_noticed(frame):
    rng = np.random.default_rng(42)
    g = np.repeat(["a", "b"], 200)
    v = np.r_[rng.normal(10, 1, 200), rng.normal(20, 1, 200)]
    w = rng.normal(0, 1, 400)
    w[:40] = 50 + np.arange(40)
    df = frame("g string, v double, w double", g=[*g, *g[:40]], v=[*v, *v[:40]], w=[*w, *w[:40]])
    kinds = {r["kind"] for r in insights.generate_insights(df, 50).findings.collect()}
    assert {"segment_difference", "outliers", "data_quality", "skew"} <= kinds


def test_dashboard_follows_the_filters(sales):
    made = dashboard.build_dashboard(sales, [Filter("region", "=", "north")])
    pdf = sales.toPandas()
    north = pdf[pdf.region == "north"]
    tiles = {r["tile"]: r for r in made.kpis.collect()}
    assert tiles["rows"]["value"] == len(north) and tiles["rows_total"]["value"] == 300
    assert tiles["total"]["value"] == pytest.approx(north.revenue.sum())
    assert (made.measure, made.dimension, made.date) == ("revenue", "region", "order_date")
    assert [r["group"] for r in made.bars.collect()] == ["north"]
    assert made.timeline.line.count() > 2
    empty = dashboard.build_dashboard(sales, [Filter("units", ">", 999)])
    assert empty.bars is None and empty.kpis.first()["value"] == 0
    with pytest.raises(ValidationError):
        dashboard.build_dashboard(sales, measure="nope")


def test_analysis_bundle(houses):
    found = analysis.analyze(houses)
    assert found.task.target == "price" and found.task.problem_type == "regression"
    assert found.profile.summary.first()["duplicate_rows"] == 3
    assert {r["column"] for r in found.missing.columns.collect()} == {"size", "price"}
    assert found.scatter.count() > 0 and found.preview.count() == 63


@pytest.fixture(scope="module")
def survival(frame):
    rng = np.random.default_rng(43)
    n = 400
    sex = rng.choice(["m", "f"], n)
    survived = (rng.random(n) < np.where(sex == "f", 0.8, 0.2)).astype(int)
    cabin = np.where(rng.random(n) < 0.2, "C1", None)
    return frame(
        "row_id long, survived long, sex string, pclass long, lucky_number double, cabin string, full_name string",
        row_id=range(n), survived=survived, sex=sex, pclass=rng.integers(1, 4, n),
        lucky_number=rng.random(n), cabin=cabin, full_name=[f"name {i}" for i in range(n)],
    )


def test_advice_keeps_signal_and_drops_identifiers(survival):
    found = advice.suggest_features(survival, "survived", "classification")
    verdict = {r["column"]: r["verdict"] for r in found.columns.collect()}
    assert verdict["sex"] == "keep" and verdict["lucky_number"] == "weak"
    for column in ("row_id", "cabin", "full_name"):
        assert verdict[column] == "drop"
    assert found.recommended[0] == "sex" and found.score_all is not None
    with pytest.raises(ValidationError):
        advice.suggest_features(survival, "survived", "clustering")


def test_advice_flags_a_leak_and_is_never_empty(frame):
    rng = np.random.default_rng(44)
    y = rng.normal(size=200)
    df = frame("y double, copy double, noise double", y=y, copy=2 * y, noise=rng.normal(size=200))
    found = advice.screen_features(df, "y", "regression")
    assert {r["column"]: r["verdict"] for r in found.columns.collect()}["copy"] == "review"
    assert found.recommended


def test_recipes_are_measured_against_the_current_setup(frame):
    rng = np.random.default_rng(45)
    n = 260
    age = rng.integers(20, 80, n).astype(float)
    pressure = rng.normal(120, 10, n)
    pressure[:6] = 400
    target = (age + rng.normal(0, 8, n) > 50).astype(int)
    age[::9] = np.nan
    df = frame("age double, pressure double, noise double, target long", age=age, pressure=pressure, noise=rng.normal(size=n), target=target)
    found = improve.suggest_improvements(
        df, "target", "classification", improve.Current(best_model="decision_tree"), iterations=2,
        candidates=FAST,
    )
    rows = {r["recipe"]: r for r in found.recipes.collect()}
    assert {"baseline", "outliers", "impute_mean", "impute_zero", "tuned"} <= set(rows)
    for r in rows.values():
        assert r["delta"] == pytest.approx(r["score"] - found.baseline, abs=1e-4)
    assert rows["outliers"]["rows_used"] < rows["baseline"]["rows_used"]
    if found.recommended != "baseline":
        assert rows[found.recommended]["delta"] >= 0.005 - 1e-4


def test_regression_run_and_saved_scoring(houses, tmp_path):
    run = training.train(houses, models=["linear", "ridge", "decision_tree"])
    assert (run.task, run.target) == ("regression", "price")
    assert run.best.metrics["r2"] > 0.9
    assert all(r.cv is not None for r in run.results)
    board = run.leaderboard.collect()
    assert [r["rank"] for r in board] == [1, 2, 3]
    new = houses.drop("price")
    scored = training.predict(new, run)
    assert scored.count() == 63 and scored.where("predicted is null").count() == 0
    runs.save_run(run, str(tmp_path / "run"))
    loaded = runs.load_run(str(tmp_path / "run"))
    assert loaded.required_columns == ["area", "rooms", "size"]
    again = training.predict(new, loaded)
    assert sorted(r["predicted"] for r in again.collect()) == pytest.approx(
        sorted(r["predicted"] for r in scored.collect())
    )
    with pytest.raises(ValidationError, match="size"):
        training.predict(new.drop("size"), loaded)


def test_classification_run(outcomes, tmp_path):
    run = training.train(
        outcomes, models=["logistic", "naive_bayes", "knn"], cross_validate=False, balanced=True,
        derived=[Derived("product", "x1", "x2")],
    )
    assert (run.task, run.target) == ("classification", "outcome")
    assert run.best.metrics["f1"] > 0.8
    assert sum(run.best.metrics["support"]) == run.facts["test_rows"]
    scored = training.predict(outcomes.drop("outcome"), training.scorer(run, "logistic"))
    first = scored.first()
    assert first["predicted"] in ("Yes", "No")
    assert sum(first["confidence"].values()) == pytest.approx(1, abs=1e-3)
    assert "x1_x_x2" in run.preparation.feature_names
    runs.save_run(run, str(tmp_path / "knn"), "knn")
    assert training.predict(outcomes, runs.load_run(str(tmp_path / "knn"))).count() == 240


def test_outliers_can_be_removed_and_winner_tuned(houses):
    run = training.train(houses, "price", models=["ridge"], remove_outliers=True, tuning=True, cross_validate=False)
    assert run.facts["outliers_removed"] >= 0
    assert "tuned" in run.facts


def test_clustering_run(blobs):
    run = training.train(blobs, task="clustering", k_range=(2, 4), eps_values=(0.5,))
    assert run.target is None and run.best.metrics["k"] == 3
    with pytest.raises(ValidationError):
        training.predict(blobs, run)


def test_training_errors(blobs, outcomes):
    with pytest.raises(ValidationError):
        training.train(outcomes, "nope")
    with pytest.raises(ValidationError, match="No target"):
        training.train(blobs, task="regression")


def test_training_rows_are_dealt_by_their_number(houses, blobs, monkeypatch):
    parts = []

    def zoo(kept, at):
        def run(df, *rest, **named):
            parts.append(df.rdd.getNumPartitions())
            return kept(df, *rest, **named)
        monkeypatch.setattr(training, at, run)

    zoo(training.train_zoo, "train_zoo")
    zoo(training.cluster_zoo, "cluster_zoo")
    training.train(houses, models=["linear"], cross_validate=False)
    training.train(blobs, task="clustering", k_range=(2, 2), eps_values=(1.0,))
    assert parts == [1, 1]


def test_recipes_deal_the_folds_once_for_all_models(frame, monkeypatch):
    rng = np.random.default_rng(3)
    df = frame("x double, y double", x=rng.normal(size=90), y=rng.normal(size=90))
    seen = []

    def score(name, rows, *rest, **named):
        seen.append((rows.rdd.getNumPartitions(), "__fold" in rows.columns))
        return 0.5, 0.0

    monkeypatch.setattr(improve, "cv_score", score)
    found = improve.recipe_score(df, "y", "regression", ["x"], improve.Current(), (("ridge", None), ("linear", None)))
    assert found == (0.5, "ridge") and seen == [(1, True)] * 2
