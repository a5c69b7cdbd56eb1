"""The end-to-end run: clean, derive, trim, split, prepare, fit, rank, tune, explain, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from granary.errors import ProcessingError, ValidationError
from granary.functions.kinds import col, drop_null_rows, resolve
from granary.operators.clean import coerce_numeric_columns, drop_empty_columns, drop_outliers
from granary.operators.features import (
    Derived, Preparation, build_features, fit_preparation, split_data,
)
from granary.operators.models import (
    CLUSTERING, DBSCAN_EPS, Result, class_probabilities, cluster_importance, cluster_zoo,
    compare_models, dbscan_labels, feature_importance, leaderboard, train_zoo, tune_and_keep,
)
from granary.operators.profiling import class_balance, detect_problem_type
from granary.operators.query import sample_rows
from granary.session import reused, spread

K_RANGE = (2, 9)


@dataclass
class Run:
    """A finished training run. ``best`` carries the fitted model."""

    task: str
    target: str | None
    preparation: Preparation
    results: list[Result]
    best: Result | None
    leaderboard: DataFrame
    importance: DataFrame
    facts: dict = field(default_factory=dict)


def train(
    df: DataFrame, target: str | None = None, task: str | None = None,
    features: Sequence[str] | None = None, remove_outliers: bool = False, tuning: bool = False,
    numeric: str = "median", categorical: str = "mode", derived: Sequence[Derived] = (),
    balanced: bool = False, models: Sequence[str] | None = None,
    k_range: tuple[int, int] = K_RANGE, eps_values: Sequence[float] = DBSCAN_EPS,
    max_rows: int | None = None, cross_validate: bool = True,
) -> Run:
    """Train and rank models on a table. ``max_rows`` trains on a seeded sample.

    Gaps are filled with values fitted on the training side only, so a chosen strategy counts
    and the held-out side stays unseen.
    """
    if target is not None:
        target = resolve(df, target, "target")
    frame, coerced = coerce_numeric_columns(df)
    frame, _ = drop_empty_columns(frame)
    detected = detect_problem_type(frame, target)
    task = task or detected.problem_type
    target = None if task == CLUSTERING else detected.target
    if task != CLUSTERING and target is None:
        raise ValidationError("No target column was found. Choose a target, or clustering.")
    if target is not None:
        frame = drop_null_rows(frame, [target])
    chosen = list(features) if features is not None else None
    facts: dict = {"coerced": coerced}
    with reused(frame.dropDuplicates()) as unique:
        rows, specs = unique, []
        if derived:
            rows, added = build_features(rows, derived)
            specs = [s for s in derived if s.column in added]
            chosen = None if chosen is None else list(dict.fromkeys([*chosen, *added]))
        facts["derived"] = [s.column for s in specs]
        if remove_outliers and task != CLUSTERING:
            trimmed = drop_outliers(rows, [c for c in rows.columns if c != target])
            rows = trimmed.frame
            facts["outliers_removed"] = trimmed.rows_removed
        if max_rows is not None:
            rows = sample_rows(rows, max_rows)
        # Derived columns are rebuilt by the preparation, on training and new rows alike.
        rows = rows.select(*[col(c) for c in unique.columns])
        options = {"numeric": numeric, "categorical": categorical, "derived": specs}
        if task == CLUSTERING:
            return _cluster(rows, chosen, options, k_range, eps_values, facts)
        return _supervised(
            rows, target, task, chosen, options, models, balanced, tuning, cross_validate, facts
        )


def _supervised(
    rows, target, task, chosen, options, models, balanced, tuning, cross_validate, facts
) -> Run:
    spark = rows.sparkSession
    train_rows, test_rows = split_data(rows, target, task)
    prep = fit_preparation(train_rows, target, task, chosen, **options)
    n = rows.count()
    sides = [spread(prep.labelled(side), n) for side in (train_rows, test_rows)]
    with reused(sides[0]) as train_side, reused(sides[1]) as test_side:
        facts["train_rows"], facts["test_rows"] = train_side.count(), test_side.count()
        if not facts["train_rows"] or not facts["test_rows"]:
            raise ProcessingError("Too few rows to hold some out for testing.")
        if task == "classification":
            facts["class_balance"] = class_balance(rows, target).summary.first().asDict()
        results = train_zoo(train_side, test_side, task, models, balanced, cross_validate)
        ranked = compare_models(results, task)
        best = ranked[0] if ranked else None
        if best is not None and tuning:
            tuned = tune_and_keep(best, train_side, test_side)
            results = [tuned if r is best else r for r in results]
            facts["tuned"] = tuned.params
            ranked = compare_models(results, task)
            best = ranked[0]
        board = leaderboard(spark, results, task)
        importance = feature_importance(spark, best.model if best else None, prep.feature_names)
        return Run(task, target, prep, results, best, board, importance, facts)


def _cluster(rows, chosen, options, k_range, eps_values, facts) -> Run:
    spark = rows.sparkSession
    prep = fit_preparation(rows, None, CLUSTERING, chosen, **options)
    facts["train_rows"] = rows.count()
    with reused(spread(prep.labelled(rows), facts["train_rows"])) as ready:
        results = cluster_zoo(ready, k_range, eps_values)
        ranked = compare_models(results, CLUSTERING)
        best = ranked[0] if ranked else None
        board = leaderboard(spark, results, CLUSTERING)
        importance = cluster_importance(best.model if best else None, ready, prep.feature_names)
        return Run(CLUSTERING, None, prep, results, best, board, importance, facts)


@dataclass(frozen=True)
class Scorer:
    """A fitted model with its preparation: what scoring needs, and what a saved run holds."""

    preparation: Preparation
    model: object
    name: str

    @property
    def required_columns(self) -> list[str]:
        return self.preparation.required

    @property
    def class_labels(self) -> list[str] | None:
        return self.preparation.class_labels


def scorer(run: Run, name: str | None = None) -> Scorer:
    wanted = name or (run.best.name if run.best else None)
    found = next((r for r in run.results if r.name == wanted and r.status == "ok"), None)
    if found is None or found.model is None:
        raise ValidationError("No model of this run was fitted")
    return Scorer(run.preparation, found.model, found.name)


def predict(df: DataFrame, run: Run | Scorer) -> DataFrame:
    """The rows with ``predicted`` and, where the model has them, class probabilities."""
    made = scorer(run) if isinstance(run, Run) else run
    prep = made.preparation
    if prep.task == CLUSTERING:
        raise ValidationError("A clustering run has no target to predict")
    scored = prep.decode(made.model.transform(prep.transform(df)))
    out = [*df.columns, "predicted"]
    if prep.task == "classification" and "probability" in scored.columns:
        scored = class_probabilities(scored, prep.class_labels)
        out.append("confidence")
    return scored.select(*[col(c) for c in out])


def assign_clusters(df: DataFrame, run: Run, eps: float | None = None) -> DataFrame:
    """``(features, prediction)`` of rows under a clustering run."""
    ready = run.preparation.transform(df, [])
    if run.best is not None and run.best.model is not None:
        return run.best.model.transform(ready)
    if eps is None:
        raise ValidationError("Density clusters need eps to be computed again.")
    return dbscan_labels(ready, eps)
