"""Recipes that might improve a model, each measured against the current setup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from granary.errors import ProcessingError, ValidationError
from granary.functions.kinds import NUMERIC, drop_null_rows, kinds, resolve
from granary.operators.clean import coerce_numeric_columns, drop_outliers
from granary.operators.features import Derived, build_features, prepare_features, propose_features
from granary.operators.models import TUNABLE, Search, cv_score, dealt_folds, tune
from granary.operators.profiling import class_balance, missing_counts
from granary.operators.query import sample_rows
from granary.plans.advice import screen_features
from granary.session import local_frame

EVAL_FOLDS = 3
MAX_ROW_LOSS = 0.25
MEANINGFUL_GAIN = 0.005
CANDIDATES = {
    "classification": (
        ("logistic", None), ("random_forest", {"numTrees": 40, "maxDepth": 8}), ("linear_svc", None),
    ),
    "regression": (
        ("ridge", None), ("random_forest", {"numTrees": 40, "maxDepth": 8}), ("linear", None),
    ),
}
SCHEMA = (
    "recipe string, score double, delta double, best_model string, rows_used long, "
    "features_used int, recommended boolean"
)


@dataclass(frozen=True)
class Current:
    """The setup in use, which every recipe is compared with."""

    features: Sequence[str] | None = None
    drops_outliers: bool = False
    best_model: str | None = None
    impute_numeric: str = "median"
    impute_categorical: str = "mode"
    derived: Sequence[Derived] = ()
    balances: bool = False


@dataclass(frozen=True)
class Improvements:
    recipes: DataFrame
    recommended: str
    baseline: float | None
    derived: list[Derived]
    search: Search | None


def _sampled(df: DataFrame, max_rows: int | None) -> DataFrame:
    return df if max_rows is None else sample_rows(df, max_rows)


def recipe_score(
    df: DataFrame, target: str, task: str, features: Sequence[str], current: Current,
    candidates=None, max_rows: int | None = None,
) -> tuple[float | None, str | None]:
    """Best cross-validated score over a few fast models; ``max_rows`` takes a seeded sample."""
    try:
        ready, _ = prepare_features(
            _sampled(df, max_rows), target, task, features,
            numeric=current.impute_numeric, categorical=current.impute_categorical,
        )
    except (ValidationError, ProcessingError):
        return None, None
    best: tuple[float | None, str | None] = (None, None)
    with dealt_folds(ready, task, EVAL_FOLDS) as folded:
        if folded is None:
            return None, None
        for name, params in candidates or CANDIDATES[task]:
            try:
                scored = cv_score(
                    name, folded, task, EVAL_FOLDS, current.balances, params=params
                )
            except Exception:  # noqa: BLE001 - a model that cannot be fitted is left out
                continue
            if scored and (best[0] is None or scored[0] > best[0]):
                best = (scored[0], name)
    return best


def suggest_improvements(
    df: DataFrame, target: str, task: str, current: Current = Current(), iterations: int = 12,
    candidates=None, max_rows: int | None = None,
) -> Improvements:
    """Score each applicable recipe. One that makes things worse is reported as worse.

    ``max_rows`` scores on a seeded sample of that many rows; by default all rows count.
    """
    target = resolve(df, target, "target")
    if task == "clustering":
        raise ValidationError("Improvements are measured against a target; clustering has none.")
    work = drop_null_rows(df, [target])
    work, _ = coerce_numeric_columns(work)
    advice = screen_features(work, target, task)
    kind = kinds(work)
    numeric = [c for c in advice.all_usable if kind[c] == NUMERIC]
    trimmed = drop_outliers(work, numeric, MAX_ROW_LOSS, inclusive=True)
    can_trim = trimmed.rows_removed > 0

    features = [c for c in (current.features or []) if c in work.columns] or advice.all_usable
    frame = trimmed.frame if current.drops_outliers and can_trim else work
    rows_all, rows_trimmed = trimmed.rows, trimmed.rows - trimmed.rows_removed
    rows_base = rows_trimmed if frame is not work else rows_all
    recipes: list[list] = []

    def add(key, data, columns, rows, setup=current):
        score, winner = recipe_score(data, target, task, columns, setup, candidates, max_rows)
        recipes.append([key, score, winner, rows, len(columns)])

    def changed(**settings) -> Current:
        return Current(**{**current.__dict__, **settings})

    add("baseline", frame, features, rows_base)
    fewer = sorted(advice.recommended) != sorted(features)
    if fewer:
        add("features", work, advice.recommended, rows_all)
    if can_trim and not current.drops_outliers:
        add("outliers", trimmed.frame, features, rows_trimmed)
        if fewer:
            add("both", trimmed.frame, advice.recommended, rows_trimmed)

    gaps = {r["column"] for r in missing_counts(work, features).collect() if r["missing"]}
    number_gaps = [c for c in gaps if kind[c] == NUMERIC]
    for strategy in ("mean", "zero"):
        if number_gaps and strategy != current.impute_numeric:
            add(f"impute_{strategy}", frame, features, rows_base, changed(impute_numeric=strategy))
    if len(gaps) > len(number_gaps) and current.impute_categorical != "constant":
        add("impute_constant", frame, features, rows_base, changed(impute_categorical="constant"))
    if task == "classification" and not current.balances:
        if class_balance(work, target).summary.first()["imbalanced"]:
            add("balanced", frame, features, rows_base, changed(balances=True))

    derived: list[Derived] = []
    if not current.derived:
        derived = propose_features(frame, target, task, features)
        built, added = build_features(frame, derived)
        if added:
            add("engineered", built, [*features, *added], rows_base)

    search = None
    if current.best_model in TUNABLE:
        ready, _ = prepare_features(_sampled(frame, max_rows), target, task, features)
        search = tune(current.best_model, ready, task, iterations)
        if search:
            recipes.append(["tuned", search.score, current.best_model, rows_base, len(features)])

    base = recipes[0][1]
    scored = [r for r in recipes if r[1] is not None]
    best = max(scored, key=lambda r: r[1]) if scored else None
    gain = best is not None and base is not None and best[1] - base >= MEANINGFUL_GAIN
    chosen = best[0] if gain else "baseline"
    table = [
        (
            key, score, None if score is None or base is None else round(score - base, 4), winner,
            rows, n, key == chosen,
        )
        for key, score, winner, rows, n in recipes
    ]
    return Improvements(local_frame(df.sparkSession, table, SCHEMA), chosen, base, derived, search)
