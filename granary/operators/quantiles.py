"""Exact quantiles, whole-table or per group, in two scans and without one task holding a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here the first scan
counts the values and sketches their ranks (KLL, merged from the tasks, of known error) for all
columns and groups together; the executors read off a bracket around each wanted rank that is wide
enough for that error. The second scan counts the values inside the brackets one by one and those
between them by gap, so the sorted counts say exactly which value has the wanted rank, or that the
bracket missed it; then a wider one is taken. What is fetched is a bracket and a number per
quantile and group. A value repeated billions of times is one count. Brackets that still hold many
values of a very large table are narrowed by further scans first. Values that are NaN or infinite
are left out, as missing ones are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import col
from granary.session import local_frame, take_bounded

#: Values that a bracket may hold, by its width, when they are counted one by one.
LISTED_VALUES = 2_000_000
#: Steps of the sketch that narrows a bracket, and how many steps around a rank are kept.
GRID_STEPS, SPARE_STEPS = 200, 4
#: Size of a sketch of a whole table, and of one of many groups.
TABLE_SKETCH, GROUP_SKETCH = 4_096, 512
MAX_GROUPS = 100_000

Key = tuple


@dataclass
class _Slot:
    """One column of one group: its count, and a bracket of values for each quantile."""

    key: Key
    column: str
    n: int
    brackets: list[tuple[float, float]]
    width: float
    answer: list[float | None] | None = None


def sketch_widths(size: int) -> list[float]:
    """Half widths of brackets in ranks: 2.5 times the 99 % error of a sketch first, up to 1."""
    widths = [2.5 * 2.296 / size**0.9021]
    while widths[-1] < 0.5:
        widths.append(3 * widths[-1])
    return [*(w for w in widths if w < 1), 1.0]


def quantiles_by_group(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    max_groups: int = MAX_GROUPS,
) -> dict[Key, dict[str, list[float | None]]]:
    """``{group: {column: [quantile, ...]}}`` with linear interpolation, non-finite values left out."""
    if not columns:
        return {}
    data = df.select(
        *[col(k).alias(f"key{i}") for i, k in enumerate(keys)],
        *[_finite(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    key_names = [f"key{i}" for i in range(len(keys))]
    names = [f"v{i}" for i in range(len(columns))]
    probs = [float(p) for p in probs]
    rows = _sketched(data, key_names, names, probs, 0, max_groups)
    found = {id(r): tuple(r[k] for k in key_names) for r in rows}
    slots = _slots(rows, found, names, probs, 0)
    attempt = 0
    while open_slots := [s for s in slots if s.answer is None]:
        if attempt:
            # a bracket missed its rank, which the counts have shown: sketch anew, look wider
            rows = _sketched(data, key_names, names, probs, attempt, max_groups)
            again = {id(r): tuple(r[k] for k in key_names) for r in rows}
            wider = {(s.key, s.column): s for s in _slots(rows, again, names, probs, attempt)}
            for s in open_slots:
                s.brackets, s.width = wider[s.key, s.column].brackets, wider[s.key, s.column].width
        _narrowed(data, key_names, open_slots, probs)
        _counted(data, key_names, open_slots, probs)
        attempt += 1
    out = {key: {c: [None] * len(probs) for c in columns} for key in found.values()}
    for s in slots:
        out[s.key][columns[names.index(s.column)]] = s.answer
    return out


def _finite(value):
    return F.when(F.abs(value) < F.lit(math.inf), value)


def _widths(key_names: list[str]) -> list[float]:
    return sketch_widths(GROUP_SKETCH if key_names else TABLE_SKETCH)


def _step(n: float, widths: list[float], attempt: int) -> int:
    """The first width that spans two values on either side, or a wider one after a miss."""
    first = next((i for i, w in enumerate(widths) if n * w >= 2), len(widths) - 1)
    return min(first + attempt, len(widths) - 1)


def _sketched(data, key_names, names, probs, attempt, max_groups):
    """The first scan: per group and column the count and the brackets of its width."""
    widths = _widths(key_names)
    size = GROUP_SKETCH if key_names else TABLE_SKETCH
    ranks = [[(max(0.0, p - w), min(1.0, p + w)) for p in probs] for w in widths]
    flat = F.array(*[F.lit(x) for by_width in ranks for pair in by_width for x in pair])
    counted = data.groupBy(*key_names).agg(
        *[F.count(v).alias(f"n_{v}") for v in names],
        *[F.kll_sketch_agg_double(v, F.lit(size)).alias(f"s_{v}") for v in names],
    )
    picked = []
    for v in names:
        n = F.col(f"n_{v}")
        step = F.lit(len(widths) - 1)
        for i in range(len(widths) - 1, -1, -1):
            step = F.when(n * widths[i] >= 2, min(i + attempt, len(widths) - 1)).otherwise(step)
        values = F.kll_sketch_get_quantile_double(f"s_{v}", flat)
        picked += [n, F.when(n > 0, F.slice(values, step * (2 * len(probs)) + 1, 2 * len(probs))).alias(f"b_{v}")]
    message = f"More than {max_groups} groups to take quantiles of"
    return take_bounded(counted.select(*key_names, *picked), max_groups, message)


def _slots(rows, keys, names, probs, attempt) -> list[_Slot]:
    widths = sketch_widths(GROUP_SKETCH if any(keys.values()) else TABLE_SKETCH)
    out = []
    for r in rows:
        for v in names:
            if r[f"n_{v}"]:
                b = r[f"b_{v}"]
                pairs = [(b[2 * j], b[2 * j + 1]) for j in range(len(probs))]
                out.append(_Slot(keys[id(r)], v, r[f"n_{v}"], pairs, widths[_step(r[f"n_{v}"], widths, attempt)]))
    return out


def _table(data, key_names, slots, columns: str, values) -> DataFrame:
    """A broadcast row per slot: the group's key, the place of the slot and of its column, values."""
    schema = T.StructType(
        [T.StructField("of_" + k, data.schema[k].dataType) for k in key_names]
        + T._parse_datatype_string("slot long, of_column int" + (", " + columns if columns else "")).fields
    )
    rows = [(*s.key, i, int(s.column[1:]), *values(s)) for i, s in enumerate(slots)]
    return F.broadcast(local_frame(data.sparkSession, rows, schema))


def _values(data, key_names, slots) -> DataFrame:
    """The keys, ``column`` and ``x``: a row per value of the columns that have a slot."""
    wanted = sorted({int(s.column[1:]) for s in slots})
    stacked = [e for c in wanted for e in (F.lit(c), F.col(f"v{c}"))]
    return data.select(*key_names, F.stack(F.lit(len(wanted)), *stacked).alias("column", "x")).where("x is not null")


def _in_slots(data, key_names, slots, columns, values) -> DataFrame:
    match = [F.col("column") == F.col("of_column")]
    match += [F.col(k).eqNullSafe(F.col("of_" + k)) for k in key_names]
    table = _table(data, key_names, slots, columns, values)
    return _values(data, key_names, slots).join(table, match).drop("column", "of_column", *["of_" + k for k in key_names], *key_names)


def _narrowed(data, key_names, slots, probs) -> None:
    """Narrow brackets that hold too many values to count, by a sketch of what is inside."""
    inside = {id(s): s.n * min(1.0, 2 * s.width) for s in slots}
    seen = {id(s): math.inf for s in slots}
    size = GROUP_SKETCH if key_names else TABLE_SKETCH
    grid = F.array(*[F.lit(i / GRID_STEPS) for i in range(GRID_STEPS + 1)])
    while wide := [s for s in slots if inside[id(s)] > LISTED_VALUES]:
        columns = ", ".join(f"low{j} double, high{j} double" for j in range(len(probs)))
        joined = _in_slots(data, key_names, wide, columns + ", n long", lambda s: [*(x for b in s.brackets for x in b), s.n])
        asked = [F.any_value("n").alias("n")]
        for j in range(len(probs)):
            x, low, high = F.col("x"), F.col(f"low{j}"), F.col(f"high{j}")
            held = (x >= low) & (x <= high)
            asked += [
                F.count_if(x < low).alias(f"below{j}"), F.count_if(held).alias(f"in{j}"),
                F.kll_sketch_agg_double(F.when(held, x), F.lit(size)).alias(f"s{j}"),
            ]
        picked = []
        for j, p in enumerate(probs):
            place = F.lit(p) * (F.col("n") - 1)
            steps = [
                (end(place) - F.col(f"below{j}")) / F.greatest(F.col(f"in{j}") - 1, F.lit(1)) * GRID_STEPS
                for end in (F.floor, F.ceil)
            ]
            sketch = F.kll_sketch_get_quantile_double(f"s{j}", grid)
            at = [F.floor(steps[0]) - SPARE_STEPS, F.ceil(steps[1]) + SPARE_STEPS]
            at = [F.least(F.greatest(a, F.lit(0)), F.lit(GRID_STEPS)).cast("int") for a in at]
            fits = (F.col(f"in{j}") > 0) & (steps[0] >= 0) & (steps[1] <= GRID_STEPS)
            held = F.array(*[F.get(sketch, a) for a in at])
            picked += [F.when(fits, held).alias(f"b{j}"), F.col(f"in{j}")]
        for r in joined.groupBy("slot").agg(*asked).select("slot", *picked).collect():
            s = wide[r["slot"]]
            most = max(r[f"in{j}"] for j in range(len(probs)))
            s.brackets = [tuple(r[f"b{j}"] or s.brackets[j]) for j in range(len(probs))]
            # a bracket of few values repeated often doesn't shrink, and needs not
            shrinks = most < 0.7 * seen[id(s)]
            seen[id(s)] = most
            inside[id(s)] = most * 2 * (SPARE_STEPS + 1) / GRID_STEPS if shrinks else 0


def _counted(data, key_names, slots, probs) -> None:
    """The last scan: counts by value inside the brackets and by gap between them give the ranks."""
    columns = ", ".join(f"low{j} double, high{j} double" for j in range(len(probs)))
    joined = _in_slots(data, key_names, slots, columns, lambda s: [x for b in s.brackets for x in b])
    x, kept = F.col("x"), F.lit(False)
    gap = [F.lit(-math.inf), F.lit(-math.inf)]
    for j in range(len(probs)):
        kept = kept | ((x >= F.col(f"low{j}")) & (x <= F.col(f"high{j}")))
        gap.append(F.when(x > F.col(f"high{j}"), F.col(f"high{j}")))
    placed = joined.select(
        "slot", F.when(kept, x).otherwise(F.greatest(*gap)).alias("at"), (~kept).alias("gap")
    )
    counts = placed.groupBy("slot", "at", "gap").agg(F.count(F.lit(1)).alias("here"))
    order = Window.partitionBy("slot").orderBy("at", "gap").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("here").over(order)).where("not gap")
    sizes = F.broadcast(
        local_frame(data.sparkSession, [(i, s.n) for i, s in enumerate(slots)], "slot long, n long")
    )
    wanted = F.array_distinct(F.array(*[end(F.lit(p) * (F.col("n") - 1)) for p in probs for end in (F.floor, F.ceil)]))
    hits = running.join(sizes, "slot").withColumn("rank", F.explode(F.filter(
        wanted, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("here"))
    )))
    found = hits.groupBy("slot").agg(
        F.any_value("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at")
    )
    answers = []
    for p in probs:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = (F.try_element_at("at", end(place)) for end in (F.floor, F.ceil))
        answers.append(low + (high - low) * (place - F.floor(place)))
    for r in found.select("slot", F.array(*answers).alias("q")).collect():
        if None not in r["q"]:
            slots[r["slot"]].answer = r["q"]


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options
) -> dict[str, list[float | None]]:
    """Whole-table form: ``{column: [quantile, ...]}``."""
    found = quantiles_by_group(df, columns, probs, **options)
    return found.get((), {c: [None] * len(probs) for c in columns})


def medians_by_group(df: DataFrame, columns: Sequence[str], keys: Sequence[str], **options):
    found = quantiles_by_group(df, columns, [0.5], keys, **options)
    return {key: {c: q[0] for c, q in by_column.items()} for key, by_column in found.items()}


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), **options
) -> DataFrame:
    """Long form: the keys, ``column``, ``prob``, ``value``."""
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValidationError("Quantile probabilities lie between 0 and 1")
    found = quantiles_by_group(df, columns, probs, keys, **options)
    schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [
            T.StructField("column", T.StringType()),
            T.StructField("prob", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    rows = [
        (*key, c, float(p), q)
        for key, by_column in found.items()
        for c, values in by_column.items()
        for p, q in zip(probs, values)
    ]
    return local_frame(df.sparkSession, rows, schema)
