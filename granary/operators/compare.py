"""Group comparison: is the difference between segments real?"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.errors import ValidationError
from granary.functions.kinds import NUMERIC, col, kinds, require_numeric, resolve
from granary.functions.tails import chi2_sf, f_sf, normal_sf, t_two_sided
from granary.operators.counts import distinct_capped, per_column
from granary.operators.quantiles import medians_by_group, quantiles
from granary.operators.reshape import crosstab_cells
from granary.session import local_frame, take_bounded

ALPHA = 0.05
MAX_SEGMENTS = 30
RANK_ROWS_PER_BUCKET = 2_000_000
MAX_RANK_BUCKETS = 20_000
MAX_TABLE_CELLS = 100_000
DISCRETE_LIMIT = 20
MI_BINS = 10
LEAKAGE_CORR = 0.98
MIN_PAIRS = 10


@dataclass(frozen=True)
class Comparison:
    """``segments`` is one row per group; ``test`` is one row with the outcome."""

    kind: str
    segments: DataFrame
    test: DataFrame
    facts: dict = field(default_factory=dict)


def _segments(df: DataFrame, dimension: str, message_name: str) -> list:
    rows = take_bounded(
        df, MAX_SEGMENTS,
        f"'{message_name}' makes more than {MAX_SEGMENTS} groups to compare",
    )
    if len(rows) < 2:
        raise ValidationError(f"'{message_name}' makes one group or none; a comparison takes two")
    return rows


def compare_segments(df: DataFrame, dimension: str, metric: str | None = None) -> Comparison:
    """Numeric metric: Welch t or ANOVA with a rank check. Otherwise a chi-square test."""
    dimension = resolve(df, dimension, "compare_segments")
    if metric is None:
        return _compare_shares(df, dimension)
    metric = resolve(df, metric, "compare_segments")
    if kinds(df)[metric] == NUMERIC:
        return _compare_means(df, dimension, metric)
    return _compare_tables(df, dimension, metric)


# -- numeric metric --------------------------------------------------------


def segment_moments(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Count, mean, variance, minimum and maximum per group, in one aggregation."""
    x = col(metric).cast("double")
    return (
        df.where(col(dimension).isNotNull())
        .groupBy(col(dimension).alias("group"))
        .agg(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        )
    )


def _squares(rows: Sequence) -> tuple[float, float]:
    n = sum(r["count"] for r in rows)
    grand = sum(r["count"] * r["mean"] for r in rows) / n
    between = sum(r["count"] * (r["mean"] - grand) ** 2 for r in rows)
    within = sum((r["count"] - 1) * r["variance"] for r in rows)
    return between, within


def one_way_anova(rows: Sequence) -> dict:
    """F, p and eta squared from group counts, means and variances."""
    between, within = _squares(rows)
    n, k = sum(r["count"] for r in rows), len(rows)
    total = between + within
    if within > 0:
        statistic = (between / (k - 1)) / (within / (n - k))
    else:
        statistic = math.inf if between > 0 else math.nan
    return {
        "statistic": statistic,
        "p_value": f_sf(statistic, k - 1, n - k),
        "eta_squared": between / total if total else 0.0,
    }


def welch_t(a, b) -> dict:
    """Welch's t, its p and Cohen's d of two groups."""
    va, vb = a["variance"] / a["count"], b["variance"] / b["count"]
    gap = a["mean"] - b["mean"]
    if va + vb > 0:
        t = gap / math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va**2 / (a["count"] - 1) + vb**2 / (b["count"] - 1))
        p_value = t_two_sided(t, dof)
    else:
        t = math.copysign(math.inf, gap) if gap else math.nan
        p_value = 0.0 if gap else math.nan
    free = a["count"] + b["count"] - 2
    pooled = math.sqrt(
        ((a["count"] - 1) * a["variance"] + (b["count"] - 1) * b["variance"]) / free
    )
    return {"statistic": t, "p_value": p_value, "cohens_d": gap / pooled if pooled else 0.0}


def rank_sums(df: DataFrame, dimension: str, metric: str, keep: Sequence | None = None) -> DataFrame:
    """Per group: count, sum of mid-ranks over all rows, and its share of the tie term.

    Rows are first counted per value, so ties however large become one row. The values are
    then cut into buckets at sketched quantiles; a bucket's ranks are its own running count
    plus the rows in the buckets before it.
    """
    x = col(metric).cast("double")
    data = df.select(col(dimension).alias("group"), x.alias("value")).where(
        "group is not null and value is not null"
    )
    if keep is not None:
        data = data.where(F.col("group").isin(*keep))
    bucketed = _rank_buckets(data)
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).collect()
    offsets, seen = [], 0
    for r in sorted(sizes, key=lambda r: r["bucket"]):
        offsets.append((r["bucket"], seen))
        seen += r["rows"]
    before = local_frame(df.sparkSession, offsets, "bucket double, before long")
    counted = bucketed.groupBy("bucket", "value", "group").agg(F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy("bucket").orderBy("value")
    up_to = by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = by_value.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = (
        counted.withColumns(
            {"up_to": F.sum("n").over(up_to), "ties": F.sum("n").over(peers).cast("double")}
        )
        .join(F.broadcast(before), "bucket")
        .withColumn("rank", F.col("before") + F.col("up_to") - (F.col("ties") - 1) / 2)
    )
    return ranked.groupBy("group").agg(
        F.sum("n").alias("count"),
        F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1)).alias("tie_term"),
    )


def _rank_buckets(data: DataFrame) -> DataFrame:
    rows = data.count()
    buckets = max(1, min(MAX_RANK_BUCKETS, rows // RANK_ROWS_PER_BUCKET))
    if buckets == 1:
        return data.withColumn("bucket", F.lit(0.0))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.percentile_approx("value", cuts, max(10_000, 5 * buckets))
    splits = sorted(set(data.agg(sketch).first()[0]))
    cutter = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol="value", outputCol="bucket"
    )
    return cutter.transform(data)


def mann_whitney(rows: Sequence) -> dict:
    """Two-sided Mann-Whitney U by the tie-corrected normal approximation."""
    a, b = rows
    n1, n2 = a["count"], b["count"]
    n = n1 + n2
    u1 = a["rank_sum"] - n1 * (n1 + 1) / 2
    tie_term = sum(r["tie_term"] for r in rows)
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    u = max(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2 - 0.5) / spread if spread else 0.0
    return {"statistic": u1, "p_value": min(1.0, 2 * normal_sf(z))}


def kruskal_wallis(rows: Sequence) -> dict:
    """Kruskal-Wallis H, tie-corrected."""
    n = sum(r["count"] for r in rows)
    raw = 12 / (n * (n + 1)) * sum(r["rank_sum"] ** 2 / r["count"] for r in rows) - 3 * (n + 1)
    correction = 1 - sum(r["tie_term"] for r in rows) / (float(n) ** 3 - n)
    statistic = raw / correction if correction > 0 else math.nan
    return {"statistic": statistic, "p_value": chi2_sf(statistic, len(rows) - 1)}


TEST_SCHEMA = (
    "name string, statistic double, p_value double, significant boolean, effect string, "
    "effect_size double, rank_name string, rank_statistic double, rank_p_value double, "
    "agrees boolean, best string, worst string, gap double"
)


def _compare_means(df: DataFrame, dimension: str, metric: str) -> Comparison:
    rows = _segments(segment_moments(df, dimension, metric), dimension, dimension)
    used = sorted((r for r in rows if r["count"] >= 2), key=lambda r: r["group"])
    if len(used) < 2:
        raise ValidationError("Two groups of two rows or more are needed")
    groups = [r["group"] for r in used]
    within = df.where(col(dimension).isin(*groups))
    medians = medians_by_group(within, [metric], [dimension])
    ordered = sorted(used, key=lambda r: -r["mean"])
    segments = local_frame(
        df.sparkSession,
        [
            (
                str(r["group"]), r["count"], r["mean"], medians[(r["group"],)][metric],
                math.sqrt(r["variance"]), r["min"], r["max"],
            )
            for r in ordered
        ],
        "group string, count long, mean double, median double, std double, min double, max double",
    )
    ranks = sorted(rank_sums(within, dimension, metric).collect(), key=lambda r: r["group"])
    if len(used) == 2:
        name, rank_name, effect = "Welch t-test", "Mann-Whitney U", "cohens_d"
        outcome, check = welch_t(*used), mann_whitney(ranks)
    else:
        name, rank_name, effect = "One-way ANOVA", "Kruskal-Wallis", "eta_squared"
        outcome, check = one_way_anova(used), kruskal_wallis(ranks)
    p, rank_p = outcome["p_value"], check["p_value"]
    best, worst = ordered[0], ordered[-1]
    facts = {
        "name": name, "statistic": outcome["statistic"], "p_value": p, "significant": p <= ALPHA,
        "effect": effect, "effect_size": round(outcome[effect], 4), "rank_name": rank_name,
        "rank_statistic": check["statistic"], "rank_p_value": rank_p,
        "agrees": (p <= ALPHA) == (rank_p <= ALPHA),
        "best": str(best["group"]), "worst": str(worst["group"]),
        "gap": best["mean"] - worst["mean"],
    }
    test = local_frame(df.sparkSession, [tuple(facts.values())], TEST_SCHEMA)
    return Comparison("numeric", segments, test, facts)


# -- counts ----------------------------------------------------------------


def _compare_shares(df: DataFrame, dimension: str) -> Comparison:
    """Chi-square goodness of fit against equal shares."""
    counted = df.where(col(dimension).isNotNull()).groupBy(col(dimension).alias("group")).count()
    rows = _segments(counted, dimension, dimension)
    rows = sorted(rows, key=lambda r: (-r["count"], str(r["group"])))
    n, k = sum(r["count"] for r in rows), len(rows)
    expected = n / k
    statistic = sum((r["count"] - expected) ** 2 / expected for r in rows)
    p_value = chi2_sf(statistic, k - 1)
    facts = {
        "name": "Chi-square goodness of fit", "statistic": statistic, "p_value": p_value,
        "significant": p_value <= ALPHA, "expected_per_group": round(expected, 2),
    }
    segments = local_frame(
        df.sparkSession,
        [(str(r["group"]), r["count"], round(100 * r["count"] / n, 2)) for r in rows],
        "group string, count long, share_pct double",
    )
    schema = (
        "name string, statistic double, p_value double, significant boolean, "
        "expected_per_group double"
    )
    test = local_frame(df.sparkSession, [tuple(facts.values())], schema)
    return Comparison("distribution", segments, test, facts)


def _compare_tables(df: DataFrame, dimension: str, metric: str) -> Comparison:
    """Chi-square independence with Yates' correction for 2 x 2, and Cramér's V."""
    both = df.where(col(dimension).isNotNull())
    counted = both.groupBy(col(dimension).alias("group")).count()
    _segments(counted, dimension, dimension)
    cells = crosstab_cells(both, dimension, metric, MAX_TABLE_CELLS)
    rows = cells.collect()
    down, across = {}, {}
    for a, b, c in rows:
        down[a] = down.get(a, 0) + c
        across[b] = across.get(b, 0) + c
    if len(down) < 2 or len(across) < 2:
        raise ValidationError(f"'{dimension}' and '{metric}' have rows in common for one value only")
    n = sum(down.values())
    observed = {(a, b): c for a, b, c in rows}
    dof = (len(down) - 1) * (len(across) - 1)
    statistic = 0.0
    for a, ra in down.items():
        for b, cb in across.items():
            expected = ra * cb / n
            off = abs(observed.get((a, b), 0) - expected)
            if dof == 1:
                off -= min(0.5, off)
            statistic += off * off / expected
    smaller = min(len(down), len(across)) - 1
    p_value = chi2_sf(statistic, dof)
    facts = {
        "name": "Chi-square test of independence", "statistic": statistic, "p_value": p_value,
        "dof": dof, "significant": p_value <= ALPHA,
        "cramers_v": round(math.sqrt(statistic / n / smaller), 4),
    }
    schema = (
        "name string, statistic double, p_value double, dof int, significant boolean, "
        "cramers_v double"
    )
    segments = cells.select(
        F.col(cells.columns[0]).cast("string").alias("group"),
        F.col(cells.columns[1]).cast("string").alias("level"),
        F.col("value").alias("count"),
    )
    test = local_frame(df.sparkSession, [tuple(facts.values())], schema)
    return Comparison("categorical", segments, test, facts)


# -- shape and association -------------------------------------------------


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness per column with the count it rests on."""
    names = [resolve(df, c, "skewness") for c in columns]
    for c in names:
        require_numeric(df, c, "skewness")
    measures = {
        "count": lambda c: F.count(col(c)),
        "skewness": lambda c: F.skewness(col(c).cast("double")),
    }
    found = per_column(df, names, measures)
    return found.select(
        "column", "count", F.when(~F.isnan("skewness"), F.col("skewness")).alias("skewness")
    )


def leaky_columns(df: DataFrame, columns: Sequence[str], target: str) -> list[str]:
    """Numeric columns that almost equal a numeric target, found in one aggregation."""
    names = [c for c in columns if kinds(df)[c] == NUMERIC and c != target]
    if kinds(df)[target] != NUMERIC or not names:
        return []
    y = col(target).cast("double")
    measures = {
        "pairs": lambda c: F.count_if(col(c).isNotNull() & col(target).isNotNull()),
        "corr": lambda c: F.corr(col(c).cast("double"), y),
    }
    return [
        r["column"]
        for r in per_column(df, names, measures).collect()
        if r["pairs"] >= MIN_PAIRS
        and r["corr"] is not None
        and not math.isnan(r["corr"])
        and abs(r["corr"]) >= LEAKAGE_CORR
    ]


def is_leaky(df: DataFrame, column: str, target: str) -> bool:
    return bool(leaky_columns(df, [resolve(df, column, "is_leaky")], resolve(df, target, "target")))


def _numeric_traits(df: DataFrame, columns: Sequence[str]) -> tuple[set[str], list[str]]:
    """Whole-number columns with few values (codes, not measurements), and columns with gaps."""
    if not columns:
        return set(), []
    traits = per_column(
        df, columns,
        {
            "part": lambda c: F.max(F.abs(col(c).cast("double") % 1.0)),
            "missing": lambda c: F.count_if(col(c).isNull()),
        },
    ).collect()
    few = distinct_capped(df, [r["column"] for r in traits if not r["part"]], DISCRETE_LIMIT)
    discrete = {c for c, n in few.items() if n <= DISCRETE_LIMIT}
    return discrete, [r["column"] for r in traits if r["missing"]]


def _coded(df: DataFrame, columns: Sequence[str]):
    """Every column as a text code. Measurements are cut at sketched quantiles."""
    numeric = [c for c in columns if kinds(df)[c] == NUMERIC]
    discrete, gappy = _numeric_traits(df, numeric)
    binned = [c for c in numeric if c not in discrete]
    fills = {c: q[0] for c, q in quantiles(df, gappy, [0.5]).items()} if gappy else {}

    def value(c):
        x = col(c).cast("double")
        return F.coalesce(x, F.lit(fills[c])) if fills.get(c) is not None else x

    codes = {}
    if binned:
        cuts = F.array(*[F.lit(i / MI_BINS) for i in range(1, MI_BINS)])
        found = df.agg(
            *[F.percentile_approx(value(c), cuts, 10_000).alias(f"q{i}") for i, c in enumerate(binned)]
        ).first()
        for i, c in enumerate(binned):
            edges = sorted(set(found[i] or []))
            code = sum((F.when(value(c) > e, 1).otherwise(0) for e in edges), F.lit(0))
            codes[c] = code.cast("string")
    for c in columns:
        if c in discrete:
            codes[c] = value(c).cast("string")
        elif c not in codes:
            codes[c] = F.coalesce(col(c).cast("string"), F.lit("missing"))
    return codes, set(binned)


def mutual_information(
    df: DataFrame, columns: Sequence[str], target: str, task: str
) -> DataFrame:
    """Mutual information of each column with the target, in nats.

    Plug-in estimate on counts per (code, target code), all columns in one shuffle. Binned
    measurements get the usual bias correction for the number of cells.
    """
    names = [resolve(df, c, "mutual_information") for c in columns]
    target = resolve(df, target, "target")
    if not names:
        return local_frame(df.sparkSession, [], "column string, mutual_information double")
    data = df.where(col(target).isNotNull())
    if task == "classification":
        y, y_binned = col(target).cast("string"), False
    else:
        require_numeric(df, target, "a regression target")
        coded_target, rough = _coded(data, [target])
        y, y_binned = coded_target[target], bool(rough)
    codes, binned = _coded(data, names)
    slots = {f"x{i}": c for i, c in enumerate(names)}
    wide = data.select(y.alias("y"), *[codes[c].alias(s) for s, c in slots.items()])
    labels = F.create_map(*[F.lit(v) for pair in slots.items() for v in pair])
    if len(slots) == 1:
        long = wide.select("y", F.lit("x0").alias("slot"), F.col("x0").alias("x"))
    else:
        long = wide.unpivot(["y"], list(slots), "slot", "x")
    joint = long.groupBy("slot", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for keys in (["x", "y"], ["x"], ["y"]):
        marginal = joint.groupBy("slot", *keys).agg(F.sum("n").cast("double").alias("n"))
        tag = "".join(keys)
        parts.append(
            marginal.groupBy("slot").agg(
                F.sum(F.col("n") * F.ln("n")).alias(f"s_{tag}"),
                F.count(F.lit(1)).alias(f"k_{tag}"),
                F.sum("n").alias(f"n_{tag}"),
            )
        )
    table = parts[0].join(parts[1], "slot").join(parts[2], "slot")
    n = F.col("n_xy")
    plain = (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / n + F.ln(n)
    rough = [s for s, c in slots.items() if y_binned or c in binned]
    bias = (F.col("k_x") - 1) * (F.col("k_y") - 1) / (2 * n)
    corrected = F.when(F.col("slot").isin(*rough), plain - bias).otherwise(plain) if rough else plain
    return table.select(
        labels[F.col("slot")].alias("column"),
        F.greatest(corrected, F.lit(0.0)).alias("mutual_information"),
    )
