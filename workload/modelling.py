"""Models, metrics, clustering, neighbours, search, importance and scoring."""

import uuid

from granary.operators import features, hashed, models, neighbours, ward
from granary.plans import training
from granary.session import local_frame, shared_folder, spread
from granary.sources import runs
from pyspark.sql import functions as F
from workload.registry import LABELLED, query, rounded

LINE = """
    with f as (select regr_slope(p_retailprice, p_size) as b, regr_intercept(p_retailprice, p_size) as a
      from part)
    select p_partkey, round(a + b * p_size, 3) as predicted from part, f
"""


def _size_model(t, name):
    prep = features.fit_preparation(t.part, "p_retailprice", "regression", ["p_size"])
    model = models.fit(name, prep.labelled(t.part), "regression")
    return training.Scorer(prep, model, name)


@query("linear_regression", LINE)
def _(t):
    scored = training.predict(t.part, _size_model(t, "linear"))
    return rounded(scored.select("p_partkey", "predicted"), 3)


@query(
    "ridge_regression",
    """
    with s as (select avg(p_size) as mx, stddev_pop(p_size) as sx, avg(p_retailprice) as my,
      count(*) as n from part),
    z as (select p_partkey, (p_size - mx) / sx as z, p_retailprice - my as y, my, n from part, s),
    b as (select sum(z * y) / (any_value(n) + 1) as b from z)
    select p_partkey, round(my + b * z, 3) as predicted from z, b
    """,
)
def _(t):
    scored = training.predict(t.part, _size_model(t, "ridge"))
    return rounded(scored.select("p_partkey", "predicted"), 3)


@query("saved_run_predicts_the_same", LINE)
def _(t):
    path = f"{shared_folder(t.spark)}/run-{uuid.uuid4().hex}"
    runs.save_run(_size_model(t, "linear"), path)
    scored = training.predict(t.part.drop("p_retailprice"), runs.load_run(path))
    return rounded(scored.select("p_partkey", "predicted"), 3)


@query(
    "regression_metrics",
    """
    with p as (select o_totalprice as y, 250000.0 + 10 * extract(month from o_orderdate) as f from orders)
    select round(avg(abs(y - f)), 3) as mae, round(avg((y - f) ** 2) / 1e6, 3) as mse_millions,
      round(sqrt(avg((y - f) ** 2)), 3) as rmse, round(1 - avg((y - f) ** 2) / var_pop(y), 5) as r2
    from p
    """,
)
def _(t):
    predicted = t.orders.select(
        F.col("o_totalprice").alias("label"),
        (250000.0 + 10 * F.month("o_orderdate")).alias("prediction"),
    )
    m = models.regression_metrics(predicted)
    row = (m["mae"], m["mse"] / 1e6, m["rmse"], m["r2"])
    found = local_frame(t.spark, [row], "mae double, mse_millions double, rmse double, r2 double")
    return found.select(
        *[F.round(c, 3).alias(c) for c in ("mae", "mse_millions", "rmse")], F.round("r2", 5).alias("r2")
    )


RULE = "case when n_chars > 1500 then 1 else 0 end"


@query(
    "classification_metrics",
    f"""
    with p as (select quality as y, {RULE} as f from {LABELLED}),
    c as (select k, count_if(y = k and f = k)::double as hit, count_if(f = k)::double as guessed,
      count_if(y = k)::double as support from p, (values (0), (1)) v(k) group by k),
    s as (select k, case when guessed > 0 then hit / guessed else 0 end as p,
      case when support > 0 then hit / support else 0 end as r from c)
    select round((select count_if(y = f)::double / count(*) from p), 6) as accuracy,
      round(avg(p), 6) as precision, round(avg(r), 6) as recall,
      round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) as f1
    from s
    """,
)
def _(t):
    predicted = t.labelled().select(
        F.col("quality").cast("double").alias("label"), F.expr(RULE).cast("double").alias("prediction")
    )
    m = models.classification_metrics(predicted)
    row = (m["accuracy"], m["precision"], m["recall"], m["f1"])
    schema = "accuracy double, precision double, recall double, f1 double"
    return rounded(local_frame(t.spark, [row], schema), 6)


@query(
    "confusion_cells",
    f"select quality::double as label, ({RULE})::double as prediction, count(*) as count "
    f"from {LABELLED} group by 1, 2",
)
def _(t):
    return models.confusion(
        t.labelled().select(
            F.col("quality").cast("double").alias("label"),
            F.expr(RULE).cast("double").alias("prediction"),
        )
    )


@query(
    "nearest_neighbour_vote",
    """
    with e as (select vec_id, label::double as label, embedding::double[] as v from embeddings),
    d as (select a.vec_id, b.label, row_number() over (partition by a.vec_id
      order by list_distance(a.v, b.v), b.label) as place from e a, e b),
    n as (select vec_id, label, count(*) as votes from d where place <= 5 group by 1, 2)
    select vec_id, arg_max(label, votes * 1000 - label) as prediction from n group by 1
    """,
)
def _(t):
    train = t.embeddings.select(F.col("embedding").alias("features"), "label")
    asked = t.embeddings.select("vec_id", F.col("embedding").alias("features"))
    return neighbours.knn_predict(train, asked, 5).select("vec_id", "prediction")


@query(
    "nearest_neighbour_mean",
    """
    with e as (select p_partkey, p_retailprice as label, p_partkey::double as x, p_size * 10.0 as y
      from part),
    d as (select a.p_partkey, b.label, row_number() over (partition by a.p_partkey
      order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.label) as place from e a, e b)
    select p_partkey, round(avg(label), 4) as prediction from d where place <= 5 group by 1
    """,
)
def _(t):
    rows = t.part.selectExpr(
        "p_partkey", "p_retailprice as label",
        "array(cast(p_partkey as double), cast(p_size * 10 as double)) as features",
    )
    found = neighbours.knn_predict(rows, rows.drop("label"), 5, "regression")
    return rounded(found.select("p_partkey", "prediction"))


@query(
    "hashed_neighbours_recall",
    "select count(*) as asked, true as most_found, true as few_compared from customer where c_custkey % 20 = 0",
)
def _(t):
    key = F.col("c_custkey").cast("string").alias("key")
    rows = t.customer.select(
        key, F.expr("array(c_acctbal / 1000, c_nationkey / 2.0D)").alias("vec"),
        F.col("c_custkey").cast("double").alias("label"), F.lit(1).cast("long").alias("weight"), "c_custkey",
    )
    asked = rows.where("c_custkey % 20 = 0").select("key", "vec")
    points = rows.drop("c_custkey")
    tables = hashed.fit_tables(points, tables=1, bits=40, probes=16)
    sizes = hashed.met_buckets(points.withColumnRenamed("key", "tkey"), asked, tables)[2]
    found = neighbours.nearest_approximately(points, asked, 5, tables=1, bits=40, probes=16)
    exact = neighbours.nearest(points, asked, 5)
    shared = exact.join(found.select("key", "label"), ["key", "label"]).count() / exact.count()
    compared = hashed.compared_pairs(sizes)
    return asked.agg(F.count("*").alias("asked")).select(
        "asked", F.lit(shared >= 0.95).alias("most_found"), (F.lit(compared) < 0.1 * F.col("asked") * points.count()).alias("few_compared")
    )


@query(
    "density_clusters",
    """
    with p as (select c_custkey, c_acctbal / 1000 as x, c_nationkey / 2.0 as y from customer),
    n as (select a.c_custkey as a, b.c_custkey as b from p a, p b
      where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2),
    c as (select a from n group by 1 having count(*) >= 5),
    r as (select a, bool_or(b in (select a from c)) as reached from n group by 1)
    select c_custkey, c_custkey in (select a from c) as is_core, not reached as is_noise
    from p join r on r.a = p.c_custkey
    """,
)
def _(t):
    rows = t.customer.selectExpr("c_custkey", "array(c_acctbal / 1000, c_nationkey / 2.0D) as features")
    found = neighbours.dbscan(rows, "features", 0.2, 5, "c_custkey")
    return found.select("c_custkey", "is_core", (F.col("cluster") == -1).alias("is_noise"))


@query(
    "density_memberships",
    """
    with recursive p as (select c_custkey, c_acctbal / 1000 as x, c_nationkey / 2.0 as y from customer),
    n as (select a.c_custkey as a, b.c_custkey as b from p a, p b
      where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2),
    c as (select a from n group by 1 having count(*) >= 5),
    l as (select a, b from n where a in (select a from c) and b in (select a from c)),
    reach as (select a as node, a as low from c union select l.b, reach.low from reach join l on l.a = reach.node),
    core as (select node, min(low) as cluster from reach group by 1),
    border as (select n.a, min(core.cluster) as cluster from n join core on core.node = n.b group by 1)
    select c_custkey, coalesce(core.cluster, border.cluster, -1) as cluster
    from p left join core on core.node = c_custkey left join border on border.a = c_custkey
    """,
)
def _(t):
    rows = t.customer.selectExpr("c_custkey", "array(c_acctbal / 1000, c_nationkey / 2.0D) as features")
    return neighbours.dbscan(rows, "features", 0.2, 5, "c_custkey").select("c_custkey", "cluster")


def _blobs(t):
    return models.as_vectors(t.embeddings, "embedding").select("features")


@query(
    "kernel_machine_finds_a_band",
    "select count(*) as rows, true as kernel_finds_it, true as plane_does_not from customer",
)
def _(t):
    rows = t.customer.selectExpr("array(c_acctbal / 3000) as v", "cast(abs(c_acctbal - 4500) < 2000 as double) as label")
    df = spread(models.as_vectors(rows, "v").select("features", "label"), rows.count())

    def right(name, **params):
        scored = models.fit(name, df, "classification", params).transform(df)
        return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    kernel, plane = right("kernel_svc", gamma=2.0, C=100.0, features=64), right("linear_svc")
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(kernel > 0.97).alias("kernel_finds_it"), F.lit(plane < 0.8).alias("plane_does_not")
    )


@query("kmeans_sizes", "select count(*) as rows, 4::bigint as clusters from embeddings")
def _(t):
    df = _blobs(t)
    sizes = models.cluster_sizes(models.fit_kmeans(df, 4).transform(df))
    return sizes.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("clusters"))


@query("ward_clusters", "select c_custkey, c_nationkey // 5 as spot from customer")
def _(t):
    # five bands of customers that lie far from each other, named by their smallest nation
    rows = t.customer.selectExpr("c_custkey", "c_nationkey", "array(floor(c_nationkey / 5) * 9.0D, c_acctbal / 10000) as v")
    df = spread(models.as_vectors(rows, "v").select("c_custkey", "c_nationkey", "features"), rows.count())
    found = ward.fit_ward(df, 5).transform(df)
    low = found.groupBy("prediction").agg(F.min("c_nationkey").alias("low"))
    return found.join(low, "prediction").select("c_custkey", F.expr("cast(low div 5 as int)").alias("spot"))


@query("bisecting_sizes", "select count(*) as rows, 4::bigint as clusters from customer")
def _(t):
    ready, _ = features.prepare_features(
        t.customer, None, "clustering", ["c_acctbal", "c_nationkey"]
    )
    sizes = models.cluster_sizes(models.fit_bisecting(ready, 4).transform(ready))
    return sizes.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("clusters"))


@query("cluster_metrics")
def _(t):
    df = _blobs(t)
    rows = []
    for k in (2, 3):
        model = models.fit_kmeans(df, k)
        m = models.cluster_metrics(model.transform(df), model)
        rows.append((m["k"], m["silhouette"], m["inertia"], m["noise"]))
    return local_frame(t.spark, rows, "k int, silhouette double, inertia double, noise long")


@query("cluster_importance")
def _(t):
    ready, prep = features.prepare_features(t.customer, None, "clustering")
    return models.cluster_importance(models.fit_kmeans(ready, 3), ready, prep.feature_names)


@query("classification_leaderboard")
def _(t):
    run = training.train(
        t.labelled(), "quality", "classification", ["n_chars", "lang", "toxic"],
        models=["logistic", "decision_tree", "naive_bayes", "linear_svc", "knn"], balanced=True,
        cross_validate=False,
    )
    return run.leaderboard


@query("regression_leaderboard")
def _(t):
    run = training.train(
        t.part, "p_retailprice", models=["linear", "ridge", "decision_tree", "gbt"],
        cross_validate=False,
    )
    return run.leaderboard


@query("clustering_leaderboard")
def _(t):
    df = t.customer.select("c_acctbal", "c_nationkey")
    run = training.train(df, task="clustering", k_range=(2, 3), eps_values=(0.2,))
    return run.leaderboard


@query("feature_importance")
def _(t):
    run = training.train(
        t.part, "p_retailprice", models=["random_forest"], cross_validate=False
    )
    return run.importance


@query("cross_validated_score")
def _(t):
    ready, _ = features.prepare_features(t.part, "p_retailprice", "regression")
    found = models.cv_score("ridge", ready, "regression")
    return local_frame(t.spark, [found], "mean double, std double")


@query("random_search")
def _(t):
    ready, _ = features.prepare_features(t.part, "p_retailprice", "regression", ["p_size", "p_type"])
    return models.tune("decision_tree", ready, "regression").tried


@query("scored_classes")
def _(t):
    run = training.train(
        t.labelled(), "quality", "classification", ["n_chars", "lang"], models=["naive_bayes"],
        cross_validate=False,
    )
    return training.predict(t.documents.select("doc_id", "lang", "n_chars"), run)
