"""Saving a fitted model with its preparation, and loading it again."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from granary.operators.features import Preparation
from granary.operators.models import Neighbours, Shifted
from granary.plans.training import Run, Scorer, scorer
from granary.session import local_frame


def save_run(run: Run | Scorer, path: str, name: str | None = None) -> None:
    """Write model, preparation pipeline, label indexer and decisions below ``path``."""
    made = scorer(run, name) if isinstance(run, Run) else run
    prep = made.preparation
    spark = SparkSession.getActiveSession()
    prep.pipeline.write().overwrite().save(f"{path}/preparation")
    if prep.label_indexer is not None:
        prep.label_indexer.write().overwrite().save(f"{path}/labels")
    facts = {"name": made.name, "preparation": prep.facts()}
    if isinstance(made.model, Neighbours):
        made.model.train.write.mode("overwrite").parquet(f"{path}/train")
        facts["neighbours"] = {"k": made.model.k, "task": made.model.task}
    elif isinstance(made.model, Shifted):
        made.model.inner.write().overwrite().save(f"{path}/model")
        facts["shift"] = made.model.shift
    else:
        made.model.write().overwrite().save(f"{path}/model")
    row = local_frame(spark, [(json.dumps(facts),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_run(path: str) -> Scorer:
    """A saved run, ready for ``predict``."""
    spark = SparkSession.getActiveSession()
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    prep = Preparation.from_facts(facts["preparation"])
    prep.pipeline = PipelineModel.load(f"{path}/preparation")
    if prep.task == "classification":
        prep.label_indexer = StringIndexerModel.load(f"{path}/labels")
    if "neighbours" in facts:
        train = spark.read.parquet(f"{path}/train")
        model = Neighbours(train, facts["neighbours"]["task"], facts["neighbours"]["k"])
    else:
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        if "shift" in facts:
            model = Shifted(model, facts["shift"])
    return Scorer(prep, model, facts["name"])
