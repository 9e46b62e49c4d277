"""A store of model runs: fitted pipelines saved by MLlib, and a table of their versions, status and metrics."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models, store
from .store import Store

C = F.col
RUNS = "version long, id string, model string, label string, run int, status string, n_rows long, metrics array<struct<name: string, value: double>>, path string"
#: The metric by which a challenger replaces the champion; without one a model stays in staging.
GATES = {"churn": "auc", "ltv": "r2", "segmentation": None}


def _fit(model: str, rows: DataFrame) -> PipelineModel:
    if model == "churn":
        return Pipeline(stages=[*models.prepared(), models.classifiers()["logistic"]]).fit(models.weighted(models.typed(rows)))
    if model == "ltv":
        return Pipeline(stages=[*models.prepared(tuple(c for c in models.NUMBERS if c != "total_charges")), LinearRegression(labelCol="total_charges")]).fit(models.typed(rows))
    return models.segmenter(rows)


def _judge(model: str, fitted: PipelineModel, rows: DataFrame) -> dict[str, float]:
    scored = fitted.transform(models.typed(rows))
    if model == "churn":
        return models.judged(scored, "churn")
    if model == "ltv":
        return {m: RegressionEvaluator(labelCol="total_charges", metricName=m).evaluate(scored) for m in ("r2", "rmse", "mae")}
    return {"silhouette": ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(scored)}


def table(s: Store) -> DataFrame:
    """(model, version, run, status, n_rows, metrics, path) of all runs, as they stand."""
    rows = store.state(s, "runs", "id")
    return rows.select("model", C("label").alias("version"), "run", "status", "n_rows", F.map_from_entries("metrics").alias("metrics"), "path")


def retrain(s: Store, model: str, rows: DataFrame, judge: DataFrame, batch: str) -> None:
    """Fit a challenger, save it, and add its run; a batch that is there already is not fitted again.

    The champion is loaded and judged on the same rows. If the challenger's metric is higher it goes into production and the
    champion to the archive, in one commit; else it stays in staging. The first run of a model has no champion."""
    if s.has(batch):
        return
    fitted = _fit(model, rows)
    fitted.write().overwrite().save(path := s.folder(batch, "pipelines"))
    metrics, gate = _judge(model, fitted, judge), GATES[model]
    mine = store.state(s, "runs", "id").filter(C("model") == model)
    champion = mine.filter("status = 'production'").first()
    run = (mine.agg(F.max("run")).first()[0] or 0) + 1
    wins = gate is not None and models.promoted(champion and _judge(model, PipelineModel.load(champion.path), judge), metrics, gate)
    row = (f"{model}/v{run}", model, f"v{run}", run, "production" if wins else "staging", rows.count(), sorted(metrics.items()), path)
    changed = s.spark.createDataFrame([row], RUNS.partition(", ")[2])
    if wins and champion:
        changed = changed.unionByName(mine.filter("status = 'production'").withColumn("status", F.lit("archived")).select(*changed.columns))
    store.upsert(s, "runs", changed, "id", batch, buckets=1)


def production(s: Store, model: str) -> PipelineModel | None:
    """The pipeline that is in production."""
    row = table(s).filter((C("model") == model) & (C("status") == "production")).first()
    return row and PipelineModel.load(row.path)


def fitted_once(spark: SparkSession, name: str, old: DataFrame, new: DataFrame) -> Store:
    """The store of runs of that name in the shared folder, with a champion fitted on ``old`` and a challenger on ``new``.

    All are judged on the held-out rows of ``new``. What has been fitted before, by any query, is not fitted again."""
    s = Store(spark, f"{store.shared_dir(spark).rstrip('/')}/keelson/runs-{hashlib.md5(name.encode()).hexdigest()}")
    try:
        done = s.current().version
    except AnalysisException:
        done, s = 0, Store.create(spark, s.uri, {"runs": RUNS})
    if done < 2 * len(GATES):
        *fits, judge = (models.spread(models.inputs(d, "churn")) for d in (models.split(old)[0], *models.split(new)))
        for model in GATES:
            for n, rows in enumerate(fits):
                retrain(s, model, rows, judge, f"{model}-{n}")
        for rows in (*fits, judge):
            rows.unpersist()
    return s
