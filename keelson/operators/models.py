"""Churn, value and segment models by MLlib, and their comparison."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles
from .store import stored

C = F.col
SEED = 42
#: Rows of a partition that models are fitted on.
PART_ROWS = 30_000
NUMBERS = ("tenure_months", "monthly_charges", "total_charges")
KINDS = ("contract_type", "internet_service", "payment_method", "tech_support", "online_security")
SEGMENTS = ("High-Value Subscribers", "Loyal Subscribers", "Growth Subscribers", "Budget Subscribers")


def split(df: DataFrame, key: str = "customer_id", part: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows to fit and rows to judge, by a hash of the key: alike in every run and for any partitioning."""
    held = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(10_000)) < int(part * 10_000)
    return df.filter(~held), df.filter(held)


def spread(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` cached, dealt evenly over partitions of some ``part_rows`` rows; a table of fewer rows stays as it lies.

    A file can be one task's to read, while trees go over their rows a hundred times. No key deals the rows, as one value could
    have them all; the order within partitions is fixed, since trees draw their rows by it."""
    parts = math.ceil(df.count() / part_rows)
    return (df.repartition(parts).sortWithinPartitions(F.xxhash64(*df.columns)) if parts > 1 else df).cache()


def inputs(df: DataFrame, *more: str) -> DataFrame:
    """The columns that models are fitted on, and ``more``."""
    return df.select(*dict.fromkeys((*more, *NUMBERS, *KINDS)))


def prepared(numbers=NUMBERS, kinds=KINDS) -> list:
    """Stages: medians for missing numbers, standardised; one column for each value of a kind, unknown values in one of their own."""
    return [
        Imputer(inputCols=list(numbers), outputCols=[f"{c}_full" for c in numbers], strategy="median"), VectorAssembler(inputCols=[f"{c}_full" for c in numbers], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True), StringIndexer(inputCols=list(kinds), outputCols=[f"{c}_i" for c in kinds], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in kinds], outputCols=[f"{c}_v" for c in kinds], dropLast=False), VectorAssembler(inputCols=["scaled", *(f"{c}_v" for c in kinds)], outputCol="features"),
    ]


def typed(df: DataFrame) -> DataFrame:
    """Numbers as doubles and missing kinds as a value, as the stages want them."""
    return df.withColumns({c: C(c).cast("double") for c in NUMBERS if c in df.columns}).fillna("missing", [c for c in KINDS if c in df.columns])


def weighted(df: DataFrame, label: str = "churn") -> DataFrame:
    """Adds ``weight``: both labels weigh the same in all."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    return df.join(F.broadcast(counts), label).withColumn("weight", df.agg(F.count("*") / 2.0).scalar() / C("__n")).drop("__n")


def classifiers(label: str = "churn") -> dict:
    kw = {"labelCol": label, "weightCol": "weight"}
    return {"logistic": LogisticRegression(**kw, maxIter=20, regParam=0.01), "forest": RandomForestClassifier(**kw, numTrees=50, maxDepth=6, seed=SEED), "boosted": GBTClassifier(**kw, maxIter=20, maxDepth=4, seed=SEED)}


def judged(scored: DataFrame, label: str) -> dict[str, float]:
    scored = scored.select("rawPrediction", "prediction", label).cache()  # the evaluators go over it several times
    of = lambda m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(scored)
    out = {"auc": BinaryClassificationEvaluator(labelCol=label).evaluate(scored), "accuracy": of("accuracy"), "f1": of("f1")}
    scored.unpersist()
    return out


def compare(df: DataFrame, label: str = "churn", part_rows: int = PART_ROWS) -> tuple[dict, list[tuple]]:
    """Fitted pipelines by name, and (name, auc, accuracy, f1) on held-out rows, best first.

    The stages are fitted once, and what they make of the rows is kept for all classifiers."""
    rows = spread(inputs(df, "customer_id", label), part_rows)
    fit, judge = (typed(d) for d in split(rows))
    fit = weighted(fit, label)
    stages = Pipeline(stages=prepared()).fit(fit)
    fit, judge = stages.transform(fit).select("features", label, "weight").cache(), stages.transform(judge).select("features", label).cache()
    models = {name: model.fit(fit) for name, model in classifiers(label).items()}
    scores = [(name, *judged(model.transform(judge), label).values()) for name, model in models.items()]
    for d in (fit, judge, rows):
        d.unpersist()
    return {name: PipelineModel(stages=[*stages.stages, model]) for name, model in models.items()}, sorted(scores, key=lambda s: -s[1])


def cross_validated(df: DataFrame, folds: int = 5, label: str = "churn") -> list[tuple]:
    """(name, mean auc, its standard deviation) of each classifier over the folds, by a fit each; ``folds`` has the logistic one
    of all folds at once."""
    raw = spread(inputs(df, label))
    rows = weighted(typed(raw), label)
    rows = Pipeline(stages=prepared()).fit(rows).transform(rows).select("features", label, "weight").cache()
    out = []
    for name, model in classifiers(label).items():
        cv = CrossValidator(estimator=model, estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, parallelism=4, seed=SEED).fit(rows)
        out.append((name, cv.avgMetrics[0], cv.stdMetrics[0]))
    rows.unpersist()
    raw.unpersist()
    return out


def value_models(df: DataFrame, label: str = "total_charges", part_rows: int = PART_ROWS) -> list[tuple]:
    """(name, r2, rmse, mae) of regressors for the value on held-out rows, best first; the label is no feature.

    The stages are fitted once, and what they make of the rows is kept for all regressors."""
    rows = spread(inputs(df, "customer_id", label), part_rows)
    fit, judge = (typed(d) for d in split(rows))
    stages = Pipeline(stages=prepared(tuple(c for c in NUMBERS if c != label))).fit(fit)
    fit, judge = (stages.transform(d).select("features", label).cache() for d in (fit, judge))
    models = {"linear": LinearRegression(labelCol=label), "forest": RandomForestRegressor(labelCol=label, numTrees=50, maxDepth=6, seed=SEED), "boosted": GBTRegressor(labelCol=label, maxIter=20, seed=SEED)}
    out = []
    for name, model in models.items():
        scored = model.fit(fit).transform(judge).select("prediction", label).cache()
        out.append((name, *(RegressionEvaluator(labelCol=label, metricName=m).evaluate(scored) for m in ("r2", "rmse", "mae"))))
        scored.unpersist()
    for d in (fit, judge, rows):
        d.unpersist()
    return sorted(out, key=lambda s: -s[1])


def segment_ranks(clustered: DataFrame, cluster: str = "cluster", spend: str = "total_charges") -> DataFrame:
    """(cluster, segment): clusters by falling median spend take the segment names, later ones a class of the last."""
    medians = quantiles(clustered, [cluster], spend, {"median": 0.5})
    i = F.row_number().over(Window.orderBy(F.desc("median"), cluster))
    name = F.coalesce(F.get(F.array(*map(F.lit, SEGMENTS)), i - 1), F.concat(F.lit("Budget Subscribers Class "), (i - 3).cast("string")))
    return medians.select(cluster, name.alias("segment"))


def segments(df: DataFrame, low: int = 2, high: int = 6) -> tuple[object, list[tuple], DataFrame]:
    """The fitted pipeline, (k, silhouette) of every k, and the rows with cluster and segment. Fewer than 3 becomes 4."""
    rows = typed(df)
    scale = Pipeline(stages=[VectorAssembler(inputCols=list(NUMBERS), outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]).fit(rows)
    points = stored(scale.transform(rows), "points")
    judge = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster")
    fits = {k: KMeans(k=k, seed=SEED, featuresCol="scaled", predictionCol="cluster").fit(points) for k in range(low, high + 1)}
    scores = [(k, judge.evaluate(m.transform(points))) for k, m in fits.items()]
    best = max(scores, key=lambda s: s[1])[0]
    model = fits[4 if best < 3 else best]
    out = model.transform(points).drop("numbers", "scaled")
    return model, scores, out.join(F.broadcast(segment_ranks(out)), "cluster")


#: Parts of the rows to fit that a learning curve is drawn over.
FRACTIONS = (0.1, 0.325, 0.55, 0.775, 1.0)


def classified(df: DataFrame, label: str = "churn") -> DataFrame:
    """(customer_id, label, probability, prediction) of held-out rows by the logistic model."""
    fit, judge = split(df)
    fit = spread(inputs(fit, label))
    model = Pipeline(stages=[*prepared(), classifiers(label)["logistic"]]).fit(weighted(typed(fit), label))
    fit.unpersist()
    return model.transform(typed(judge)).select("customer_id", label, vector_to_array("probability")[1].alias("probability"), C("prediction").cast("int").alias("prediction"))


def feature_arrays(df: DataFrame) -> DataFrame:
    """(customer_id, features): what the stages make of each row."""
    rows = typed(df)
    return Pipeline(stages=prepared()).fit(rows).transform(rows).select("customer_id", vector_to_array("features").alias("features"))


def learning_curve(df: DataFrame, label: str = "churn", fractions=FRACTIONS) -> list[tuple]:
    """(fraction, rows, F1 on them, F1 on held-out rows) of the logistic model; F1 is null if a class is missing.

    A fraction is chosen by a hash of the id, so the smaller ones are parts of the larger ones."""
    rows = spread(inputs(df, "customer_id", label))
    fit, judge = (typed(d) for d in split(rows))
    stages = Pipeline(stages=prepared()).fit(fit)
    fit, judge = (stages.transform(d).select("customer_id", "features", label).cache() for d in (fit, judge))
    out = []
    for part in fractions:
        some = fit.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "customer_id"), F.lit(10_000)) < round(part * 10_000))
        n, classes = some.agg(F.count("*"), F.count_distinct(label)).first()
        scores = (None, None)
        if classes == 2:
            model = classifiers(label)["logistic"].fit(weighted(some, label))
            scores = tuple(MulticlassClassificationEvaluator(labelCol=label, metricName="f1").evaluate(model.transform(d)) for d in (some, judge))
        out.append((part, n, *scores))
    for d in (fit, judge, rows):
        d.unpersist()
    return out


def promoted(champion: dict | None, challenger: dict, metric: str) -> bool:
    """A challenger replaces a champion only if its metric is higher."""
    return champion is None or challenger[metric] > champion[metric]


def version_counts(runs: DataFrame) -> DataFrame:
    """(model, production, versions, flagged): a model without a production version is flagged."""
    production = F.max(F.when(C("status") == "production", C("version")))
    return runs.groupBy("model").agg(production.alias("production"), F.count("*").alias("versions")).withColumn("flagged", C("production").isNull())


def versions_compared(runs: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """(metric, a, b, delta) over the metrics of either version; delta is null if one lacks the metric."""
    side = lambda v, n: runs.filter((C("model") == model) & (C("version") == v)).select(F.explode("metrics").alias("metric", n))
    return side(a, "a").join(side(b, "b"), "metric", "full").withColumn("delta", F.round(C("b") - C("a"), 6))


def picked_runs(runs: DataFrame, metric: dict[str, str]) -> DataFrame:
    """(model, production, newest, rollback, best): rollback is the newest version that isn't in production, best has the highest metric."""
    newest = lambda cond: F.max_by("version", F.when(cond, C("run")))
    names = F.create_map(*(F.lit(x) for pair in metric.items() for x in pair))
    rows = runs.withColumn("score", F.try_element_at("metrics", F.try_element_at(names, "model")))
    return rows.groupBy("model").agg(
        newest(C("status") == "production").alias("production"), newest(F.lit(True)).alias("newest"), newest(C("status") != "production").alias("rollback"), F.max_by("version", F.struct("score", "run")).alias("best")
    )


def segmenter(df: DataFrame, k: int = 4):
    """A fitted pipeline that gives every row a ``cluster``."""
    stages = [VectorAssembler(inputCols=list(NUMBERS), outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True), KMeans(k=k, seed=SEED, featuresCol="scaled", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(typed(df))


def assigned(base: DataFrame, rows: DataFrame, k: int = 4) -> DataFrame:
    """``rows`` with the cluster and segment name by a pipeline fitted on ``base``; names follow the medians of ``base``."""
    model = segmenter(base, k)
    names = segment_ranks(model.transform(typed(base)))  # k rows
    return model.transform(typed(rows)).drop("numbers", "scaled").join(F.broadcast(names), "cluster", "left")
