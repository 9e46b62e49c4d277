"""Files, sinks, streams and models."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from keelson.operators import folds, models, runs, sinks
from keelson.sources import files
from keelson.sources.fixture import subscribers
from keelson.streaming import arrivals

SF = "/root/testdata/sf0.001"
HEAD = "customerID,gender,tenure,MonthlyCharges,TotalCharges,Churn\n"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(HEAD + "x1,Male,3,20.5,61.5,No\nx2,Female,oops,1, ,Yes\n")
    (tmp_path / "in/b.csv").write_text(HEAD + "x3,Male,1,2,3,No\n")
    (tmp_path / "in/c.txt").write_text("no table")
    rows = files.read_csv(spark, str(tmp_path / "in/a.csv")).orderBy("customerID").collect()
    assert [(r.customerID, r.tenure) for r in rows] == [("x1", 3), ("x2", None)]
    assert files.read_folder(spark, str(tmp_path / "in")).count() == 3
    assert files.read_table(spark, str(tmp_path / "in/a.csv")).count() == 2
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert files.read_table(spark, str(tmp_path / "t.parquet")).count() == 3
    with pytest.raises(ValueError):
        files.read_table(spark, "t.xlsx")
    with pytest.raises(AnalysisException):
        files.read_csv(spark, str(tmp_path / "none.csv")).count()
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert {r.a for r in files.read_lines(spark, str(tmp_path / "log.jsonl"), "a int").collect()} == {1, 2}
    (tmp_path / "reports").mkdir()
    for day in ("2026-01-02", "2026-01-01"):
        (tmp_path / f"reports/drift_{day}.json").write_text(json.dumps({"numerical_drift": {"tenure": 0.1, "charges": 0.2}}, indent=1))
    (tmp_path / "reports/latest.json").write_text('{"numerical_drift": {}}')
    trend = files.psi_trend(files.read_reports(spark, str(tmp_path / "reports"), "numerical_drift map<string,double>")).collect()
    assert {(str(r.day), r.feature, r.psi) for r in trend} == {(d, k, v) for d in ("2026-01-01", "2026-01-02") for k, v in (("tenure", 0.1), ("charges", 0.2))}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "id string, v double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        sinks.write_report(df, str(tmp_path / "r"), day)
    assert spark.read.json(str(tmp_path / "r")).groupBy("run_date").count().count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 4
    log = df.withColumn("ts", F.lit("2026-03-04 10:00:00").cast("timestamp"))
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).filter("date = '2026-03-04'").count() == 4
    sinks.put_version(df, str(tmp_path / "v"), 0)
    for _ in range(2):  # the second one is a replay
        sinks.put_version(spark.createDataFrame([("b", 2.0), ("c", 3.0)], "id string, v double"), str(tmp_path / "v"), 1)
        assert {tuple(r) for r in sinks.newest(spark, str(tmp_path / "v"), "id").collect()} == {("a", 1.5), ("b", 2.0), ("c", 3.0)}


def test_files_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    places = [str(tmp_path / p) for p in ("in", "table", "log", "check")]
    (tmp_path / "in/a.csv").write_text(HEAD + " x1 ,Male,3,20.5, ,No\nx2,Female,5,1,9,Yes\nx2,Female,5,1,9,Yes\n,Male,1,1,1,No\n")
    (tmp_path / "in/bad.csv").write_text(HEAD + "x9,Other,1,1,1,No\n")
    arrivals.watch(spark, *places).awaitTermination()
    table = lambda: {(r.customer_id, r.total_charges, r.churn) for r in sinks.newest(spark, places[1], "customer_id").collect()}
    assert table() == {("x1", 20.5, 0), ("x2", 9.0, 1)}
    (tmp_path / "in/b.csv").write_text(HEAD + "x2,Female,6,1,10,No\nx3,Male,0,7, ,No\n")
    arrivals.watch(spark, *places).awaitTermination()
    arrivals.watch(spark, *places).awaitTermination()  # nothing new
    assert table() == {("x1", 20.5, 0), ("x2", 10.0, 0), ("x3", 0.0, 0)}
    log = {r.file.rpartition("/")[2]: (r.n_rows, r.n_valid, r.outcome) for r in spark.read.parquet(places[2]).collect()}
    assert log == {"a.csv": (4, 3, "processed"), "bad.csv": (1, 0, "failed"), "b.csv": (2, 2, "processed")}


def test_stream_of_events_equals_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = arrivals.by_day(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("days").collect()} == {tuple(r) for r in arrivals.by_day(events).collect()}


def test_models(spark):
    sub = subscribers(spark, "/root/testdata/sf0.01")
    fit, held = models.split(sub)
    assert fit.count() + held.count() == sub.count() and 0.15 < held.count() / sub.count() < 0.25
    fitted, scores = models.compare(sub)
    assert {s[0] for s in scores} == {"logistic", "forest", "boosted"} and dict((s[0], s[1]) for s in scores)["logistic"] > 0.65
    odd = sub.limit(3).withColumn("contract_type", F.lit("never seen")).withColumn("monthly_charges", F.lit(None).cast("double"))
    assert fitted["logistic"].transform(models.typed(odd)).count() == 3
    assert models.value_models(sub)[0][1] > 0.8


def customers_of_one_file(spark, folder, n=600):
    """Subscribers from a customer file of one row group, so of one task; one in 50 has no balance, so no charges."""
    k = F.col("id")
    kinds = F.array(*map(F.lit, ("AUTOMOBILE", "MACHINERY", "HOUSEHOLD")))
    rows = spark.range(1, n + 1, numPartitions=1).select(
        k.alias("c_custkey"), F.format_string("Customer#%09d", k).alias("c_name"), (k % 25).cast("int").alias("c_nationkey"), F.when(k % 50 > 0, (k * 7919 % 10051) / 100).alias("c_acctbal"), kinds[(k % 3).cast("int")].alias("c_mktsegment")
    )
    rows.write.parquet(f"{folder}/customer.parquet")
    return subscribers(spark, str(folder))


def spied(monkeypatch, cls):
    """The partitions of the rows of each fit of an estimator."""
    seen, fit = [], cls._fit
    monkeypatch.setattr(cls, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    return seen


def test_rows_to_fit_are_spread(spark, tmp_path):
    sub = customers_of_one_file(spark, tmp_path).withColumn("customer_id", F.when(F.col("k") > 500, F.col("customer_id")))  # most have no id
    rows = models.spread(sub, 100)
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sub.rdd.getNumPartitions() == 1 and len(sizes) == 6 and min(sizes) > 80 and max(sizes) < 120
    assert sorted(map(str, rows.collect())) == sorted(map(str, sub.collect()))
    rows.unpersist()
    same = models.spread(sub, 600)
    assert same.collect() == sub.collect()
    same.unpersist()


def test_value_models_of_one_file(spark, tmp_path, monkeypatch):
    sub = customers_of_one_file(spark, tmp_path).filter("monthly_charges is not null")
    whole = dict((name, scores) for name, *scores in models.value_models(sub))
    stages, trees = spied(monkeypatch, models.Imputer), [spied(monkeypatch, c) for c in (models.RandomForestRegressor, models.GBTRegressor)]
    parts = dict((name, scores) for name, *scores in models.value_models(sub, part_rows=100))
    assert stages == [6] and trees == [[6], [6]]
    assert parts["linear"] == pytest.approx(whole["linear"]) and set(parts) == set(whole) == {"linear", "forest", "boosted"}
    assert all(parts[name][0] == pytest.approx(whole[name][0], abs=0.05) for name in parts)


def test_comparison_of_one_file(spark, tmp_path, monkeypatch):
    sub = customers_of_one_file(spark, tmp_path)
    whole = dict((name, scores) for name, *scores in models.compare(sub)[1])
    stages, trees = spied(monkeypatch, models.Imputer), [spied(monkeypatch, c) for c in (models.RandomForestClassifier, models.GBTClassifier)]
    fitted, scores = models.compare(sub, part_rows=100)
    parts = dict((name, scores) for name, *scores in scores)
    assert stages == [6] and trees == [[6], [6]]
    assert parts["logistic"] == pytest.approx(whole["logistic"], abs=0.02) and set(parts) == set(whole) == set(fitted)
    held = models.typed(models.split(sub)[1])
    for name, model in fitted.items():  # whole pipelines, from raw rows to what was judged
        assert tuple(models.judged(model.transform(held), "churn").values()) == pytest.approx(tuple(parts[name]), abs=0.02)


def test_segments(spark):
    sub = subscribers(spark, "/root/testdata/sf0.01")
    _, scores, rows = models.segments(sub)
    assert [k for k, _ in scores] == [2, 3, 4, 5, 6] and rows.count() == sub.count()
    medians = {r.segment: r.m for r in rows.groupBy("segment").agg(F.median("total_charges").alias("m")).collect()}
    known = [s for s in models.SEGMENTS if s in medians]
    assert len(known) >= 3 and [medians[s] for s in known] == sorted((medians[s] for s in known), reverse=True)


def test_folds_and_draws(spark):
    sub = subscribers(spark, SF)
    by_fits = models.cross_validated(sub, folds=2)
    assert [name for name, *_ in by_fits] == ["logistic", "forest", "boosted"] and all(0.5 < auc <= 1 for _, auc, _ in by_fits)
    rows = folds.folded(sub, 3).cache()
    beta = folds.fitted(rows, 3, [0.01, 0.2])
    for f in range(3):
        for k, setting in enumerate((0.01, 0.2)):
            fit = rows.filter(F.col("fold") != f).withColumn("features", array_to_vector("x"))
            model = LogisticRegression(labelCol="y", weightCol="w", maxIter=500, regParam=setting, tol=1e-13).fit(fit)
            assert abs(model.coefficients.toArray() - beta[f, k, :-1]).max() < 1e-6 and abs(model.intercept - beta[f, k, -1]) < 1e-6
    scores = folds.scored(rows, beta)
    for r in folds.judged(scores).collect():
        one = scores.filter((F.col("setting") == r.setting) & (F.col("fold") == r.fold)).toPandas()
        pos, neg = one.p[one.y == 1].to_numpy(), one.p[one.y == 0].to_numpy()
        auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
        yes = one.p >= 0.5
        tp = (yes & (one.y == 1)).sum()
        assert (r.auc, r.accuracy, r.f1) == pytest.approx((auc, (yes == one.y).mean(), 2 * tp / (yes.sum() + one.y.sum())))
    out = folds.cross_validated(sub, folds.draws(3), 3).collect()
    assert len(out) == 3 and [r.mean_auc for r in out if r.best] == [max(r.mean_auc for r in out)]


def test_rows_that_are_added_are_scored_once(spark, tmp_path):
    sub = subscribers(spark, SF)
    folder, table, checkpoint = (str(tmp_path / p) for p in ("rows", "scores", "check"))
    sub.filter("k < 40").write.parquet(folder)
    for _ in range(2):  # the second one finds nothing new
        arrivals.rescore(spark, folder, sub.schema.simpleString()[7:-1].replace(":", " "), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == sub.filter("k < 40").count()
    sub.filter("k >= 40").write.mode("append").parquet(folder)
    arrivals.rescore(spark, folder, sub.schema.simpleString()[7:-1].replace(":", " "), table, checkpoint).awaitTermination()
    want = {r.customer_id: r.churn_probability for r in sub.collect()}
    assert {r.customer_id: r.churn_probability for r in sinks.newest(spark, table, "customer_id").collect()} == pytest.approx(want, abs=1e-6)


def test_versions_of_models(spark):
    runs = spark.createDataFrame(
        [("churn", "v1", 1, "archived", 9, {"auc": 0.7, "f1": 0.5}), ("churn", "v2", 2, "production", 9, {"auc": 0.8, "accuracy": 0.6}), ("churn", "v3", 3, "staging", 9, {"auc": 0.75}), ("kinds", "v1", 1, "staging", 9, {"silhouette": 0.4})], "model string, version string, run int, status string, n_rows long, metrics map<string,double>"
    )
    assert {tuple(r) for r in models.version_counts(runs).collect()} == {("churn", "v2", 3, False), ("kinds", None, 1, True)}
    assert {tuple(r) for r in models.versions_compared(runs, "churn", "v1", "v2").collect()} == {("auc", 0.7, 0.8, 0.1), ("f1", 0.5, None, None), ("accuracy", None, 0.6, None)}
    picked = {tuple(r) for r in models.picked_runs(runs, {"churn": "auc", "kinds": "silhouette"}).collect()}
    assert picked == {("churn", "v2", "v3", "v3", "v2"), ("kinds", None, "v1", "v1", "v1")}
    assert models.promoted(None, {"auc": 0.1}, "auc") and not models.promoted({"auc": 0.7}, {"auc": 0.7}, "auc")


def test_runs_are_fitted_once_and_last(spark, monkeypatch):
    sub = subscribers(spark, SF)
    s = runs.fitted_once(spark, "a test", sub.filter("k % 2 = 0"), sub)
    rows = {(r.model, r.version): r for r in runs.table(s).collect()}
    assert set(rows) == {(m, v) for m in ("churn", "ltv", "segmentation") for v in ("v1", "v2")}
    for m, metric in (("churn", "auc"), ("ltv", "r2")):
        wins = rows[m, "v2"].metrics[metric] > rows[m, "v1"].metrics[metric]
        assert (rows[m, "v1"].status, rows[m, "v2"].status) == (("archived", "production") if wins else ("production", "staging"))
        assert runs.production(s, m).stages
    assert {rows["segmentation", v].status for v in ("v1", "v2")} == {"staging"} and runs.production(s, "segmentation") is None
    monkeypatch.setattr(runs, "_fit", lambda *a: pytest.fail("fitted again"))
    assert runs.table(runs.fitted_once(spark, "a test", sub.filter("k % 2 = 0"), sub)).count() == 6
    runs.retrain(s, "churn", sub, sub, "churn-1")  # a replay
    assert runs.table(s).count() == 6


def test_curve_and_places(spark):
    sub = subscribers(spark, SF)
    curve = models.learning_curve(sub, fractions=(0.5, 1.0))
    assert [c[0] for c in curve] == [0.5, 1.0] and curve[0][1] < curve[1][1] and all(0.5 < x <= 1 for c in curve for x in c[2:])
    placed = models.assigned(sub.filter("k % 2 = 0"), sub.filter("k % 2 = 1"))
    assert placed.count() == sub.filter("k % 2 = 1").count() and placed.filter("segment is null").isEmpty()

