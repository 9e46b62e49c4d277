"""Commits, loads, versions and change capture of a store: replays, lost jobs, aborts, folds and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keelson.operators import check, store
from keelson.operators.store import COLUMNS, RELATIONS, Store
from keelson.sources.fixture import raw_subscribers, subscribers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sub(spark):
    return subscribers(spark, SF).cache()


def ids(df, c="customer_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_a_lost_load_is_not_seen_and_can_be_done_again(spark, sub, tmp_path, monkeypatch):
    s = Store.create(spark, str(tmp_path / "s"), store.SCHEMAS)
    assert store.joined(s).collect() == [] and s.current().version == 0
    store.load(s, sub.filter("k < 10"), "a.csv", "a")
    with monkeypatch.context() as m:  # lost when the four tables are written and only the manifest is missing
        m.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.load(s, sub, "b.csv", "b")
    assert len(ids(store.joined(s))) == 10 and s.current().version == 1
    assert store.load(s, sub, "b.csv", "b")["rows_inserted"] == 140
    again = store.load(s, sub, "b.csv", "b")
    assert again["rows_inserted"] == 140 and s.current().version == 2
    assert ids(store.joined(s)) == ids(sub) and len(ids(store.joined(s, 1))) == 10  # an earlier state stays readable
    for name, of in RELATIONS.items():
        rows = s.read(name)
        assert rows.count() == rows.select("id").distinct().count() == 150 and set(of) < set(rows.columns)


def test_faults_within_a_batch(spark, sub, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), store.SCHEMAS)
    rows = sub.filter("k between 1 and 6").withColumn("customer_id", F.when(F.col("k") == 1, None).when(F.col("k") == 2, " ").when(F.col("k") == 3, "twice").when(F.col("k") == 4, "twice").otherwise(F.col("customer_id")))
    note = store.load(s, rows, "f.csv", "f")
    assert (note["rows_processed"], note["rows_inserted"], note["rows_skipped"], note["rows_failed"], note["status"]) == (6, 3, 0, 3, "degraded")
    assert store.load(s, rows.limit(0), "none.csv", "none")["rows_processed"] == 0
    assert store.joined(s).count() == 3


def test_a_bad_clean_row_stops_the_load(spark, sub, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), store.SCHEMAS)
    raw = raw_subscribers(sub)
    before = s.current()
    report = check.ingest(s, raw, "raw.csv", "a")
    assert report["status"] == "failed" and report["failures_count"] > 0 and s.current() == before and store.joined(s).collect() == []
    good = check.ingest(s, raw.filter("gender <> 'Unknown'"), "good.csv", "b")
    assert good["status"] == "success" and good["failures_count"] == 0 and good["rows_inserted"] == store.joined(s).count() > 100


def test_rules_of_all_columns(spark, sub):
    row = {c: F.lit(v) for c, v in sub.filter("k = 5").select(*COLUMNS).first().asDict().items()}
    bad = {"senior_citizen": 2, "tenure_months": -1, "monthly_charges": -0.5, "total_charges": None, "multiple_lines": "Maybe", "payment_method": "Cash", "churn": "x"}
    rows = spark.range(1).select(*((F.lit(bad[c]) if c in bad else v).alias(c) for c, v in row.items() if c != "gender"), F.lit(1).alias("more"), F.lit(7).alias("at"))
    found = {(r.column, r.check, r.failure_value) for r in check.clean_report(rows, "at").collect()}
    assert found == {
        ("senior_citizen", "domain", "2"), ("tenure_months", "range", "-1"), ("monthly_charges", "range", "-0.5"), ("total_charges", "missing", None), ("multiple_lines", "domain", "Maybe"),
        ("payment_method", "domain", "Cash"), ("churn", "type", "x"), ("gender", "column", None), ("more", "unexpected", None),
    }
    clean_rows = sub.select(*COLUMNS).withColumn("at", F.lit(1))
    assert check.clean_report(clean_rows, "at").collect() == []
    twice = clean_rows.unionByName(clean_rows.filter("customer_id = 'Customer#000000003'"))
    assert [(r.column, r.check) for r in check.clean_report(twice, "at").collect()] == [("customer_id", "unique")] * 2


def test_reads_stay_bounded_and_equal_through_folds(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), {"t": "version long, id long, v long, w string"})
    want = {}
    most = 0
    for n in range(7):
        rows = spark.range(0, 400, 1 if n == 0 else 3).select("id", (F.col("id") * 10 + n).alias("v"), F.lit("x").alias("w"))
        store.upsert(s, "t", rows, "id", f"b{n}", buckets=4)
        want |= {r.id: r.v for r in rows.collect()}
        before = {r.id: r.v for r in store.state(s, "t", "id").collect()}
        version = s.current().version
        store.fold(s, "t", "id", share=0.5)
        assert before == want == {r.id: r.v for r in store.state(s, "t", "id").collect()}
        assert {r.id: r.v for r in store.state(s, "t", "id", version).collect()} == want  # a reader that began before the fold
        most = max(most, store.read_rows(s, "t"))
    assert most <= 1.5 * 400 and s.read("t").select("id").distinct().count() == 400
    assert store.fold(s, "t", "id", share=100) == []


def test_updates_insert_nothing_and_nulls_leave_what_is_there(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), {"t": "version long, id long, a string, b double, c string"})
    store.upsert(s, "t", spark.createDataFrame([(1, "x", 1.0, "p"), (2, "y", 2.0, "q")], "id long, a string, b double, c string"), "id", "first", buckets=2)
    new = spark.createDataFrame([(1, None, 5.0), (3, "z", 9.0)], "id long, a string, b double")
    for _ in range(2):
        store.update(s, "t", new, "id", ["a", "b"], "second", buckets=2)
    assert sorted(map(tuple, store.state(s, "t", "id").collect())) == [(1, "x", 5.0, "p"), (2, "y", 2.0, "q")] and s.current().version == 2


def test_changes_are_scored_once(spark, tmp_path, monkeypatch):
    schema = "id long, updated_at timestamp, charge double"
    s = Store.create(spark, str(tmp_path / "s"), {"scored": f"version long, {schema}, score double"})
    day, hour = datetime(2026, 3, 1), timedelta(hours=1)
    scored = []

    def score(rows):
        out = rows.withColumn("score", F.col("charge") * 2)
        scored.append(sorted(r.id for r in rows.collect()))
        return out

    def run(rows, batch):
        return store.sync(s, "scored", spark.createDataFrame(rows, schema), "id", score, batch, late=hour)

    rows = [(1, day, 1.0), (2, day + hour, 2.0), (2, day, 9.0), (3, day + hour, 3.0), (4, None, 4.0)]
    assert run(rows, "s1")["synced"] == "3" and scored[-1] == [1, 2, 3]
    run(rows, "s2")
    assert scored[-1] == []  # nothing is new
    rows += [(5, day + hour, 5.0), (6, day + hour / 2, 6.0), (7, day - 2 * hour, 7.0)]  # the stamp of the mark, late, too late
    run(rows, "s3")
    assert scored[-1] == [5, 6]
    rows += [(1, day + 3 * hour, 11.0), (2, day + hour / 4, 0.0)]  # an update, and one that is older than what was scored
    with monkeypatch.context() as m:  # lost after the scores are written
        m.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(rows, "s4")
    run(rows, "s4")
    assert scored[-2:] == [[1], [1]] and s.current().note["mark:scored"] == (day + 3 * hour).isoformat()
    calls = len(scored)
    run(rows, "s4")
    assert len(scored) == calls  # a replay
    assert {r.id: r.score for r in store.state(s, "scored", "id").collect()} == {1: 22.0, 2: 4.0, 3: 6.0, 5: 10.0, 6: 12.0}


def test_the_mark_prunes_the_scan(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), {"scored": "version long, id long, updated_at timestamp, score double"})
    path = str(tmp_path / "source")
    spark.range(100).select("id", F.expr("timestampadd(DAY, id, timestamp'2026-01-01')").alias("updated_at")).write.parquet(path)
    plans = []

    def score(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.withColumn("score", F.lit(1.0))

    for n in range(2):
        store.sync(s, "scored", spark.read.parquet(path), "id", score, f"s{n}")
    assert "GreaterThanOrEqual(updated_at," not in plans[0] and plans[1].count("GreaterThanOrEqual(updated_at,") >= 2


def test_a_store_needs_a_shared_folder(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
