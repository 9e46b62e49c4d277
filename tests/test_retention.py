"""Golden cases on inline rows, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from keelson.functions import columns as f
from keelson.operators import check, clean, drift, evaluate, ranks, stats
from keelson.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = sorted(df.columns)
    assert sorted(d[0] for d in cur.description) == names
    at = [[d[0] for d in cur.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want


def test_padded_row_is_trimmed_and_blank_totals_are_imputed(spark):
    cols = "row_no int, customerID string, gender string, tenure int, MonthlyCharges double, TotalCharges string, Churn string"
    raw = spark.createDataFrame([(1, "  1234-CUST  ", "Male", 10, 29.9, " 299.50 ", "No"), (2, "a", "Male", 0, 20.0, " ", "No"), (3, "b", "Male", 5, 50.0, " ", "Yes"), (4, "c", "Male", 5, 50.0, "300", "No"), (5, "c", "Male", 5, 50.0, "350", "No"), (6, "d", "Unknown", 5, 50.0, "350", "Maybe")], cols)
    out = {r.customer_id: r for r in clean.cleaned(raw).collect()}
    assert out["1234-CUST"].total_charges == 299.5 and out["1234-CUST"].churn == 0
    assert out["a"].total_charges == 0.0 and out["b"].total_charges == 50.0 and out["c"].total_charges == 300.0 and "d" not in out
    assert {(r["index"], r.column) for r in check.raw_report(raw).collect() if r.check != "column"} == {(6, "gender"), (6, "Churn")}


def test_features_and_tiers(spark):
    row = spark.range(1).select(*(F.lit(v).alias(c) for c, v in (("phone_service", "Yes"), ("multiple_lines", "No"), ("online_security", " YES "), ("online_backup", "No"), ("device_protection", "Yes"), ("tech_support", "No"), ("streaming_tv", "Yes"), ("streaming_movies", "No"), ("tenure_months", 12))))
    out = row.select(f.total_services().alias("n"), f.tenure_group(F.col("tenure_months")).alias("g"), f.auto_payment(F.lit("Electronic check")).alias("a")).first()
    assert (out.n, out.g, out.a) == (4, "0-12m", 0)
    tiers = spark.createDataFrame([(0.61,), (0.4,), (0.39,), (0.8,)], "p double").select(f.tier3(F.col("p")), f.tier4(F.col("p"))).collect()
    assert [tuple(r) for r in tiers] == [("High", "High"), ("Medium", "Medium"), ("Low", "Monitor"), ("High", "Critical")]


def test_psi(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    assert drift.psi(a, a, "x").first().psi < 0.05
    shifted = a.select((F.col("x") / 4 + 60).alias("x"))
    assert drift.psi(a, shifted, "x").first().psi > 0.25
    empty = drift.psi(a, a.limit(0), "x").first()
    assert empty.psi is None and empty.n_now == 0


def test_latency_and_quantiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("value"), F.lit("e").alias("k"))
    r = evaluate.latency(df, ["k"]).first()
    assert (r.p50, r.p95, r.p99, r.n) == (50.0, 95.0, 99.0, 100)
    q = ranks.quantiles(df, [], "value", {"m": 0.5, "a": 0.25}, 3).first()
    assert (q.m, q.a) == (50.5, 25.75)


def test_collapsed_quintiles_fall_back_to_equal_width(spark):
    df = spark.createDataFrame([(0.0,)] * 90 + [(float(i),) for i in range(1, 11)], "x double")
    out = {r.x: r.q for r in stats.quintiles(df, "x").collect()}
    assert out[0.0] == 1 and out[2.0] == 1 and out[2.0 + 1] == 2 and out[10.0] == 5


def test_tail_of_chi_squared(spark):
    """Known values of the distribution: closed forms for 1, 2, 3 and 4 degrees of freedom."""
    import math

    want = {1: lambda x: math.erfc(math.sqrt(x / 2)), 2: lambda x: math.exp(-x / 2), 3: lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 4: lambda x: math.exp(-x / 2) * (1 + x / 2)}
    rows = spark.createDataFrame([(float(x), d) for x in (0.0, 0.01, 1.0, 3.84, 50.0, 400.0, 1e6) for d in want], "x double, dof long")
    for r in rows.withColumn("p", stats.chi2_tail(F.col("x"), F.col("dof"))).collect():
        assert r.p == pytest.approx(want[r.dof](r.x), abs=1e-11)


def test_ids_are_found_or_made(spark):
    rows = spark.createDataFrame([(0, " a "), (65_535, "b"), (65_536, "c"), (400_000, "d")], "n long, CustomerID string").repartition(3)
    assert {r.customer_id for r in clean.with_ids(rows, "n", "7").collect()} == {"a", "b", "c", "d"}
    made = {r.n: r.customer_id for r in clean.with_ids(rows.drop("CustomerID"), "n", "7").collect()}
    assert made == {0: "TEL-7-0000", 65_535: "TEL-7-0001", 65_536: "TEL-7-0002", 400_000: "TEL-7-0003"}


def test_absent_columns_and_names(spark):
    r = clean.with_absent_columns(spark.createDataFrame([(None,)], "tenure_months int"), {"tenure_months": 12, "gender": "Female"}).first()
    assert (r.tenure_months, r.gender) == (None, "Female")
    assert [clean.display_name(c) for c in ("predicted_ltv", "customer_id", "rfm_persona")] == ["Predicted LTV", "Customer ID", "RFM Persona"]
    assert clean.plain_name(" Tech-Support Plan ") == "tech_support_plan"


def test_drift_by_day(spark):
    base = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    days = base.select(F.lit("same").alias("day"), "x").union(base.select(F.lit("moved"), F.col("x") / 4 + 60)).union(base.limit(3).select(F.lit("far"), F.col("x") + 1000))
    out = {r.day: r for r in drift.by_day(base, days, "day", "x").collect()}
    assert out["same"].psi < 1e-9 and out["same"].n_now == 1000
    assert out["moved"].psi == pytest.approx(drift.psi(base, days.filter("day = 'moved'"), "x").first().psi)
    assert out["far"].psi is None and out["far"].n_now == 0

