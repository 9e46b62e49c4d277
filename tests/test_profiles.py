"""Splitters, profiles, matrices, densities and drift against plain computations."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.operators import drift, profile, ranks


def test_ranges_hold_a_like_number_of_values_whatever_they_look_like(spark):
    values = F.rand(5)
    for column in (values, F.exp(values * 40), -F.pow(values, 9) * 1e-9):
        counts = spark.range(0, 300_000, 1, 8).select(column.alias("v"), F.lit(1).alias("n"))
        counts = ranks.stored(counts, "test")
        most = ranks.in_ranges(counts, 64).groupBy("b").count().agg(F.max("count")).first()[0]
        assert most <= 2 * 300_000 / 64
    rows = ranks.running_counts(counts, [], 64)
    order = sorted(r.v for r in counts.collect())
    assert [(r.v, r.before) for r in rows.orderBy("v").limit(1000).collect()] == list(zip(order, range(1000)))
    assert rows.agg(F.min("total"), F.max("before")).first()[:] == (300_000, 299_999)


def test_quantiles_by_key_and_of_nothing(spark):
    pdf = pd.DataFrame({"k": [i % 3 for i in range(500)], "x": [math.sin(i) * 10 ** (i % 5) for i in range(500)]})
    out = {r.k: r for r in ranks.quantiles(spark.createDataFrame(pdf), ["k"], "x", {"a": 0.1, "m": 0.5}, 7).collect()}
    for k, of in pdf.groupby("k").x:
        assert out[k].a == pytest.approx(of.quantile(0.1)) and out[k].m == pytest.approx(of.median())
    none = spark.createDataFrame(pdf).limit(0)
    assert ranks.quantiles(none, ["k"], "x", {"m": 0.5}).collect() == [] and ranks.average_ranks(none, "x", "r").collect() == []


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    return pd.DataFrame({"n": rng.integers(0, 9, 200).astype(float), "x": rng.standard_normal(200) * 50, "t": rng.choice(["a", "b", "c"], 200), "u": rng.choice(["p", "q"], 200), "one": ["z"] * 200}).assign(x=lambda d: d.x.where(d.x < 60), t=lambda d: d.t.where(d.n != 3))


def spark_rows(spark, pdf):
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "n double, x double, t string, u string, one string")


def test_describe_is_that_of_all_columns(spark, table):
    values = profile.value_table(spark_rows(spark, table))
    out = {r.name: r for r in profile.describe(values).collect()}
    want = table.describe(include="all")
    for c in ("n", "x"):
        got = [out[c]["count"], out[c].mean, out[c].std, out[c].min, out[c].q25, out[c].q50, out[c].q75, out[c].max]
        assert got == pytest.approx([want[c][k] for k in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")]) and out[c].unique is None
    for c in ("t", "u", "one"):
        counts = table[c].value_counts()
        assert (out[c]["count"], out[c].unique, out[c].freq) == (want[c]["count"], len(counts), counts.max()) and out[c].top == min(counts[counts == counts.max()].index) and out[c].mean is None
    missing = {r.name: (r.missing, r.percent) for r in profile.missing(values).collect()}
    assert missing == {c: (table[c].isna().sum(), pytest.approx(table[c].isna().mean() * 100)) for c in table}
    s = profile.shape(values).first()
    assert (s.n_rows, s.n_columns, s.cells, s.missing) == (200, 5, 1000, table.isna().sum().sum())


def test_repeated_rows_and_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (None, "c"), (None, "c")], "id long, v string")
    assert profile.repeats(rows, "id").first()[:] == (3, 4)
    assert profile.repeats(rows.limit(0), "id").first()[:] == (0, 0)


def test_matrices(spark, table):
    full = table[["n", "x"]].assign(y=lambda d: d.x * d.n).dropna()
    df = spark.createDataFrame(full)
    for of, method in ((profile.correlations, "pearson"), (profile.rank_correlations, "spearman")):
        want = full.corr(method)
        assert {(r.a, r.b): r.r for r in of(df, ("n", "x", "y")).collect()} == {(a, b): pytest.approx(want[a][b], abs=1e-9) for a in full for b in full}
    kinds = table.assign(v=table.u.map({"p": "r", "q": "s"}).where(table.x < 20, "r"))[["t", "u", "one", "v"]]
    got = {(r.a, r.b): r.v for r in profile.cramers(spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in kinds.itertuples(index=False)], "t string, u string, one string, v string"), tuple(kinds)).collect()}
    for a, b in combinations(kinds, 2):
        both = pd.crosstab(kinds[a], kinds[b]).to_numpy().astype(float)
        e = np.outer(both.sum(1), both.sum(0)) / both.sum()
        gap = np.abs(both - e)
        gap = gap - np.minimum(0.5, gap) if both.shape == (2, 2) else gap
        least = min(both.shape) - 1
        want = 0.0 if least < 1 else math.sqrt((gap**2 / e).sum() / (both.sum() * least))
        assert got[a, b] == got[b, a] == pytest.approx(want, abs=1e-9)


def test_density_is_that_of_a_gaussian_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.standard_normal(3000) * 4 + 7] + [("b", float(v)) for v in rng.integers(0, 73, 2000)] + [("c", 1.0), ("d", 2.0), ("d", 2.0), ("e", None)]
    out = profile.density(spark.createDataFrame(rows, "l string, v double"), "v", "l", points=200).collect()
    assert {r.l for r in out} == {"a", "b"}
    for label in "ab":
        v = np.array([x for k, x in rows if k == label])
        h = v.std(ddof=1) * len(v) ** -0.2
        got = sorted((r.x, r.density) for r in out if r.l == label)
        want = [np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)) for x, _ in got]
        step = got[1][0] - got[0][0]
        bound = (step / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi))  # of dealing a value to the two points beside it
        assert len(got) == 200 and np.abs(np.array([d for _, d in got]) - want).max() < bound
        assert sum(d for _, d in got) * step == pytest.approx(1, abs=0.01)


def test_drift_of_all_features_from_one_scan_a_side(spark):
    rng = np.random.default_rng(3)
    base = pd.DataFrame({"x": rng.standard_normal(400), "y": rng.integers(0, 5, 400).astype(float), "k": rng.choice(["a", "b"], 400), "gone": 1.0})
    now = pd.DataFrame({"x": rng.standard_normal(300) + 1.5, "y": rng.integers(0, 5, 300).astype(float), "k": rng.choice(["a", "b", "c"], 300, p=[0.8, 0.1, 0.1]), "few": [1.0] * 300})
    base["few"] = 1.0
    now.loc[20:, "few"] = np.nan
    a, b = (spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in d.itertuples(index=False)], ", ".join(f"{c} {'string' if c == 'k' else 'double'}" for c in d)) for d in (base, now))
    out = {r.feature: r for r in drift.run(a, b, ("x", "y", "few", "gone"), ("k",)).collect()}
    assert set(out) == {"x", "y", "k"}  # a column that one side lacks, and one with too few values
    for c in ("x", "y"):
        edges = np.unique(np.percentile(base[c], np.linspace(0, 100, 11)))
        p, q = (np.where(h == 0, 1e-6, h) for h in (np.histogram(d[c], edges)[0].astype(float) for d in (base, now)))
        p, q = p / p.sum(), q / q.sum()
        assert out[c].psi == pytest.approx(abs(((q - p) * np.log(q / p)).sum()), abs=1e-9)
        assert (out[c].base_mean, out[c].base_std, out[c].now_mean, out[c].now_std) == pytest.approx((base[c].mean(), base[c].std(), now[c].mean(), now[c].std(ddof=0)))
    shift = max(abs((now.k == v).mean() - (base.k == v).mean()) for v in "abc")
    assert out["k"].max_shift == pytest.approx(shift) and out["k"].severity == "Critical" and out["y"].severity == "Normal" and {r.overall for r in out.values()} == {"Critical"}
    assert drift.run(a, b.limit(0), ("x",), ("k",)).count() == 1
