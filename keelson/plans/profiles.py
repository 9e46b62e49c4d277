"""Profiles, whole matrices, densities and drift over all features, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f
from ..operators import clean, drift, profile
from ..sources.fixture import PLAIN
from .queries import CAT, NUM, C, R, Tables, many

#: Columns of the two tables that are profiled, and those that are numbers.
SUB_COLUMNS = ("k", "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months", "phone_service", "internet_service", "contract_type", "paperless_billing", "payment_method", "monthly_charges", "multiple_lines", "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies", "total_charges", "churn_probability", "churn")
RAW_COLUMNS = ("row_no", "customerID", "gender", "tenure", "MonthlyCharges", "TotalCharges", "Churn", *PLAIN)
NUMBERS = {"k", "senior_citizen", "tenure_months", "monthly_charges", "total_charges", "churn_probability", "churn", "row_no", "tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"}
MATRIX = ("tenure_months", "monthly_charges", "total_charges", "churn")
DRIFT_NUMBERS = ("tenure_months", "monthly_charges", "total_charges", "charges_ratio", "total_services", "total_charges_log")
DRIFT_KINDS = ("contract_type", "payment_method", "internet_service", "tenure_group")
POINTS = 100


def profiled(t: Tables, what) -> DataFrame:
    """A profile of both tables; totals of the raw one that aren't numbers are missing."""
    raw = t.raw.withColumn("TotalCharges", clean.number("TotalCharges"))
    return reduce(DataFrame.unionByName, (what(rows).select(F.lit(n).alias("source"), "*") for n, rows in (("sub", t.sub), ("raw", raw))))


def of_values(what):
    return lambda t: profiled(t, lambda rows: what(profile.value_table(rows)))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: f.rnd(C(c), digits) for c in columns})


def described(t: Tables) -> DataFrame:
    return rounded(of_values(profile.describe)(t), "mean", "std", "q25", "q50", "q75")


def numbers(t: Tables) -> DataFrame:
    """Numeric columns alone, with 0.0 where there is no value."""

    def one(rows):
        values = profile.value_table(rows.select(*profile.numeric(rows)))
        out = profile.describe(values).join(profile.missing(values), "name").select("name", "mean", "min", "max", "std", "missing")
        return out.fillna(0.0, ["mean", "min", "max", "std"])

    return rounded(profiled(t, one), "mean", "std")


def _value(source: str, c: str) -> str:
    x = 'TRY_CAST(trim("TotalCharges") AS DOUBLE)' if c == "TotalCharges" else f'"{c}"'
    return f"SELECT '{source}' AS source, '{c}' AS name, CAST({x} AS VARCHAR) AS value, {f'CAST({x} AS DOUBLE)' if c in NUMBERS else 'CAST(NULL AS DOUBLE)'} AS v, {'true' if c in NUMBERS else 'false'} AS number FROM {source}"


_vt = "vt AS (" + " UNION ALL ".join(_value(s, c) for s, cs in (("sub", SUB_COLUMNS), ("raw", RAW_COLUMNS)) for c in cs) + ")"
_tops = "tops AS (SELECT source, name, value AS top, count(*) AS freq FROM vt WHERE NOT number AND value IS NOT NULL GROUP BY source, name, value QUALIFY row_number() OVER (PARTITION BY source, name ORDER BY count(*) DESC, value) = 1)"
_quarters = ", ".join(f"{R(f'quantile_cont(v, {q})', 4)} AS {n}" for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
_missing = "count(*) - count(value) AS missing"
many(
    ("prof_describe", described, f"""WITH {_vt}, {_tops} SELECT source, name, count(value) AS "count", CASE WHEN NOT any_value(number) AND count(value) > 0 THEN count(DISTINCT value) END AS "unique", any_value(top) AS top, any_value(freq) AS freq, {R('avg(v)', 4)} AS mean, {R('stddev_samp(v)', 4)} AS std, min(v) AS min, {_quarters}, max(v) AS max FROM vt LEFT JOIN tops USING (source, name) GROUP BY 1, 2"""),
    ("prof_numeric", numbers, f"WITH {_vt} SELECT source, name, {R('coalesce(avg(v), 0.0)', 4)} AS mean, coalesce(min(v), 0.0) AS min, coalesce(max(v), 0.0) AS max, {R('coalesce(stddev_samp(v), 0.0)', 4)} AS std, {_missing} FROM vt WHERE number GROUP BY 1, 2"),
    ("prof_shape", of_values(profile.shape), f"WITH {_vt} SELECT source, max(n) AS n_rows, count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(missing) AS BIGINT) AS missing, sum(missing) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT source, name, count(*) AS n, {_missing} FROM vt GROUP BY 1, 2) GROUP BY 1"),
    ("stat_missing", lambda t: rounded(of_values(profile.missing)(t), "percent"), f"WITH {_vt} SELECT source, name, {_missing}, {R('(count(*) - count(value)) * 100.0::DOUBLE / count(*)', 4)} AS percent FROM vt GROUP BY 1, 2"),
    ("prof_dups", lambda t: profile.repeats(clean.trimmed(t.raw.unionByName(t.raw.filter("row_no % 20 = 0"))), "customerID"), 'SELECT count_if(row_no % 20 = 0) AS duplicate_rows, count(*) + count_if(row_no % 20 = 0) - count(DISTINCT trim("customerID")) AS duplicate_ids FROM raw'),
)

# matrices and densities
_ranked = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in MATRIX) + " FROM sub)"
_corr = lambda rows: " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, 1.0::DOUBLE AS r" if a == b else f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 6)} AS r FROM {rows}" for a in MATRIX for b in MATRIX)
KIND_COLUMNS = (*CAT, "partner", "churn")
_pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM sub" for a in KIND_COLUMNS for b in KIND_COLUMNS if a != b)
_cramer = f"""WITH cp AS ({_pairs}), cn AS (SELECT a, b, x, y, count(*)::DOUBLE AS n FROM cp GROUP BY ALL), cx AS (SELECT a, b, x, sum(n) AS p FROM cn GROUP BY ALL), cy AS (SELECT a, b, y, sum(n) AS q FROM cn GROUP BY ALL),
ct AS (SELECT a, b, sum(n) AS t, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM cn GROUP BY ALL),
cc AS (SELECT a, b, r, c, t, p * q / t AS e, abs(coalesce(n, 0) - p * q / t) AS gap FROM cx JOIN cy USING (a, b) JOIN ct USING (a, b) LEFT JOIN cn USING (a, b, x, y)),
cs AS (SELECT a, b, r, c, t, sum(power(CASE WHEN r = 2 AND c = 2 THEN gap - least(0.5, gap) ELSE gap END, 2) / e) AS chi2 FROM cc GROUP BY ALL)
SELECT a, b, CASE WHEN least(r, c) <= 1 THEN 0.0 ELSE {R('sqrt(chi2 / (t * (least(r, c) - 1)))', 6)} END AS v FROM cs"""
_kde = f"""WITH m AS (SELECT churn, count(*) AS n, stddev_samp(tenure_months) * power(count(*)::DOUBLE, -0.2::DOUBLE) AS h, min(tenure_months)::DOUBLE AS low, max(tenure_months)::DOUBLE AS high FROM sub GROUP BY 1),
g AS (SELECT churn, n, h, low - 3.0::DOUBLE * h AS start, (high - low + 6.0::DOUBLE * h) / {POINTS - 1} AS step FROM m), d AS (SELECT churn, (tenure_months - start) / step AS place FROM sub JOIN g USING (churn)),
w AS (SELECT churn, i, sum(w) AS w FROM (SELECT churn, floor(place) AS i, 1 - (place - floor(place)) AS w FROM d UNION ALL SELECT churn, floor(place) + 1, place - floor(place) FROM d) GROUP BY 1, 2)
SELECT g.churn, CAST(p.point AS INT) AS point, {R('start + p.point * step', 6)} AS x, {R('sum(w * exp(-power((p.point - i) * step / h, 2) / 2)) / (n * h * 2.5066282746310002::DOUBLE)', 6)} AS density FROM g JOIN w ON w.churn = g.churn, (SELECT unnest(range({POINTS})) AS point) p GROUP BY g.churn, p.point, start, step, n, h"""
many(
    ("stat_pearson", lambda t: rounded(profile.correlations(t.sub, MATRIX), "r", digits=6), f"SELECT * FROM ({_corr('sub')})"),
    ("stat_spearman", lambda t: rounded(profile.rank_correlations(t.sub, MATRIX), "r", digits=6), f"WITH {_ranked} SELECT * FROM ({_corr('ranked')})"),
    ("stat_cramer", lambda t: rounded(profile.cramers(t.sub, KIND_COLUMNS), "v", digits=6), _cramer),
    ("stat_kde", lambda t: rounded(profile.density(t.sub, "tenure_months", "churn", POINTS), "x", "density", digits=6), _kde),
)

# drift of all features
_features = "f AS (SELECT *, k % 2 AS side, monthly_charges / (tenure_months + 1) AS charges_ratio, ln(1 + total_charges) AS total_charges_log FROM eng)"
_l = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, side, CAST({c} AS DOUBLE) AS v FROM f" for c in DRIFT_NUMBERS) + ")"
_kinds = "ks AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, side, {c} AS kind FROM f" for c in DRIFT_KINDS) + "), ka AS (SELECT feature, kind, count_if(side = 0) AS a, count_if(side = 1) AS b FROM ks GROUP BY 1, 2), sh AS (SELECT feature, kind, a / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) AS base_share, b / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE) AS now_share FROM ka)"
_severity = lambda x: f"CASE WHEN {x} >= 0.25 THEN 'Critical' WHEN {x} >= 0.1 THEN 'Warning' ELSE 'Normal' END"
_edges = ", ".join(str(i / 10) for i in range(11))
_run = f"""WITH {_features}, {_l}, {_kinds}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{_edges}]))) AS e FROM l WHERE side = 0 GROUP BY 1),
bi AS (SELECT feature, side, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS bin FROM l JOIN e USING (feature) WHERE v BETWEEN e[1] AND e[-1]),
bc AS (SELECT feature, bin, count_if(side = 0) AS a, count_if(side = 1) AS b FROM bi GROUP BY 1, 2),
xy AS (SELECT feature, CASE WHEN coalesce(a, 0) = 0 THEN 1e-6::DOUBLE ELSE a::DOUBLE END AS x, CASE WHEN coalesce(b, 0) = 0 THEN 1e-6::DOUBLE ELSE b::DOUBLE END AS y FROM (SELECT feature, unnest(range(1, len(e))) AS bin FROM e) LEFT JOIN bc USING (feature, bin)),
pp AS (SELECT feature, x / sum(x) OVER (PARTITION BY feature) AS x, y / sum(y) OVER (PARTITION BY feature) AS y FROM xy), ps AS (SELECT feature, {R('abs(sum((y - x) * ln(y / x)))', 6)} AS psi FROM pp GROUP BY 1),
mo AS (SELECT feature, {R('avg(v) FILTER (side = 0)', 4)} AS base_mean, {R('stddev_samp(v) FILTER (side = 0)', 4)} AS base_std, {R('avg(v) FILTER (side = 1)', 4)} AS now_mean, {R('stddev_pop(v) FILTER (side = 1)', 4)} AS now_std FROM l GROUP BY 1 HAVING count(*) FILTER (side = 1) >= 30),
rows AS (SELECT feature, psi, CAST(NULL AS DOUBLE) AS max_shift, base_mean, base_std, now_mean, now_std, {_severity('psi')} AS severity FROM mo JOIN ps USING (feature) UNION ALL SELECT feature, NULL, {R('max(abs(now_share - base_share))', 6)}, NULL, NULL, NULL, NULL, {_severity('max(abs(now_share - base_share))')} FROM sh GROUP BY 1),
al AS (SELECT *, CASE max(CASE severity WHEN 'Critical' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END) OVER () WHEN 2 THEN 'Critical' WHEN 1 THEN 'Warning' ELSE 'Normal' END AS overall FROM rows) """


def drift_report(t: Tables) -> DataFrame:
    out = drift.run(t.base, t.now, DRIFT_NUMBERS, DRIFT_KINDS)
    return rounded(rounded(out, "base_mean", "base_std", "now_mean", "now_std"), "psi", "max_shift", digits=6)


def category_shares(t: Tables) -> DataFrame:
    rows = drift.shares(drift.both_sides(t.base, t.now, (), DRIFT_KINDS).drop("v"))
    return rounded(rows.withColumn("max_shift", F.max("shift").over(drift.Window.partitionBy("feature"))), "base_share", "now_share", "shift", "max_shift")


def baseline(t: Tables) -> DataFrame:
    """Mean and sample deviation of numbers, shares of kinds."""
    values = drift.both_sides(t.base, t.base.limit(0), NUM, CAT)
    m = drift.moments(values.filter("v IS NOT NULL")).select("feature", F.lit(None).cast("string").alias("kind"), f.rnd(C("base_mean"), 4).alias("mean"), f.rnd(C("base_std"), 4).alias("std"), F.lit(None).cast("double").alias("share"))
    return m.unionByName(drift.shares(values.filter("kind IS NOT NULL")).select("feature", "kind", f.rnd(C("base_share"), 6).alias("share")), allowMissingColumns=True)


_share = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS kind, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, {R('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 6)} AS share FROM sub WHERE k % 2 = 0 GROUP BY {c}" for c in CAT)
_base = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(NULL AS VARCHAR) AS kind, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, CAST(NULL AS DOUBLE) AS share FROM sub WHERE k % 2 = 0" for c in NUM)
many(
    ("drift_run", drift_report, _run + "SELECT * FROM al"),
    ("drift_sev", lambda t: drift_report(t).select("feature", "severity", "overall"), _run + "SELECT feature, severity, overall FROM al"),
    ("drift_cat", category_shares, f"WITH {_features}, {_kinds} SELECT feature, kind, {R('base_share', 4)} AS base_share, {R('now_share', 4)} AS now_share, {R('abs(now_share - base_share)', 4)} AS shift, {R('max(abs(now_share - base_share)) OVER (PARTITION BY feature)', 4)} AS max_shift FROM sh"),
    ("base_stats", baseline, f"SELECT * FROM ({_base} UNION ALL {_share})"),
)
