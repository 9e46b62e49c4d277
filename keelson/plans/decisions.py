"""Queries on scenarios, attributions, plans, feature checks, curves and latencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import decide, evaluate, models
from ..streaming import arrivals
from .queries import A, C, R, many

_text = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
_num = lambda x: f"CAST({x} AS DOUBLE)"
_scenarios = ", ".join(f"({_text(n)}, {_text(c)}, {_text(s)}, {_text(p)}, {_num(k)})" for n, c, s, p, k in rules.SCENARIOS)
_p_after = "ROUND(1 / (1 + EXP(-(-1.3::DOUBLE + CASE contract_type WHEN 'Month-to-month' THEN 1.1 WHEN 'Two year' THEN -1.2 ELSE 0 END - tenure_months * 0.03::DOUBLE + m * 0.01::DOUBLE + CASE WHEN internet_service = 'Fiber optic' THEN 0.5 ELSE 0 END - CASE WHEN tech_support = 'Yes' THEN 0.4 ELSE 0 END + CASE WHEN payment_method = 'Electronic check' THEN 0.3 ELSE 0 END))), 6)"
_what_if = f"""WITH w AS (SELECT customer_id, scenario, churn_probability AS before, tenure_months, internet_service, monthly_charges, coalesce(c, contract_type) AS contract_type, coalesce(s, tech_support) AS tech_support, coalesce(p, payment_method) AS payment_method, monthly_charges * f AS m FROM sub, (VALUES {_scenarios}) x(scenario, c, s, p, f)),
w1 AS (SELECT *, {_p_after} AS after FROM w),
w2 AS (SELECT *, {R('before - after', 4)} AS reduction, {R('m * 24.0::DOUBLE * (1.0::DOUBLE - after)', 2)} AS ltv_after, {R('monthly_charges * 24.0::DOUBLE * (1.0::DOUBLE - before)', 2)} AS ltv_before FROM w1)
SELECT customer_id, scenario, before, after, reduction, {R('reduction / greatest(0.01::DOUBLE, before) * 100.0::DOUBLE', 1)} AS reduction_pct, {R('ltv_after - ltv_before', 2)} AS ltv_change, {R('greatest(0.0::DOUBLE, reduction * ltv_after)', 2)} AS saved FROM w2"""
_sign = {"tenure_months": "<", "monthly_charges": ">"}
_impacts = " UNION ALL ".join(f"SELECT customer_id, {i} AS i, '{n}' AS feature, CASE WHEN {n} {_sign.get(n, '=')} {v if isinstance(v, int) else _text(v)} THEN {_num(a)} ELSE {_num(b)} END AS impact FROM sub" for i, (n, v, a, b) in enumerate(rules.IMPACTS))
_attr_rules = f"""WITH i AS ({_impacts}), o AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(impact) DESC, i) AS place FROM i),
c AS (SELECT *, 0.26::DOUBLE + sum(impact) OVER (PARTITION BY customer_id ORDER BY place) AS total, 0.26::DOUBLE + sum(impact) OVER (PARTITION BY customer_id) AS final FROM o)
SELECT customer_id, CAST(place AS INT) AS place, feature, impact, {R('total', 4)} AS cumulative, {R('greatest(0.01::DOUBLE, least(0.99::DOUBLE, final))', 4)} AS probability FROM c"""
_terms = {"contract_type": "CASE contract_type WHEN 'Month-to-month' THEN 1.1::DOUBLE WHEN 'Two year' THEN -1.2::DOUBLE ELSE 0.0::DOUBLE END", "tenure_months": "-(tenure_months * 0.03::DOUBLE)", "monthly_charges": "monthly_charges * 0.01::DOUBLE", "internet_service": "CASE WHEN internet_service = 'Fiber optic' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", "tech_support": "CASE WHEN tech_support = 'Yes' THEN -0.4::DOUBLE ELSE 0.0::DOUBLE END", "payment_method": "CASE WHEN payment_method = 'Electronic check' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"}
_linear = "WITH x AS (" + " UNION ALL ".join(f"SELECT customer_id, k, '{n}' AS feature, {x} AS x FROM sub" for n, x in _terms.items()) + f"), mean AS (SELECT feature, {A('x')} AS mean FROM x WHERE k % 2 = 0 GROUP BY 1), lin AS (SELECT customer_id, feature, {R('x - mean', 6)} AS impact FROM x JOIN mean USING (feature)), imp AS (SELECT feature, {R(A('abs(impact)'), 6)} AS importance FROM lin GROUP BY 1) "
_plan = lambda i: "CASE " + " ".join(f"WHEN churn_probability >= {_num(p[0])} THEN {_num(p[i]) if isinstance(p[i], float) else _text(p[i])}" for p in rules.ACTION_PLANS) + " END"
_steps = "CASE " + " ".join(f"WHEN churn_probability >= {_num(p[0])} THEN {_text(' | '.join(p[-1]))}" for p in rules.ACTION_PLANS) + " END"
_errors = " UNION ALL ".join(
    [f"SELECT customer_id, '{n}' AS feature, CASE WHEN {n} IS NULL THEN 'missing' WHEN TRY_CAST({n} AS DOUBLE) IS NULL THEN 'not numeric' WHEN TRY_CAST({n} AS DOUBLE) < {lo} THEN 'below range' WHEN TRY_CAST({n} AS DOUBLE) > {hi} THEN 'above range' END AS error FROM fed" for n, (lo, hi) in rules.FEATURE_RANGES.items()]
    + [f"SELECT customer_id, '{n}', CASE WHEN {n} IS NULL THEN 'missing' WHEN {n} NOT IN ({', '.join(map(_text, v))}) THEN 'not allowed' END FROM fed" for n, v in rules.FEATURE_VALUES.items()]
)


def _fed(t):
    """Subscribers with gender and totals as the raw rows have them."""
    raw = t.raw.filter("row_no % 2 = 0").select((C("row_no") / 2).cast("long").alias("k"), "gender", F.trim("TotalCharges").alias("total_charges"))
    return t.sub.drop("gender", "total_charges").join(raw, "k")


def _ranked(t):
    rows = decide.importance(decide.linear_impacts(t.now, t.base))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).filter("place <= 15")


many(
    ("whatif", lambda t: decide.what_if(t.sub), _what_if),
    ("attr_rules", lambda t: decide.rule_impacts(t.sub), _attr_rules),
    ("attr_linear", lambda t: decide.linear_impacts(t.sub, t.base), _linear + "SELECT * FROM lin"),
    ("attr_global", lambda t: _ranked(t), _linear.replace("FROM x JOIN mean USING (feature)", "FROM x JOIN mean USING (feature) WHERE k % 2 = 1") + "SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS place FROM imp"),
    ("win_running", lambda t: _ranked(t).select("feature", F.sum(C("importance").cast("decimal(18,6)")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("total")), _linear.replace("FROM x JOIN mean USING (feature)", "FROM x JOIN mean USING (feature) WHERE k % 2 = 1") + "SELECT feature, CAST(sum(CAST(importance AS DECIMAL(18,6))) OVER (ORDER BY importance DESC, feature) AS DOUBLE) AS total FROM imp"),
    ("rec_plan", lambda t: decide.action_plan(t.sub).withColumn("steps", F.array_join("steps", " | ")), f"SELECT customer_id, {_plan(1)} AS risk_level, {_plan(2)} AS confidence, {_plan(3)} AS action, {_plan(4)} AS offer_code, {R(f'monthly_charges * {_plan(5)} * {_plan(6)}', 2)} AS recoverable, {_steps} AS steps FROM sub"),
    ("rec_retplan", lambda t: decide.retention_plan(t.sub).withColumn("actions", F.array_join("actions", " | ")), f"WITH c AS (SELECT *, CASE WHEN churn_probability >= 0.61 THEN {_text(rules.CONTACT[True])} ELSE {_text(rules.CONTACT[False])} END AS priority FROM sub) SELECT customer_id, priority, CASE WHEN churn_probability >= 0.61 THEN 'CRITICAL' WHEN churn_probability >= 0.40 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, replace(replace({_text(' | '.join(rules.PLAN_ACTIONS))}, '{{contract}}', contract_type), '{{priority}}', priority) AS actions, replace({_text(rules.PLAN_MESSAGE)}, '{{tenure}}', CAST(tenure_months AS VARCHAR)) AS message FROM c"),
    ("dq_feature", lambda t: decide.feature_errors(_fed(t)), f"WITH fed AS (SELECT sub.* EXCLUDE (gender, total_charges), raw.gender, trim(raw.\"TotalCharges\") AS total_charges FROM sub JOIN raw ON raw.row_no = sub.k * 2) SELECT * FROM ({_errors}) WHERE error IS NOT NULL"),
    ("ev_curves", lambda t: evaluate.curves(t.sub, "churn_probability", "churn"), "WITH g AS (SELECT churn_probability AS score, count_if(churn = 1) AS a, count_if(churn = 0) AS b FROM sub GROUP BY 1), h AS (SELECT score, CAST(sum(a) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(b) OVER (ORDER BY score DESC) AS BIGINT) AS fp, CAST(sum(a) OVER () AS DOUBLE) AS pos, CAST(sum(b) OVER () AS DOUBLE) AS neg FROM g) SELECT score, tp, fp, tp / pos AS tpr, fp / neg AS fpr, tp / CAST(tp + fp AS DOUBLE) AS precision FROM h"),
    ("agg_latency", lambda t: evaluate.picked_latency(t.events, ["event_type"]), f"WITH l AS (SELECT event_type, list_sort(list(CAST(value AS DOUBLE))) AS v, count(value) AS n, {R(A('value', 4), 2)} AS avg FROM events GROUP BY 1) SELECT event_type, n, avg, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median, v[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1] AS p99, v[1] AS least, v[-1] AS most FROM l"),
)


def _fits(names: str, fit):
    """A table of what fits on the subscribers gave; a fit has no SQL."""
    return lambda t: t.spark.createDataFrame(fit(t.sub), names)


many(
    ("st_predlog", lambda t: arrivals.by_day(t.events).withColumns({"day": C("day").cast("date"), "total": C("total").cast("double")}), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"),
    ("ml_split", lambda t: models.split(t.sub)[1].select("customer_id", "churn"), None),
    ("ml_compare", _fits("model string, auc double, accuracy double, f1 double", lambda sub: models.compare(sub)[1]), None),
    ("ml_ltv", _fits("model string, r2 double, rmse double, mae double", models.value_models), None),
    ("ml_kmeans", lambda t: models.segments(t.sub)[2].select("customer_id", "cluster", "segment"), None),
)
