"""Queries on incoming tables, messages, drift by day and model runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as f
from ..functions import rules
from ..operators import clean, decide, drift, folds, models, runs, stats
from .decisions import _fits, _num, _text
from .queries import CAT, C, R, long_sql, many

STAMP = "1704067200"
TONE = "Professional"
_shown = ("customer_id", "monthly_charges", "predicted_ltv", "r_score", "customer_segment")
_vector = ("tenure_months", "monthly_charges", "total_charges", "total_services", "is_auto_payment")


def _incoming(t):
    """Subscribers with what incoming rows get wrong: no id, negative months, totals as raw text, an unknown answer."""
    raw = t.raw.filter("row_no % 2 = 0").select((C("row_no") / 2).cast("long").alias("k"), F.trim("TotalCharges").alias("total_charges"))
    rows = t.sub.drop("total_charges").join(raw, "k")
    return rows.withColumns({"customer_id": F.when(C("k") % 83 != 0, C("customer_id")), "tenure_months": F.when(C("k") % 89 == 0, -1).otherwise(C("tenure_months")), "paperless_billing": F.when(C("k") % 97 == 0, "Maybe").otherwise(C("paperless_billing"))})


_incoming_sql = """incoming AS (SELECT sub.k, CASE WHEN k % 83 <> 0 THEN customer_id END AS customer_id, CASE WHEN k % 89 = 0 THEN -1 ELSE tenure_months END AS tenure_months, monthly_charges, trim(raw."TotalCharges") AS total_charges, contract_type, CASE WHEN k % 97 = 0 THEN 'Maybe' ELSE paperless_billing END AS paperless_billing, internet_service, tech_support FROM sub JOIN raw ON raw.row_no = sub.k * 2)"""


def _refused(c: str) -> str:
    kind, low, allowed = rules.MODEL_INPUT[c]
    number = f"TRY_CAST({c} AS {kind})"
    more = (f" WHEN {number} IS NULL THEN 'type' WHEN {number} < {low} THEN 'range'" if low is not None else "") + (f" WHEN {c} NOT IN ({', '.join(map(_text, allowed))}) THEN 'domain'" if allowed else "")
    return f"SELECT k, '{c}' AS \"column\", CASE WHEN {c} IS NULL THEN 'missing'{more} END AS \"check\", CAST({c} AS VARCHAR) AS value FROM incoming"


_absent = ", ".join(f"{v if isinstance(v, int) else _num(v) if isinstance(v, float) else _text(v)} AS {c}" for c, v in rules.COLUMN_DEFAULTS.items() if c not in ("tenure_months", "contract_type"))
_mi = f"c AS (SELECT name, v, churn, count(*) AS n FROM ({long_sql((*CAT, 'tenure_months'), 'VARCHAR')}) GROUP BY 1, 2, 3), m AS (SELECT name, n, sum(n) OVER (PARTITION BY name, v) AS a, sum(n) OVER (PARTITION BY name, churn) AS b, sum(n) OVER (PARTITION BY name) AS s FROM c), mi AS (SELECT name, {R('sum(n / s::DOUBLE * ln(n::DOUBLE * s / (a::DOUBLE * b)))', 6)} AS mi FROM m GROUP BY 1)"


def _message_sql() -> str:
    subject, greeting, close = rules.TONES[TONE]
    # printf of DuckDB has no numbered arguments: values take the place of their marks
    put = lambda s, *values: _fold(s, values)
    own = ("customer_id", "CAST(tenure_months AS VARCHAR)")
    body = ("CAST(tenure_months AS VARCHAR)", "contract_type", "strategy", "printf('%.2f', monthly_charges)", f"printf('%.2f', monthly_charges * 12.0::DOUBLE * {_num(rules.OUTREACH_SAVING)})")
    best = "best AS (SELECT customer_id, strategy FROM roi QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, strategy) = 1)"
    return f"WITH {best} SELECT customer_id, '{TONE}' AS tone, {R('churn_probability * 100.0::DOUBLE', 1)} AS churn_pct, predicted_ltv, strategy, {put(subject, *own)} AS subject, concat({put(greeting, *own)}, chr(10), chr(10), {put(rules.OUTREACH, *body)}, chr(10), chr(10), {_text(close)}) AS body, {R(f'predicted_ltv * {_num(rules.OUTREACH_LTV)}', 2)} AS saved FROM eng2 JOIN best USING (customer_id)"


def _fold(template: str, values) -> str:
    out = _text(template)
    for i, v in enumerate(values):
        for mark in (f"%{i + 1}$s", f"%{i + 1}$.2f"):
            out = f"replace({out}, '{mark}', {v})" if mark in template else out
    return out


def _days(t, column):
    """The events of the first week and those after it, with a number of the event."""
    rows = t.events.select(F.to_date("ts").alias("day"), C("value").cast("double").alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    cut = t.events.agg(F.date_add(F.min(F.to_date("ts")), 7).alias("cut"))
    return drift.by_day(rows.filter(C("day") < cut.scalar()), rows.filter(C("day") >= cut.scalar()), "day", column)


def _days_sql(column: str, value: str) -> str:
    return f"""WITH ev AS (SELECT CAST(ts AS DATE) AS day, CAST({value} AS DOUBLE) AS v, CAST(ts AS DATE) < (SELECT CAST(min(ts) AS DATE) + 7 FROM events) AS early FROM events),
ed AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM ev WHERE early),
bi AS (SELECT day, early, CASE WHEN v BETWEEN e[1] AND e[-1] THEN least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) END AS bin FROM ev, ed),
x0 AS (SELECT bin, count(*) AS n FROM bi WHERE early GROUP BY 1), y0 AS (SELECT day, bin, count(*) AS n FROM bi WHERE NOT early GROUP BY 1, 2),
grid AS (SELECT day, bin FROM (SELECT DISTINCT day FROM bi WHERE NOT early), (SELECT unnest(range(1, len(e))) AS bin FROM ed)),
xy AS (SELECT grid.day, coalesce(x0.n, 1e-6::DOUBLE) AS x, coalesce(y0.n, 1e-6::DOUBLE) AS y, coalesce(y0.n, 0) AS n FROM grid LEFT JOIN x0 USING (bin) LEFT JOIN y0 ON y0.bin = grid.bin AND y0.day = grid.day),
sh AS (SELECT day, x / sum(x) OVER (PARTITION BY day) AS x, y / sum(y) OVER (PARTITION BY day) AS y, n FROM xy),
trend AS (SELECT day, '{column}' AS feature, CASE WHEN sum(n) > 0 THEN abs(sum((y - x) * ln(y / x))) END AS psi, CAST(sum(n) AS BIGINT) AS n_now FROM sh GROUP BY 1)
"""


def _runs(t):
    return runs.table(runs.fitted_once(t.spark, t.sf_dir, t.sub.filter("k % 2 = 0"), t.sub))


_psi = "floor(psi * 1000000.0 + 0.5) / 1000000.0"
_halves = lambda t: (t.sub.filter("k % 2 = 0"), t.sub.filter("k % 2 = 1"))

many(
    ("id_detect", lambda t: clean.with_ids(t.raw, "row_no", STAMP).select(F.lit("found").alias("origin"), "row_no", "customer_id").union(clean.with_ids(t.raw.drop("customerID"), "row_no", STAMP).select(F.lit("made"), "row_no", "customer_id")), f"SELECT 'found' AS origin, row_no, trim(\"customerID\") AS customer_id FROM raw UNION ALL SELECT 'made', row_no, printf('TEL-{STAMP}-%04d', row_number() OVER (ORDER BY row_no) - 1) FROM raw"),
    ("feat_defaults_col", lambda t: clean.with_absent_columns(t.sub.select("customer_id", F.when(C("k") % 7 != 0, C("tenure_months")).alias("tenure_months"), "contract_type"), rules.COLUMN_DEFAULTS), f"SELECT customer_id, CASE WHEN k % 7 <> 0 THEN tenure_months END AS tenure_months, contract_type, {_absent} FROM sub"),
    ("feat_vector", lambda t: t.gold.select("customer_id", F.inline(F.array(*(F.struct(F.lit(i).alias("place"), C(c).cast("double").alias("value")) for i, c in enumerate(_vector))))), " UNION ALL ".join(f"SELECT customer_id, {i} AS place, CAST({c} AS DOUBLE) AS value FROM gold" for i, c in enumerate(_vector))),
    ("fmt_names", lambda t: t.gold.select(*(C(c).alias(clean.display_name(c)) for c in _shown)), 'SELECT customer_id AS "Customer ID", monthly_charges AS "Monthly Charges", predicted_ltv AS "Predicted LTV", r_score AS "R Score", customer_segment AS "Customer Segment" FROM gold'),
    ("dq_model", lambda t: clean.input_failures(_incoming(t), "k", rules.MODEL_INPUT), f"WITH {_incoming_sql} SELECT * FROM ({' UNION ALL '.join(map(_refused, rules.MODEL_INPUT))}) WHERE \"check\" IS NOT NULL"),
    ("win_last", lambda t: t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id")), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    ("win_segrank", lambda t: models.segment_ranks(t.sub.withColumn("cluster", (C("k") % 6).cast("int"))), f"WITH m AS (SELECT CAST(k % 6 AS INT) AS cluster, quantile_cont(total_charges, 0.5) AS median FROM sub GROUP BY 1), r AS (SELECT cluster, row_number() OVER (ORDER BY median DESC, cluster) AS i FROM m) SELECT cluster, CASE i {' '.join(f'WHEN {i + 1} THEN {_text(s)}' for i, s in enumerate(models.SEGMENTS))} ELSE concat('Budget Subscribers Class ', i - 3) END AS segment FROM r"),
    ("join_left", lambda t: stats.mutual_information(t.sub, (*CAT, "tenure_months"), "churn").select("name", f.rnd(C("mi"), 6).alias("mi")).join(stats.chi2(t.sub, CAT, "churn").select("name", f.rnd(C("chi2"), 6).alias("chi2"), "dof"), "name", "left"), f"WITH {_mi} SELECT name, mi, floor(chi2 * 1000000.0 + 0.5) / 1000000.0 AS chi2, dof FROM mi LEFT JOIN chi USING (name)"),
    ("rec_message", lambda t: decide.outreach(t.sub, TONE), _message_sql()),
    ("st_drift", lambda t: _days(t, "value").select("day", "feature", f.rnd(C("psi"), 6).alias("psi"), "n_now", drift.severity(C("psi")).alias("severity")), _days_sql("value", "value") + f"SELECT day, feature, {_psi} AS psi, n_now, CASE WHEN psi >= 0.25 THEN 'Critical' WHEN psi >= 0.10 THEN 'Warning' ELSE 'Normal' END AS severity FROM trend"),
    ("drift_trend", lambda t: _days(t, "k").select("day", "feature", f.rnd(C("psi"), 6).alias("psi")), _days_sql("k", "json_extract_string(props, '$.k')") + f"SELECT day, feature, {_psi} AS psi FROM trend"),
    ("ml_prep", lambda t: models.feature_arrays(t.sub), None),
    ("ml_classify", lambda t: models.classified(t.sub), None),
    ("ml_learning", _fits("fraction double, n_rows long, f1_fit double, f1_held double", models.learning_curve), None),
    ("ml_segapply", lambda t: models.assigned(*_halves(t)).select("customer_id", "cluster", "segment"), None),
    ("ml_retrain", lambda t: _runs(t).select("model", "version", "run", "status", "n_rows", F.explode("metrics").alias("metric", "value")), None),
    ("ml_cv", lambda t: folds.cross_validated(t.sub, [0.01]), None),
    ("ml_tune", lambda t: folds.cross_validated(t.sub, folds.draws(5), 3), None),
    ("agg_models", lambda t: models.version_counts(_runs(t)), None),
    ("join_metrics", lambda t: models.versions_compared(_runs(t), "churn", "v1", "v2"), None),
    ("top_modelrun", lambda t: models.picked_runs(_runs(t), {"churn": "auc", "ltv": "r2", "segmentation": "silhouette"}), None),
)
