"""Scores, recommendations, evaluations and KPIs with all their columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as f
from ..functions import rules
from ..operators import clean, evaluate, stats
from ..operators.gold import bundled, levels, mean, money
from ..operators.ranks import quantiles_of
from .queries import CL, CLEANED, HIGH, RISK, STAR, A, C, D, P, R, Tables, count, long_sql, many, star


def _case(cases, otherwise: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v!r}' for c, v in cases)} ELSE {otherwise} END"


p = "churn_probability"
LEVELS_SQL = (
    f"CAST({p} >= 0.61 AS INT) AS churn_prediction, {_case([*((f'{p} >= {low}', name) for low, name, _ in rules.MODEL_LEVELS), (f'{p} >= 0.61', rules.ABOVE_THRESHOLD[0])], repr(rules.BELOW_THRESHOLD))} AS risk_level, "
    f"""{_case([*((f'{p} >= {low}', sure) for low, _, sure in rules.MODEL_LEVELS), (f'{p} >= 0.61', rules.ABOVE_THRESHOLD[1])], f"CASE WHEN {p} < 0.15 THEN 'High' ELSE 'Medium' END")} AS confidence"""
)
#: What a row gets at ingestion.
BUNDLE = ("churn_prediction", "risk_level", "confidence", "predicted_ltv", "projected_future_ltv", "intelligence_score", "customer_segment", "primary_recommendation", "recommendation_priority", "estimated_revenue_saved", "rfm_persona")
_offer = lambda i: _case([(f"{p} >= {o[0]}", o[i]) for o in rules.INGEST_OFFERS[:-1]], repr(rules.INGEST_OFFERS[-1][i]))
_saved = f"CASE WHEN {p} >= 0.61 THEN monthly_charges * 12.0::DOUBLE * 0.7::DOUBLE WHEN {p} >= 0.4 THEN monthly_charges * 6.0::DOUBLE * 0.5::DOUBLE ELSE 0.0::DOUBLE END"
BUNDLE_SQL = (
    f"{LEVELS_SQL}, {R('monthly_charges * greatest(1, tenure_months)', 2)} AS predicted_ltv, {R(f'monthly_charges * 24.0::DOUBLE * (1.0::DOUBLE - {p})', 2)} AS projected_future_ltv, {R(f'(1.0::DOUBLE - {p}) * 100.0::DOUBLE', 1)} AS intelligence_score, "
    "CASE WHEN monthly_charges >= 80 AND greatest(1, tenure_months) >= 24 THEN 'High-Value Subscribers' WHEN greatest(1, tenure_months) >= 36 THEN 'Loyal Subscribers' WHEN monthly_charges < 45 THEN 'Budget Subscribers' ELSE 'Growth Subscribers' END AS customer_segment, "
    f"{_offer(1)} AS primary_recommendation, {_offer(2)} AS recommendation_priority, {R(_saved, 2)} AS estimated_revenue_saved, CASE WHEN monthly_charges > 70 THEN 'High Spender' ELSE 'Regular Subscriber' END AS rfm_persona"
)


def with_reasons(gold: DataFrame) -> DataFrame:
    """Every recommendation of each subscriber in order, with confidence, reasons and what it saves."""
    texts = F.array(*(F.array(*(F.format_string(x, P() * 100, C("predicted_ltv"), C("total_services")) for x in of)) for of in rules.REASONS))
    rows = gold.select("customer_id", texts.alias("texts"), F.posexplode(f.recommendations(P(), C("predicted_ltv"))).alias("place", "x"))
    reasons = F.element_at("texts", C("x.rule").cast("int"))
    return rows.select("customer_id", "place", "x.rule", "x.recommendation", "x.priority", C("x.confidence").cast("double").alias("confidence"), F.array_join(reasons, "; ").alias("reasons"), "x.saved")


_texts = [" || '; ' || ".join("'" + x.replace("%%", "%").replace("%1$.1f", f"' || format('{{:.1f}}', {p} * 100) || '").replace("%2$.2f", "' || format('{:.2f}', predicted_ltv) || '").replace("%3$d", "' || total_services || '") + "'" for x in of) for of in rules.REASONS]
_confidence = " ".join(f"WHEN {i + 1} THEN {p if c is None else f'{c}::DOUBLE'}" for i, (_, _, c, _) in enumerate(rules.RECOMMENDATIONS))
_quadrants = " ".join(f"WHEN {p} {'>=' if risk else '<'} 0.5 AND predicted_ltv {'>=' if value else '<'} 1000 THEN {'; '.join(of)!r}" for (risk, value), of in rules.QUADRANTS.items())


def quadrant() -> Column:
    risk, value = P() >= 0.5, C("predicted_ltv") >= 1000.0
    of = {k: F.array(*map(F.lit, v)) for k, v in rules.QUADRANTS.items()}
    return F.when(risk & value, of[True, True]).when(risk, of[True, False]).when(value, of[False, True]).otherwise(of[False, False])


def roi(t: Tables) -> DataFrame:
    """The ranked strategies with what they retain and their return in percent of their cost."""
    rows = stats.strategies(t.sub).join(t.sub.select("customer_id", (C("monthly_charges") * 12.0).alias("annual"), P()), "customer_id")
    kept = f.rnd(C("retention") * C("annual"), 2)
    gain = C("net") - C("annual") * (1.0 - P())
    percent = F.when(C("cost") > 0, f.rnd(gain / F.greatest(F.lit(1.0), C("cost")) * 100.0, 1)).otherwise(0.0)
    return rows.select("customer_id", "strategy", "cost", "retention", kept.alias("retained"), "net", percent.alias("roi_percent"), "place")


def discounts(t: Tables) -> DataFrame:
    rows = t.gold.agg(F.count_if(HIGH()).alias("high"), F.count("*").alias("every"), mean("predicted_ltv", 2).alias("l"), mean("monthly_charges", 2).alias("m"))
    rows = rows.select(F.explode(F.array(*map(F.lit, (5, 10, 15, 20)))).alias("discount"), F.when(C("high") > 0, C("high")).otherwise(C("every")).alias("n"), "l", "m")
    saved, cost = C("n") * C("l") * 0.35, C("n") * C("m") * (C("discount") / 100.0) * 12
    return rows.select("discount", "n", f.rnd(saved, 2).alias("saved"), f.rnd(cost, 2).alias("cost"), f.rnd(saved / F.greatest(cost, F.lit(1.0)), 2).alias("multiple"))


many(
    ("tier_model", lambda t: t.sub.select("customer_id", *(c.alias(n) for n, c in levels(P()).items())), f"SELECT customer_id, {LEVELS_SQL} FROM sub"),
    ("score_bundle", lambda t: bundled(t.sub).select("customer_id", *BUNDLE), f"SELECT customer_id, {BUNDLE_SQL} FROM sub"),
    ("score_light", lambda t: bundled(t.sub).select("customer_id", P(), "churn_prediction", "risk_level", F.lit("Standard").alias("segment"), "predicted_ltv", "intelligence_score", F.when(HIGH(), "Proactive Retention").otherwise("Standard Support").alias("action")), f"SELECT customer_id, {p}, churn_prediction, risk_level, 'Standard' AS segment, predicted_ltv, intelligence_score, CASE WHEN {p} >= 0.61 THEN 'Proactive Retention' ELSE 'Standard Support' END AS action FROM (SELECT customer_id, {p}, {BUNDLE_SQL} FROM sub)"),
    ("rec_rules", lambda t: with_reasons(t.gold), f"SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rank, rule) - 1 AS INT) AS place, rule, recommendation, priority, CASE rule {_confidence} END AS confidence, CASE rule {' '.join(f'WHEN {i + 1} THEN {x}' for i, x in enumerate(_texts))} END AS reasons, saved FROM recs JOIN (SELECT customer_id, {p}, predicted_ltv, total_services FROM eng2) USING (customer_id)"),
    ("rec_quadrant", lambda t: t.gold.select("customer_id", F.array_join(quadrant(), "; ").alias("actions")), f"SELECT customer_id, CASE {_quadrants} END AS actions FROM gold"),
    ("rec_driver", lambda t: t.sub.select("customer_id", F.when(P() >= 0.4, f.chain(((C("contract_type") == "Month-to-month", "Month-to-month contract structure"), (C("tenure_months") <= 6, "Short subscriber tenure")), "High monthly fee sensitivity")).alias("driver")), f"SELECT customer_id, CASE WHEN {p} < 0.4 THEN NULL WHEN contract_type = 'Month-to-month' THEN 'Month-to-month contract structure' WHEN tenure_months <= 6 THEN 'Short subscriber tenure' ELSE 'High monthly fee sensitivity' END AS driver FROM sub"),
    ("roi_rank", roi, f"SELECT customer_id, strategy, cost, retention, {R('retention * annual', 2)} AS retained, net, CASE WHEN cost > 0 THEN {R(f'(net - annual * (1.0::DOUBLE - {p})) / greatest(1.0::DOUBLE, cost) * 100.0::DOUBLE', 1)} ELSE 0.0 END AS roi_percent, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, strategy) AS INT) AS place FROM roi JOIN (SELECT customer_id, {p}, monthly_charges * 12.0::DOUBLE AS annual FROM sub) USING (customer_id)"),
    ("roi_segment", discounts, f"SELECT discount, n, {R('n * l * 0.35::DOUBLE', 2)} AS saved, {R('n * m * (discount / 100.0::DOUBLE) * 12', 2)} AS cost, {R('n * l * 0.35::DOUBLE / greatest(n * m * (discount / 100.0::DOUBLE) * 12, 1.0::DOUBLE)', 2)} AS multiple FROM (SELECT unnest([5, 10, 15, 20]) AS discount, CASE WHEN high > 0 THEN high ELSE every_one END AS n, l, m FROM (SELECT count_if({p} >= 0.61) AS high, count(*) AS every_one, {A('predicted_ltv', 2)} AS l, {A('monthly_charges', 2)} AS m FROM gold))"),
    ("ltv_total", lambda t: t.sub.select("customer_id", f.rnd(C("total_charges") + f.remaining_months(P(), C("tenure_months")) * C("monthly_charges"), 2).alias("ltv"), f.rnd(f.remaining_months(P(), C("tenure_months")) * C("monthly_charges"), 2).alias("projected"), f.rnd(f.remaining_months(P(), C("tenure_months")), 1).alias("months")), f"SELECT customer_id, {R('total_charges + r * monthly_charges', 2)} AS ltv, {R('r * monthly_charges', 2)} AS projected, {R('r', 1)} AS months FROM (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE / greatest(0.01::DOUBLE, {p}) - tenure_months) AS r FROM sub)"),
)


# evaluation
def errors(t: Tables) -> DataFrame:
    rows = t.sub.withColumn("error", F.when(C("churn") == 1, "FN").otherwise("FP")).filter((P() >= 0.5).cast("int") != C("churn"))
    out = rows.groupBy("error").agg(F.count("*").alias("n"), F.avg("tenure_months").alias("avg_tenure"), mean("monthly_charges", 2).alias("avg_monthly"))
    for c in ("contract_type", "internet_service", "payment_method"):
        out = out.join(stats.modes(rows, "error", c), "error")
    return out


def regression(t: Tables) -> DataFrame:
    """Errors of the value against the charges so far; zero targets have no share of an error."""
    x, y = C("predicted_ltv"), C("total_charges")
    m = t.gold.agg(mean(y, 4).alias("m"))
    rows = t.gold.withColumn("m", m.scalar())
    gap, off = (x - y) * (x - y), (y - C("m")) * (y - C("m"))
    return rows.agg(f.rnd(F.sqrt(mean(gap, 4)), 4).alias("rmse"), f.rnd(mean(F.abs(x - y), 4), 4).alias("mae"), f.rnd(F.coalesce(mean(F.when(y != 0, F.abs((y - x) / y)), 6), F.lit(0.0)) * 100.0, 4).alias("mape"), f.rnd(1 - F.try_divide(money(gap, 4), money(off, 4)), 6).alias("r2"))


_yes = f"{p} >= 0.5"
_confusion = f"SELECT count(*)::DOUBLE AS n, count_if(churn = 1 AND {_yes})::DOUBLE AS tp, count_if(churn = 0 AND NOT {_yes})::DOUBLE AS tn, count_if(churn = 0 AND {_yes})::DOUBLE AS fp, count_if(churn = 1 AND NOT {_yes})::DOUBLE AS fn, {A(f'({p} - churn) * ({p} - churn)', 12)} AS brier FROM sub"
_agree = "((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)"
_measures = (
    ("accuracy", "(tp + tn) / n"), ("precision", "tp / (tp + fp)"), ("recall", "tp / (tp + fn)"), ("f1", "2 * tp / (2 * tp + fp + fn)"), ("balanced", "(tp / (tp + fn) + tn / (tn + fp)) / 2"),
    ("mcc", "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"), ("kappa", f"((tp + tn) / n - {_agree}) / (1 - {_agree})"), ("brier", "brier"),
)
_modes = ", ".join(f"(SELECT {c} FROM er r WHERE r.error = er0.error GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in ("contract_type", "internet_service", "payment_method"))
_auc = f"SELECT churn, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE AS r FROM sub"
_ap = f"SELECT sum(a * ta / tn) / sum(a) AS ap FROM (SELECT a, sum(a) OVER (ORDER BY s DESC)::DOUBLE AS ta, sum(n) OVER (ORDER BY s DESC)::DOUBLE AS tn FROM (SELECT {p} AS s, sum(churn) AS a, count(*) AS n FROM sub GROUP BY 1))"
_sweep = f"sw AS (SELECT th, count_if(churn = 1 AND b >= th) AS tp, count_if(churn = 0 AND b >= th) AS fp, count_if(churn = 1 AND b < th) AS fn FROM (SELECT unnest(range(1, 100)) AS th), (SELECT CAST(floor({p} * 100) AS BIGINT) AS b, churn FROM sub) GROUP BY 1), sr AS (SELECT th, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1 FROM sw)"
many(
    ("ev_class", lambda t: evaluate.classification(t.sub, P() >= 0.5, C("churn")), f"SELECT {', '.join(f'{R(x, 6)} AS {n}' for n, x in _measures)} FROM ({_confusion})"),
    ("ev_auc", lambda t: evaluate.areas(t.sub, p, "churn"), f"SELECT {R('(sum(r) FILTER (churn = 1) - count_if(churn = 1) * (count_if(churn = 1) + 1) / 2.0::DOUBLE) / (count_if(churn = 1)::DOUBLE * count_if(churn = 0))', 6)} AS auc, {R('any_value(ap)', 6)} AS average_precision FROM ({_auc}), ({_ap})"),
    ("ev_threshold", lambda t: evaluate.sweep(t.sub, P(), C("churn")), f"WITH {_sweep} SELECT th, tp, fp, {R('precision', 6)} AS precision, {R('recall', 6)} AS recall, {R('f1', 6)} AS f1, row_number() OVER (ORDER BY f1 DESC, th) = 1 AS best FROM sr"),
    ("ev_errors", errors, f"WITH er AS (SELECT *, CASE WHEN churn = 1 THEN 'FN' ELSE 'FP' END AS error FROM sub WHERE CAST({_yes} AS INT) <> churn) SELECT error, count(*) AS n, avg(tenure_months) AS avg_tenure, {A('monthly_charges', 2)} AS avg_monthly, {_modes} FROM er er0 GROUP BY error"),
    ("ev_regress", regression, f"SELECT {R('sqrt(' + A('(predicted_ltv - total_charges) * (predicted_ltv - total_charges)', 4) + ')', 4)} AS rmse, {R(A('abs(predicted_ltv - total_charges)', 4), 4)} AS mae, {R('coalesce(' + A('CASE WHEN total_charges <> 0 THEN abs((total_charges - predicted_ltv) / total_charges) END', 6) + ', 0.0) * 100.0::DOUBLE', 4)} AS mape, {R('1 - ' + D('(predicted_ltv - total_charges) * (predicted_ltv - total_charges)', 4) + ' / ' + D('(total_charges - m) * (total_charges - m)', 4), 6)} AS r2 FROM gold, (SELECT {A('total_charges', 4)} AS m FROM gold)"),
)


# KPIs, logs, cleaning counts
def executive(t: Tables) -> DataFrame:
    return t.gold.agg(
        F.count("*").alias("customers"), F.count_if(HIGH()).alias("high_risk"), F.try_divide(F.count_if(HIGH()), F.count("*")).alias("high_risk_rate"), mean(p).alias("avg_p"), f.rnd(mean("intelligence_score"), 4).alias("avg_score"),
        mean("predicted_ltv", 2).alias("avg_ltv"), money(RISK(), 4).alias("ltv_at_risk"), money("estimated_revenue_saved", 2).alias("savings"), F.count_distinct("customer_segment").alias("segments"),
    )


def brief(t: Tables) -> DataFrame:
    largest = count(t.gold, "customer_segment").agg(F.min_by("customer_segment", F.struct(-C("n"), "customer_segment")).alias("x"))
    out = t.gold.agg(F.coalesce(money(F.when(HIGH(), RISK()), 4), F.lit(0.0)).alias("exposure"), F.count_if(C("recommendation_priority") == "Critical").alias("critical"))
    return out.withColumn("largest_segment", largest.scalar())


def shares(t: Tables) -> DataFrame:
    """Label rate, mean risk and urgent recommendations, with the share of each segment and persona; one row a share."""
    rows = stats.long(t.gold, ("customer_segment", "rfm_persona"), "string").groupBy("name", "v").agg(F.count("*").alias("n"))
    rows = rows.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy("name"))).drop("n")
    whole = t.gold.agg(F.avg("churn").alias("label_rate"), mean(p).alias("avg_p"), F.count_if(C("recommendation_priority") == "Critical").alias("critical"), F.count_if(C("recommendation_priority") == "High").alias("high"))
    return rows.join(F.broadcast(whole), how="cross")  # one row


def segment_profile(t: Tables) -> DataFrame:
    rows = t.gold.groupBy("customer_segment").agg(F.count("*").alias("n"), mean("predicted_ltv", 2).alias("avg_ltv"), mean("monthly_charges", 2).alias("avg_monthly"), F.avg("tenure_months").alias("avg_tenure"), mean(p).alias("avg_p"))
    rows = rows.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy()))
    for c in ("contract_type", "payment_method"):
        rows = rows.join(stats.modes(t.gold, "customer_segment", c), "customer_segment")
    return rows.withColumn("campaign", f.chain(((C("customer_segment") == s, x) for s, x in rules.CAMPAIGNS.items()), rules.CAMPAIGN))


def requests(t: Tables) -> DataFrame:
    """Requests, errors and latencies of each endpoint."""
    base = t.events.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(C("event_type") == "error").alias("errors"))
    return evaluate.latency(t.events, ["event_type"]).join(base, "event_type").withColumn("error_rate", C("errors") / C("requests"))


def watched(t: Tables) -> DataFrame:
    """The watch list by falling risk, then the targets of campaigns by falling savings; a sort by ranges, no limit."""
    of = lambda n, rows, by: rows.select(F.lit(n).alias("list"), F.lit(by).alias("by"), "customer_id", P(), "estimated_revenue_saved")
    rows = of("watch", t.gold.filter(P() >= rules.MEDIUM_RISK), 0).unionByName(of("campaign", t.gold, 1))
    order = F.when(C("by") == 0, P()).otherwise(C("estimated_revenue_saved"))
    return rows.orderBy("by", F.desc(order), "customer_id").drop("by")


def cleaning(t: Tables) -> DataFrame:
    """Counts of one cleaning run: rows, repeated ids, labels that are none, totals filled in, ids that are none, columns."""
    rows = clean.imputed(clean.first_of_each(clean.trimmed(clean.renamed(t.raw)), "customer_id", "row_no"))
    known = C("churn").isin("Yes", "No")
    out = rows.agg(F.count("*").alias("ids"), F.count_if(known).alias("final"), F.count_if(~known).alias("dropped"), F.count_if(known & (C("imputed") == 1)).alias("imputed"), F.count_if(F.lower("customer_id").isin("", "nan", "none", "null")).alias("invalid"))
    initial = t.raw.agg(F.count("*").alias("initial"))
    return out.withColumn("initial", initial.scalar()).select("initial", "final", "dropped", (C("initial") - C("ids")).alias("duplicates"), "imputed", "invalid", F.lit(len(t.raw.columns) - 1).cast("long").alias("columns"))


def bounds(t: Tables) -> DataFrame:
    """Bounds of the middle, and how many lie beyond them, of each number; one pass over the counted values."""
    rows = evaluate.running(stats.long(t.sub, NUMBERS, "double"), ["name"], "v")
    q = quantiles_of(rows, ["name"], {"a": 0.25, "b": 0.75}).select("name", (C("a") - 1.5 * (C("b") - C("a"))).alias("low"), (C("b") + 1.5 * (C("b") - C("a"))).alias("high"))
    out = rows.join(F.broadcast(q), "name").groupBy("name", "low", "high").agg(F.coalesce(F.sum(F.when((C("v") < C("low")) | (C("v") > C("high")), C("n"))), F.lit(0)).alias("outliers"), F.sum("n").alias("n"))
    return out.select("name", f.rnd(C("low"), 6).alias("low"), f.rnd(C("high"), 6).alias("high"), "outliers", f.rnd(C("outliers") * 100.0 / C("n"), 4).alias("percent"))


def rates(t: Tables) -> DataFrame:
    """Churn rate by kind, and of short and long tenure."""
    rows = t.sub.withColumn("tenure", F.when(C("tenure_months") <= 12, "<= 12").otherwise("> 12"))
    return stats.long(rows, KINDS, "string", "churn").groupBy("name", "v").agg(F.avg("churn").alias("rate"))


NUMBERS = ("tenure_months", "monthly_charges", "total_charges")
KINDS = ("gender", "contract_type", "internet_service", "payment_method", "tenure")
_kinds = long_sql(KINDS[:-1], "VARCHAR") + " UNION ALL SELECT k, 'tenure' AS name, CASE WHEN tenure_months <= 12 THEN '<= 12' ELSE '> 12' END AS v, churn FROM sub"
_latency = f"SELECT event_type, count(value) AS n, {R(A('value', 4), 4)} AS avg_value, max(v) FILTER (r = greatest(1, n * 50 // 100)) AS p50, max(v) FILTER (r = greatest(1, n * 95 // 100)) AS p95, max(v) FILTER (r = greatest(1, n * 99 // 100)) AS p99 FROM (SELECT event_type, value, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1"
_seg_modes = ", ".join(f"(SELECT {c} FROM gold g WHERE g.customer_segment = g0.customer_segment GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in ("contract_type", "payment_method"))
_campaign = _case([(f"customer_segment = '{s}'", x) for s, x in rules.CAMPAIGNS.items()], repr(rules.CAMPAIGN))
_iqr = " UNION ALL ".join(f"SELECT '{c}' AS name, {R('any_value(low)', 6)} AS low, {R('any_value(high)', 6)} AS high, count_if({c} < low OR {c} > high) AS outliers, {R(f'count_if({c} < low OR {c} > high) * 100.0::DOUBLE / count(*)', 4)} AS percent FROM sub, (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM sub))" for c in NUMBERS)
many(
    ("src_star", star, STAR),
    ("kpi_exec", executive, f"SELECT count(*) AS customers, count_if({p} >= 0.61) AS high_risk, count_if({p} >= 0.61) / count(*)::DOUBLE AS high_risk_rate, {A(p)} AS avg_p, {R(A('intelligence_score'), 4)} AS avg_score, {A('predicted_ltv', 2)} AS avg_ltv, {D(f'{p} * predicted_ltv', 4)} AS ltv_at_risk, {D('estimated_revenue_saved', 2)} AS savings, count(DISTINCT customer_segment) AS segments FROM gold"),
    ("kpi_brief", brief, f"SELECT coalesce({D(f'CASE WHEN {p} >= 0.61 THEN {p} * predicted_ltv END', 4)}, 0.0) AS exposure, count_if(recommendation_priority = 'Critical') AS critical, (SELECT customer_segment FROM gold GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS largest_segment FROM gold"),
    ("kpi_ltv", lambda t: t.gold.agg(money("projected_future_ltv", 2).alias("projected"), mean("projected_future_ltv", 2).alias("avg_projected"), money("predicted_ltv", 2).alias("historical"), mean("predicted_ltv", 2).alias("avg_historical"), (money("projected_future_ltv", 2) / (money("predicted_ltv", 2) + 1e-6)).alias("multiple")), f"SELECT {D('projected_future_ltv', 2)} AS projected, {A('projected_future_ltv', 2)} AS avg_projected, {D('predicted_ltv', 2)} AS historical, {A('predicted_ltv', 2)} AS avg_historical, {D('projected_future_ltv', 2)} / ({D('predicted_ltv', 2)} + 1e-6) AS multiple FROM gold"),
    ("rpt_execsum", shares, f"SELECT name, v, n / CAST(sum(n) OVER (PARTITION BY name) AS DOUBLE) AS share, label_rate, avg_p, critical, high FROM (SELECT 'customer_segment' AS name, customer_segment AS v, count(*) AS n FROM gold GROUP BY 2 UNION ALL SELECT 'rfm_persona', rfm_persona, count(*) FROM gold GROUP BY 2), (SELECT avg(churn) AS label_rate, {A(p)} AS avg_p, count_if(recommendation_priority = 'Critical') AS critical, count_if(recommendation_priority = 'High') AS high FROM gold)"),
    ("rpt_impact", lambda t: t.gold.agg(money(P() * C("total_charges"), 4).alias("at_risk"), money("estimated_revenue_saved", 2).alias("max_savings"), (money("estimated_revenue_saved", 2) * 0.5).alias("half_response"), F.count_if(P() >= 0.4).alias("targeted")), f"SELECT {D(f'{p} * total_charges', 4)} AS at_risk, {D('estimated_revenue_saved', 2)} AS max_savings, {D('estimated_revenue_saved', 2)} * 0.5 AS half_response, count_if({p} >= 0.4) AS targeted FROM gold"),
    ("grp_segprofile", segment_profile, f"SELECT customer_segment, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, {A('predicted_ltv', 2)} AS avg_ltv, {A('monthly_charges', 2)} AS avg_monthly, avg(tenure_months) AS avg_tenure, {A(p)} AS avg_p, {_seg_modes}, {_campaign} AS campaign FROM gold g0 GROUP BY customer_segment"),
    ("agg_audit", lambda t: count(t.events.withColumn("event_type", F.coalesce("event_type", F.lit("UNKNOWN"))), "event_type").withColumn("total", F.sum("n").over(Window.partitionBy())), "SELECT coalesce(event_type, 'UNKNOWN') AS event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY 1"),
    ("agg_metrics", requests, f"SELECT * FROM ({_latency}) JOIN (SELECT event_type, count(*) AS requests, count_if(event_type = 'error') AS errors, count_if(event_type = 'error') / count(*)::DOUBLE AS error_rate FROM events GROUP BY 1) USING (event_type)"),
    ("top_watch", watched, f"SELECT 'watch' AS list, customer_id, {p}, estimated_revenue_saved FROM gold WHERE {p} >= 0.4 UNION ALL SELECT 'campaign', customer_id, {p}, estimated_revenue_saved FROM gold"),
    ("clean_dedupe", lambda t: (lambda rows: rows.groupBy("customer_id").agg(F.min("row_no").alias("row_no"), (F.count("*") - 1).alias("removed")))(clean.trimmed(clean.renamed(t.raw))), CL + "customer_id, row_no, removed FROM u JOIN (SELECT customer_id, count(*) - 1 AS removed FROM t GROUP BY 1) USING (customer_id)"),
    ("clean_label", lambda t: t.raw.select("row_no", F.when(C("Churn") == "Yes", 1).when(C("Churn") == "No", 0).alias("churn"), (~C("Churn").isin("Yes", "No")).alias("dropped")), """SELECT row_no, CASE "Churn" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn, "Churn" NOT IN ('Yes', 'No') AS dropped FROM raw"""),
    ("clean_summary", cleaning, f"WITH {CLEANED} SELECT (SELECT count(*) FROM raw) AS initial, (SELECT count(*) FROM cl) AS final, (SELECT count(*) FROM u) - (SELECT count(*) FROM cl) AS dropped, (SELECT count(*) FROM raw) - (SELECT count(*) FROM u) AS duplicates, (SELECT CAST(sum(imputed) AS BIGINT) FROM cl) AS imputed, (SELECT count_if(lower(customer_id) IN ('', 'nan', 'none', 'null')) FROM u) AS invalid, 21::BIGINT AS columns"),
    ("stat_iqr", bounds, f"SELECT * FROM ({_iqr})"),
    ("stat_rate", rates, f"SELECT name, v, avg(churn) AS rate FROM ({_kinds}) GROUP BY 1, 2"),
)
