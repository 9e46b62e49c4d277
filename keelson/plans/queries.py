"""The queries of the retention library and their DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as f
from ..functions import rules
from ..operators import clean, drift, evaluate, ranks, stats
from ..operators.gold import engineered, mean, money, scored
from ..sources.fixture import raw_subscribers, subscribers
from .oracle import with_views

C = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views a query may read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    sub = cached_property(lambda self: subscribers(self.spark, self.sf_dir))
    raw = cached_property(lambda self: raw_subscribers(self.sub))
    gold = cached_property(lambda self: scored(self.sub))
    events = cached_property(lambda self: self.read("events"))
    contracts = cached_property(lambda self: self.sub.select(C("k").alias("id"), "contract_type", "paperless_billing", "payment_method"))
    services = cached_property(lambda self: self.sub.select(C("k").alias("id"), "internet_service", *rules.SERVICES))
    billings = cached_property(lambda self: self.sub.select(C("k").alias("id"), "monthly_charges", "total_charges"))
    customers = cached_property(lambda self: self.sub.select(C("k").alias("id"), "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months", "churn", C("k").alias("contract_id"), C("k").alias("service_id"), C("k").alias("billing_id")))
    base = cached_property(lambda self: engineered(self.sub.filter("k % 2 = 0")))
    now = cached_property(lambda self: engineered(self.sub.filter("k % 2 = 1")))


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return plan

    return add


def count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def many(*entries) -> None:
    for name, plan, sql in entries:
        query(name, sql)(plan)


D = lambda x, digits=6: f"CAST(SUM(CAST({x} AS DECIMAL(18,{digits}))) AS DOUBLE)"
A = lambda x, digits=6: f"({D(x, digits)} / COUNT({x}))"
R = lambda x, n: f"(FLOOR(({x}) * {float(10**n)} + 0.5) / {float(10**n)})"
T3 = "CASE WHEN churn_probability >= 0.61 THEN 'High' WHEN churn_probability >= 0.4 THEN 'Medium' ELSE 'Low' END"
T4 = "CASE WHEN churn_probability >= 0.75 THEN 'Critical' WHEN churn_probability >= 0.61 THEN 'High' WHEN churn_probability >= 0.4 THEN 'Medium' ELSE 'Monitor' END"


def P():
    return C("churn_probability")


def HIGH():
    return P() >= rules.HIGH_RISK


def MEDIUM():
    return (P() >= rules.MEDIUM_RISK) & (P() < rules.HIGH_RISK)


def RISK():
    return P() * C("predicted_ltv")


def star(t: Tables) -> DataFrame:
    rows = t.customers.join(t.contracts.withColumnRenamed("id", "contract_id"), "contract_id").join(t.services.withColumnRenamed("id", "service_id"), "service_id")
    return rows.join(t.billings.withColumnRenamed("id", "billing_id"), "billing_id").select("customer_id", "tenure_months", "churn", "contract_type", "payment_method", "internet_service", "tech_support", "monthly_charges", "total_charges")


# sources, joins, features, tiers
STAR = "SELECT customer_id, tenure_months, churn, contract_type, payment_method, internet_service, tech_support, monthly_charges, total_charges FROM sub"
LOADED = lambda t: t.sub.filter("k % 3 = 0").select("customer_id")
many(
    ("join_star", star, STAR),
    ("src_ids", lambda t: t.raw.select(F.trim("customerID").alias("customer_id")).dropna().distinct(), 'SELECT DISTINCT trim("customerID") AS customer_id FROM raw WHERE "customerID" IS NOT NULL'),
    ("join_anti", lambda t: t.sub.join(LOADED(t), "customer_id", "left_anti").select("customer_id", "tenure_months"), "SELECT customer_id, tenure_months FROM sub WHERE k % 3 <> 0"),
    ("set_except", lambda t: t.sub.select("customer_id").subtract(LOADED(t)), "SELECT customer_id FROM sub EXCEPT SELECT customer_id FROM sub WHERE k % 3 = 0"),
    ("join_semi", lambda t: t.gold.join(t.events.select(C("user_id").alias("k")), "k", "left_semi").select("customer_id", "predicted_ltv"), "SELECT customer_id, predicted_ltv FROM gold WHERE k IN (SELECT user_id FROM events)"),
    ("join_fallback", lambda t: t.customers.select("customer_id").join(t.sub.filter("k % 3 = 0").select("customer_id", C("monthly_charges").alias("a")), "customer_id", "left").join(t.sub.filter("k % 2 = 0").select("customer_id", C("monthly_charges").alias("b")), "customer_id", "left").select("customer_id", F.coalesce("a", "b", F.lit(70.0)).alias("monthly_charges")), "SELECT customer_id, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN monthly_charges ELSE 70.0 END AS monthly_charges FROM sub"),
    ("join_outer", lambda t: count(t.base, "payment_method").join(count(t.now, "payment_method").withColumnRenamed("n", "m"), "payment_method", "full").select("payment_method", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")), "SELECT payment_method, COUNT(*) FILTER (k % 2 = 0) AS n, COUNT(*) FILTER (k % 2 = 1) AS m FROM sub GROUP BY 1"),
    ("set_keyunion", lambda t: t.base.select("tenure_group").union(t.now.select("tenure_group")).distinct(), "SELECT DISTINCT tenure_group FROM eng"),
    ("set_union", lambda t: t.base.select("customer_id", "tenure_months").unionByName(t.now.select("customer_id", "monthly_charges"), allowMissingColumns=True), "SELECT customer_id, CASE WHEN k % 2 = 0 THEN tenure_months END AS tenure_months, CASE WHEN k % 2 = 1 THEN monthly_charges END AS monthly_charges FROM sub"),
    ("set_distinct", lambda t: t.gold.select("customer_segment", "rfm_persona").distinct(), "SELECT DISTINCT customer_segment, rfm_persona FROM gold"),
    ("feat_services", lambda t: t.gold.select("customer_id", "total_services"), "SELECT customer_id, total_services FROM gold"),
    ("feat_tenure", lambda t: t.gold.select("customer_id", "tenure_group"), "SELECT customer_id, tenure_group FROM gold"),
    ("feat_autopay", lambda t: t.gold.select("customer_id", "is_auto_payment"), "SELECT customer_id, CASE WHEN payment_method LIKE '%(automatic)' THEN 1 ELSE 0 END AS is_auto_payment FROM sub"),
    ("feat_ratio", lambda t: t.gold.select("customer_id", "charges_ratio"), "SELECT customer_id, monthly_charges / (tenure_months + 1) AS charges_ratio FROM sub"),
    ("feat_log", lambda t: t.gold.select("customer_id", f.rnd(C("total_charges_log"), 6).alias("total_charges_log")), f"SELECT customer_id, {R('ln(1 + total_charges)', 6)} AS total_charges_log FROM sub"),
    ("feat_simple", lambda t: t.sub.select("customer_id", "tenure_months", "monthly_charges", "total_charges", (C("contract_type") == "Month-to-month").cast("int").alias("is_monthly"), (C("internet_service") == "Fiber optic").cast("int").alias("is_fiber"), (C("payment_method") == "Electronic check").cast("int").alias("is_check"), "churn"), "SELECT customer_id, tenure_months, monthly_charges, total_charges, CAST(contract_type = 'Month-to-month' AS INT) AS is_monthly, CAST(internet_service = 'Fiber optic' AS INT) AS is_fiber, CAST(payment_method = 'Electronic check' AS INT) AS is_check, churn FROM sub"),
    ("feat_defaults", lambda t: t.sub.select("customer_id", F.coalesce(F.when(C("k") % 7 != 0, C("tenure_months")), F.lit(12)).alias("tenure_months")), "SELECT customer_id, CASE WHEN k % 7 <> 0 THEN tenure_months ELSE 12 END AS tenure_months FROM sub"),
    ("feat_hash", lambda t: t.sub.select("customer_id", F.substring(F.sha2(F.concat_ws("|", "contract_type", "customer_id", "payment_method"), 256), 1, 16).alias("feature_hash")), "SELECT customer_id, substr(sha256(contract_type || '|' || customer_id || '|' || payment_method), 1, 16) AS feature_hash FROM sub"),
    ("tier_3", lambda t: t.sub.select("customer_id", f.tier3(P()).alias("band")), f"SELECT customer_id, {T3} AS band FROM sub"),
    ("tier_4", lambda t: t.sub.select("customer_id", f.tier4(P()).alias("tier")), f"SELECT customer_id, {T4} AS tier FROM sub"),
    ("fmt_money", lambda t: t.sub.select("customer_id", F.concat(F.lit("$"), F.format_number("monthly_charges", 2)).alias("shown")), "SELECT customer_id, '$' || format('{:,.2f}', monthly_charges) AS shown FROM sub"),
    ("calc_margin", lambda t: t.sub.select("customer_id", F.when(C("total_charges") > 0, (C("total_charges") - C("monthly_charges")) / C("total_charges")).otherwise(0.0).alias("margin")), "SELECT customer_id, CASE WHEN total_charges > 0 THEN (total_charges - monthly_charges) / total_charges ELSE 0.0 END AS margin FROM sub"),
    ("flt_search", lambda t: t.gold.filter(P().between(0.2, 0.7) & C("customer_segment").rlike("(?i)growth") & C("contract_type").rlike("(?i)month")).select("customer_id", "churn_probability"), "SELECT customer_id, churn_probability FROM gold WHERE churn_probability BETWEEN 0.2 AND 0.7 AND customer_segment ILIKE '%growth%' AND contract_type ILIKE '%month%'"),
    ("flt_cohort", lambda t: t.gold.filter((C("customer_segment") == "Loyal Subscribers") & C("intelligence_category").isin("Good", "Excellent") & (f.tier3(P()) == "Low")).select("customer_id", "rfm_persona"), f"SELECT customer_id, rfm_persona FROM gold WHERE customer_segment = 'Loyal Subscribers' AND intelligence_category IN ('Good', 'Excellent') AND {T3} = 'Low'"),
    ("flt_text", lambda t: t.sub.filter(F.lower(F.concat_ws(" ", "customer_id", "contract_type", "payment_method", "internet_service")).contains("fiber")).select("customer_id"), "SELECT customer_id FROM sub WHERE lower(concat_ws(' ', customer_id, contract_type, payment_method, internet_service)) LIKE '%fiber%'"),
    ("flt_page", lambda t: t.sub.filter("k > 100").orderBy("k").limit(50).select("k", "customer_id"), "SELECT k, customer_id FROM sub WHERE k > 100 ORDER BY k LIMIT 50"),
    ("flt_point", lambda t: t.events.select(C("user_id").alias("k")).distinct().join(t.sub, "k", "left").select("k", F.coalesce("customer_id", F.lit("unknown")).alias("customer_id"), F.coalesce("monthly_charges", F.lit(70.0)).alias("monthly_charges")), "SELECT e.k, coalesce(customer_id, 'unknown') AS customer_id, coalesce(monthly_charges, 70.0) AS monthly_charges FROM (SELECT DISTINCT user_id AS k FROM events) e LEFT JOIN sub USING (k)"),
    ("id_extract", lambda t: t.read("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])(?:[0-9A-Za-z]{4,5}-[0-9A-Za-z]{5}|[0-9]{4,6})(?![0-9A-Za-z_])"), F.lit(0))).alias("place", "id")).select("doc_id", "place", F.upper("id").alias("customer_id")), r"SELECT doc_id, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS place, upper(unnest(ids)) AS customer_id FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:[0-9A-Za-z]{4,5}-[0-9A-Za-z]{5}|[0-9]{4,6})\b') AS ids FROM documents)"),
)

# cleaning and quality
CLEANED = """t AS (SELECT row_no, trim("customerID") AS customer_id, trim(gender) AS gender, tenure AS tenure_months, "MonthlyCharges" AS monthly_charges, trim("TotalCharges") AS total_charges, trim("Churn") AS churn FROM raw),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY row_no) = 1),
cl AS (SELECT row_no, customer_id, gender, tenure_months, monthly_charges, CAST(TRY_CAST(total_charges AS DOUBLE) IS NULL AS INT) AS imputed, coalesce(TRY_CAST(total_charges AS DOUBLE), CASE WHEN tenure_months = 0 THEN 0.0 ELSE monthly_charges END) AS total_charges, CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn FROM u WHERE churn IN ('Yes', 'No'))"""
CL = f"WITH {CLEANED} SELECT "
COLS = ("customer_id", "gender", "tenure_months", "monthly_charges", "total_charges", "churn")
many(
    ("clean_rename", lambda t: clean.renamed(t.raw).select("customer_id", "tenure_months", "churn"), 'SELECT "customerID" AS customer_id, tenure AS tenure_months, "Churn" AS churn FROM raw'),
    ("clean_trim", lambda t: clean.trimmed(t.raw).select("row_no", "customerID"), 'SELECT row_no, trim("customerID") AS "customerID" FROM raw'),
    ("win_first", lambda t: clean.first_of_each(t.events, "user_id", "event_id").select("user_id", "event_id"), "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1"),
    ("clean_numeric", lambda t: t.raw.select("row_no", clean.number("TotalCharges").alias("total_charges")), 'SELECT row_no, TRY_CAST(trim("TotalCharges") AS DOUBLE) AS total_charges FROM raw'),
    ("clean_numeric0", lambda t: t.raw.select("row_no", F.coalesce(clean.number("TotalCharges"), F.lit(0.0)).alias("total_charges")), 'SELECT row_no, coalesce(TRY_CAST(trim("TotalCharges") AS DOUBLE), 0.0) AS total_charges FROM raw'),
    ("clean_impute", lambda t: clean.cleaned(t.raw).filter("imputed = 1").select("customer_id", "total_charges"), CL + "customer_id, total_charges FROM cl WHERE imputed = 1"),
    ("clean_cast", lambda t: clean.cleaned(t.raw).select("customer_id", C("tenure_months").cast("int"), C("churn").cast("int")), CL + "customer_id, CAST(tenure_months AS INT) AS tenure_months, CAST(churn AS INT) AS churn FROM cl"),
    ("id_valid", lambda t: t.raw.filter(~F.lower(F.trim("customerID")).isin("", "nan", "none", "null")).select("row_no"), "SELECT row_no FROM raw WHERE lower(trim(\"customerID\")) NOT IN ('', 'nan', 'none', 'null')"),
)

# SQL reports
dist = lambda c: (lambda t: count(t.sub, c), f"SELECT {c}, count(*) AS n FROM sub GROUP BY 1")
many(
    ("rpt_total", lambda t: t.customers.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM sub"),
    ("rpt_churned", lambda t: t.customers.filter("churn = 1").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM sub WHERE churn = 1"),
    ("rpt_avgcharge", lambda t: t.billings.agg(f.rnd(mean("monthly_charges"), 2).alias("avg_monthly")), f"SELECT {R(A('monthly_charges'), 2)} AS avg_monthly FROM sub"),
    ("rpt_avgtenure", lambda t: t.customers.agg(f.rnd(F.avg("tenure_months"), 2).alias("avg_tenure")), f"SELECT {R('avg(tenure_months)', 2)} AS avg_tenure FROM sub"),
    ("rpt_contract", lambda t: count(t.customers.join(t.contracts.withColumnRenamed("id", "contract_id"), "contract_id"), "contract_type"), dist("contract_type")[1]),
    ("rpt_internet", lambda t: count(t.customers.join(t.services.withColumnRenamed("id", "service_id"), "service_id"), "internet_service"), dist("internet_service")[1]),
    ("rpt_payment", lambda t: count(t.customers.join(t.contracts.withColumnRenamed("id", "contract_id"), "contract_id"), "payment_method"), dist("payment_method")[1]),
    ("rpt_toprev", lambda t: t.customers.join(t.billings.withColumnRenamed("id", "billing_id"), "billing_id").orderBy(F.desc("total_charges"), "customer_id").limit(10).select("customer_id", "total_charges"), "SELECT customer_id, total_charges FROM sub ORDER BY 2 DESC, 1 LIMIT 10"),
    ("rpt_gender", *dist("gender")),
    ("rpt_senior", *dist("senior_citizen")),
    ("rpt_status", lambda t: t.events.agg(F.count("*").alias("records"), (F.count("*") > 0).alias("populated"), F.max(F.when(C("event_type") != "error", C("ts"))).alias("latest")), "SELECT count(*) AS records, count(*) > 0 AS populated, max(ts) FILTER (event_type <> 'error') AS latest FROM events"),
)

# KPIs
many(
    ("kpi_churn", lambda t: t.sub.agg(F.count("*").alias("total"), F.count_if(HIGH()).alias("high"), F.count_if(MEDIUM()).alias("medium"), F.count_if(P() < 0.4).alias("low"), f.rnd(F.count_if(HIGH()) * 100.0 / F.count("*"), 1).alias("high_pct"), f.rnd(mean("churn_probability"), 3).alias("avg_p")), f"SELECT count(*) AS total, count_if(churn_probability >= 0.61) AS high, count_if(churn_probability >= 0.4 AND churn_probability < 0.61) AS medium, count_if(churn_probability < 0.4) AS low, {R('count_if(churn_probability >= 0.61) * 100.0::DOUBLE / count(*)', 1)} AS high_pct, {R(A('churn_probability'), 3)} AS avg_p FROM sub"),
    ("kpi_ltvrisk", lambda t: t.gold.agg(mean("predicted_ltv", 2).alias("avg_ltv"), money(RISK(), 4).alias("at_risk"), F.coalesce(money(F.when(HIGH(), RISK()), 4), F.lit(0.0)).alias("high_at_risk")), f"SELECT {A('predicted_ltv', 2)} AS avg_ltv, {D('churn_probability * predicted_ltv', 4)} AS at_risk, coalesce({D('CASE WHEN churn_probability >= 0.61 THEN churn_probability * predicted_ltv END', 4)}, 0.0) AS high_at_risk FROM gold"),
    ("kpi_watch", lambda t: t.sub.agg(F.count_if(HIGH()).alias("high"), F.count_if(MEDIUM()).alias("medium"), mean("churn_probability").alias("mean_p")), f"SELECT count_if(churn_probability >= 0.61) AS high, count_if(churn_probability >= 0.4 AND churn_probability < 0.61) AS medium, {A('churn_probability')} AS mean_p FROM sub"),
    ("kpi_recs", lambda t: t.gold.agg(money("estimated_revenue_saved", 2).alias("savings"), *(F.count_if(C("recommendation_priority") == x).alias(x.lower()) for x in ("Critical", "High", "Medium"))), f"SELECT {D('estimated_revenue_saved', 2)} AS savings, count_if(recommendation_priority = 'Critical') AS critical, count_if(recommendation_priority = 'High') AS high, count_if(recommendation_priority = 'Medium') AS medium FROM gold"),
    ("kpi_segcount", lambda t: t.gold.agg(F.count_distinct("customer_segment").alias("segments"), *(F.count_if(C("customer_segment").contains(x)).alias(x.split("-")[0].lower()) for x in ("High-Value", "Loyal", "Budget"))), "SELECT count(DISTINCT customer_segment) AS segments, count_if(customer_segment LIKE '%High-Value%') AS high, count_if(customer_segment LIKE '%Loyal%') AS loyal, count_if(customer_segment LIKE '%Budget%') AS budget FROM gold"),
    ("grp_segrisk", lambda t: t.gold.groupBy("customer_segment").agg(money(RISK(), 4).alias("at_risk")), f"SELECT customer_segment, {D('churn_probability * predicted_ltv', 4)} AS at_risk FROM gold GROUP BY 1"),
    ("grp_contractrisk", lambda t: count(t.sub.filter(HIGH()), "contract_type"), "SELECT contract_type, count(*) AS n FROM sub WHERE churn_probability >= 0.61 GROUP BY 1"),
    ("grp_priority", lambda t: t.gold.groupBy("recommendation_priority").agg(F.count("*").alias("n"), money("estimated_revenue_saved", 2).alias("saved")), f"SELECT recommendation_priority, count(*) AS n, {D('estimated_revenue_saved', 2)} AS saved FROM gold GROUP BY 1"),
    ("grp_segshare", lambda t: count(t.gold, "customer_segment", "rfm_persona").withColumn("share", C("n") / F.sum("n").over(Window.partitionBy())), "SELECT customer_segment, rfm_persona, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM gold GROUP BY 1, 2"),
    ("win_share", lambda t: count(t.sub, "contract_type", "payment_method").withColumn("share", C("n") / F.sum("n").over(Window.partitionBy("contract_type"))), "SELECT contract_type, payment_method, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY contract_type) AS DOUBLE) AS share FROM sub GROUP BY 1, 2"),
    ("grp_recs", lambda t: t.gold.groupBy("primary_recommendation", "recommendation_priority").agg(F.count("*").alias("n"), money("estimated_revenue_saved", 2).alias("saved")), f"SELECT primary_recommendation, recommendation_priority, count(*) AS n, {D('estimated_revenue_saved', 2)} AS saved FROM gold GROUP BY 1, 2"),
    ("win_mode", lambda t: stats.modes(t.events, "user_id", "event_type"), "SELECT user_id, event_type FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1"),
    ("grp_rfm", lambda t: t.gold.groupBy("r_score", "f_score").agg(F.count("*").alias("n"), F.avg("m_score").alias("avg_m")), "SELECT r_score, f_score, count(*) AS n, avg(m_score) AS avg_m FROM gold GROUP BY 1, 2"),
    ("grp_drivers", lambda t: t.sub.select(F.inline(F.array(*(F.struct(F.lit(n).alias("factor"), (c).alias("within"), "churn") for n, c in (("month-to-month", C("contract_type") == "Month-to-month"), ("short tenure", C("tenure_months") <= 12), ("fiber", C("internet_service") == "Fiber optic"), ("no support", C("tech_support") == "No")))))).groupBy("factor", "within").agg(F.count("*").alias("n"), F.avg("churn").alias("rate")), "SELECT factor, within, count(*) AS n, avg(churn) AS rate FROM (SELECT 'month-to-month' AS factor, contract_type = 'Month-to-month' AS within, churn FROM sub UNION ALL SELECT 'short tenure', tenure_months <= 12, churn FROM sub UNION ALL SELECT 'fiber', internet_service = 'Fiber optic', churn FROM sub UNION ALL SELECT 'no support', tech_support = 'No', churn FROM sub) GROUP BY 1, 2"),
    ("rpt_ltvsum", lambda t: t.gold.agg(money("projected_future_ltv", 2).alias("total"), mean("projected_future_ltv", 2).alias("average")), f"SELECT {D('projected_future_ltv', 2)} AS total, {A('projected_future_ltv', 2)} AS average FROM gold"),
    ("rpt_scorecat", lambda t: t.gold.groupBy("intelligence_category").agg(F.count("*").alias("n"), f.rnd(mean("intelligence_score"), 4).alias("avg_score")), f"SELECT intelligence_category, count(*) AS n, {R(A('intelligence_score'), 4)} AS avg_score FROM gold GROUP BY 1"),
)

# logs
DAY = "CAST(ts AS DATE)"
many(
    ("agg_metricsday", lambda t: t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.count_if(C("event_type") == "error").alias("errors")), f"SELECT {DAY} AS day, count(*) AS requests, count_if(event_type = 'error') AS errors FROM events GROUP BY 1"),
    ("st_retain", lambda t: t.events.filter(C("ts") >= t.events.agg((F.max("ts") - F.expr("interval 30 days")).alias("cut")).scalar()).select("event_id"), "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM events)"),
    ("agg_predlog", lambda t: t.events.join(t.gold, C("user_id") == C("k")).groupBy(f.tier3(P()).alias("level")).agg(F.count("*").alias("n"), mean("churn_probability").alias("avg_p"), mean("predicted_ltv", 2).alias("avg_ltv")), f"SELECT {T3} AS level, count(*) AS n, {A('churn_probability')} AS avg_p, {A('predicted_ltv', 2)} AS avg_ltv FROM events JOIN gold ON user_id = k GROUP BY 1"),
    ("top_recent", lambda t: t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts"), "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"),
    ("win_lastn", lambda t: t.events.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 200").select("event_type", "event_id", "r"), "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS r FROM events QUALIFY r <= 200"),
    ("agg_batch", lambda t: t.gold.agg(F.count_if(C("total_charges") > 0).alias("ok"), F.count_if(C("total_charges") <= 0).alias("failed"), f.rnd(mean("churn_probability"), 4).alias("avg_p"), f.rnd(mean("predicted_ltv", 2), 2).alias("avg_ltv"), F.count_if(HIGH()).alias("high")), f"SELECT count_if(total_charges > 0) AS ok, count_if(total_charges <= 0) AS failed, {R(A('churn_probability'), 4)} AS avg_p, {R(A('predicted_ltv', 2), 2)} AS avg_ltv, count_if(churn_probability >= 0.61) AS high FROM gold"),
)

# top-k and windows
many(
    ("top_exposure", lambda t: t.gold.filter(HIGH()).orderBy(F.desc(RISK()), "customer_id").limit(20).select("customer_id", RISK().alias("exposure")), "SELECT customer_id, churn_probability * predicted_ltv AS exposure FROM gold WHERE churn_probability >= 0.61 ORDER BY 2 DESC, 1 LIMIT 20"),
    ("top_tiers", lambda t: t.gold.withColumn("tier", f.tier4(P())).withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc(RISK()), "customer_id"))).filter("r <= 10").join(count(t.gold.withColumn("tier", f.tier4(P())), "tier"), "tier").select("tier", "r", "customer_id", "n"), f"SELECT tier, CAST(r AS INT) AS r, customer_id, n FROM (SELECT {T4} AS tier, customer_id, row_number() OVER (PARTITION BY {T4} ORDER BY churn_probability * predicted_ltv DESC, customer_id) AS r, count(*) OVER (PARTITION BY {T4}) AS n FROM gold) WHERE r <= 10"),
    ("top_ltv", lambda t: t.gold.orderBy(F.desc("predicted_ltv"), "customer_id").limit(10).select("customer_id", "predicted_ltv"), "SELECT customer_id, predicted_ltv FROM gold ORDER BY 2 DESC, 1 LIMIT 10"),
    ("top_saved", lambda t: t.gold.orderBy(F.desc("estimated_revenue_saved"), "customer_id").limit(3).select("customer_id", "estimated_revenue_saved"), "SELECT customer_id, estimated_revenue_saved FROM gold ORDER BY 2 DESC, 1 LIMIT 3"),
    ("win_avgrank", lambda t: ranks.average_ranks(t.sub, "tenure_months", "r").select("customer_id", "r"), "SELECT customer_id, rank() OVER (ORDER BY tenure_months) + (count(*) OVER (PARTITION BY tenure_months) - 1) / 2.0::DOUBLE AS r FROM sub"),
)

# values, scores, decisions
SCEN = (("no change", None), ("yearly contract", "One year"), ("two years", "Two year"))
many(
    ("score_linear", lambda t: t.sub.select("customer_id", f.linear_probability().alias("churn_probability")), "SELECT customer_id, churn_probability FROM sub"),
    ("score_batch", lambda t: t.gold.select("customer_id", F.when(C("total_charges") <= 0, "error").otherwise("ok").alias("status"), F.when(C("total_charges") > 0, P()).alias("p")), "SELECT customer_id, CASE WHEN total_charges <= 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN total_charges > 0 THEN churn_probability END AS p FROM gold"),
    ("score_intel", lambda t: t.gold.select("customer_id", "intelligence_score", "intelligence_category"), "SELECT customer_id, intelligence_score, intelligence_category FROM gold"),
    ("join_scalar", lambda t: t.gold.select("customer_id", (C("predicted_ltv") / t.gold.agg(F.max("predicted_ltv").alias("m")).scalar()).alias("share")), "SELECT customer_id, predicted_ltv / (SELECT max(predicted_ltv) FROM gold) AS share FROM gold"),
    ("score_unified", lambda t: t.gold.select("customer_id", "churn_probability", "predicted_ltv", "projected_future_ltv", "customer_segment", "rfm_persona", "intelligence_score", "primary_recommendation"), "SELECT customer_id, churn_probability, predicted_ltv, projected_future_ltv, customer_segment, rfm_persona, intelligence_score, primary_recommendation FROM gold"),
    ("ltv_actuarial", lambda t: t.sub.select("customer_id", f.ltv_actuarial(C("monthly_charges"), P()).alias("ltv")), f"SELECT customer_id, {R('least(monthly_charges * 0.7::DOUBLE / greatest(churn_probability, 0.01::DOUBLE), monthly_charges * 0.7::DOUBLE * 60.0::DOUBLE)', 2)} AS ltv FROM sub"),
    ("ltv_remaining", lambda t: t.sub.select("customer_id", f.rnd(f.remaining_months(P(), C("tenure_months")) * C("monthly_charges"), 2).alias("projected")), f"SELECT customer_id, {R('greatest(0.0::DOUBLE, 1.0::DOUBLE / greatest(0.01::DOUBLE, churn_probability) - tenure_months) * monthly_charges', 2)} AS projected FROM sub"),
    ("var_risk", lambda t: t.gold.select("customer_id", f.rnd(RISK(), 2).alias("at_risk"), f.rnd(P() * 12.0 * C("monthly_charges"), 2).alias("annual")), f"SELECT customer_id, {R('churn_probability * predicted_ltv', 2)} AS at_risk, {R('churn_probability * 12.0::DOUBLE * monthly_charges', 2)} AS annual FROM gold"),
    ("rfm_fixed", lambda t: t.gold.select("customer_id", "r_score", "f_score", "m_score", "rfm_persona"), "SELECT customer_id, r_score, f_score, m_score, rfm_persona FROM gold"),
    ("win_quintile", lambda t: stats.quintiles(t.sub, "total_charges").select("customer_id", "q"), "WITH e AS (SELECT quantile_cont(total_charges, [0.2, 0.4, 0.6, 0.8]) AS e FROM sub) SELECT customer_id, CAST(1 + len(list_filter(e, lambda x: total_charges > x)) AS INT) AS q FROM sub, e"),
    ("rfm_quant", lambda t: stats.quintiles(stats.quintiles(stats.quintiles(t.sub.withColumn("stay", 1.0 - P()), "stay", "r"), "tenure_months", "fr"), "total_charges", "m").select("customer_id", (C("r") * 100 + C("fr") * 10 + C("m")).alias("code"), f.persona(C("r"), C("fr"), C("m")).alias("persona")), "WITH e AS (SELECT quantile_cont(1 - churn_probability, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(tenure_months, [0.2, 0.4, 0.6, 0.8]) AS b, quantile_cont(total_charges, [0.2, 0.4, 0.6, 0.8]) AS c FROM sub), q AS (SELECT customer_id, 1 + len(list_filter(a, lambda x: 1 - churn_probability > x)) AS r, 1 + len(list_filter(b, lambda x: tenure_months > x)) AS f, 1 + len(list_filter(c, lambda x: total_charges > x)) AS m FROM sub, e) SELECT customer_id, CAST(r * 100 + f * 10 + m AS INT) AS code, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'VIP Subscribers' WHEN r >= 3 AND f >= 3 AND m >= 4 THEN 'Loyal Subscribers' WHEN r >= 3 AND f >= 3 THEN 'High-Potential Subscribers' WHEN r <= 2 AND f >= 3 THEN 'At-Risk Subscribers' WHEN r <= 2 AND f <= 2 THEN 'Churned Subscribers' ELSE 'Dormant Subscribers' END AS persona FROM q"),
    ("win_toprec", lambda t: t.gold.select("customer_id", "primary_recommendation", "recommendation_priority", "estimated_revenue_saved"), "SELECT customer_id, recommendation AS primary_recommendation, priority AS recommendation_priority, saved AS estimated_revenue_saved FROM recs QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY rank, rule) = 1"),
    ("join_cross_strat", lambda t: stats.strategies(t.sub).select("customer_id", "strategy", "cost"), "SELECT customer_id, strategy, cost FROM roi"),
    ("win_rankroi", lambda t: stats.strategies(t.sub).filter("place = 1").select("customer_id", "strategy", "net"), "SELECT customer_id, strategy, net FROM roi QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, strategy) = 1"),
    ("join_cross_scen", lambda t: t.sub.select("customer_id", F.inline(F.array(*(F.struct(F.lit(n).alias("scenario"), (F.lit(c) if c else C("contract_type")).alias("contract_type")) for n, c in SCEN)))), "SELECT customer_id, scenario, coalesce(c, contract_type) AS contract_type FROM (SELECT customer_id, contract_type, unnest([{'scenario': 'no change', 'c': NULL}, {'scenario': 'yearly contract', 'c': 'One year'}, {'scenario': 'two years', 'c': 'Two year'}], recursive := true) FROM sub)"),
    ("cust_360", lambda t: t.gold.join(stats.strategies(t.sub).filter("place = 1").select("customer_id", "strategy", "net"), "customer_id").select("customer_id", "churn_probability", "intelligence_score", "primary_recommendation", "strategy", "net"), "SELECT customer_id, churn_probability, intelligence_score, primary_recommendation, strategy, net FROM gold JOIN (SELECT customer_id, strategy, net FROM roi QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, strategy) = 1) USING (customer_id)"),
    ("brief_exec", lambda t: t.gold.agg(F.count("*").alias("total"), F.count_if(HIGH()).alias("high"), money(RISK(), 4).alias("at_risk"), mean("predicted_ltv", 2).alias("avg_ltv")), f"SELECT count(*) AS total, count_if(churn_probability >= 0.61) AS high, {D('churn_probability * predicted_ltv', 4)} AS at_risk, {A('predicted_ltv', 2)} AS avg_ltv FROM gold"),
)

# profiles and statistics
NUM = ("tenure_months", "monthly_charges", "total_charges")
CAT = ("gender", "contract_type", "internet_service", "payment_method")
long_sql = lambda cols, kind: " UNION ALL ".join(f"SELECT k, '{c}' AS name, CAST({c} AS {kind}) AS v, churn FROM sub" for c in cols)
many(
    ("prof_topk", lambda t: stats.top_values(t.sub, CAT, 10), f"SELECT name, v, n, CAST(r AS INT) AS r FROM (SELECT name, v, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v) AS r FROM ({long_sql(CAT, 'VARCHAR')}) GROUP BY 1, 2) WHERE r <= 10"),
    ("stat_target", lambda t: count(t.sub, "churn").withColumn("share", C("n") / F.sum("n").over(Window.partitionBy())), "SELECT churn, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM sub GROUP BY 1"),
    ("stat_zscore", lambda t: stats.far(t.read("lineitem"), "l_extendedprice", 3).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem, (SELECT avg(CAST(l_extendedprice AS DOUBLE)) AS m, stddev_pop(CAST(l_extendedprice AS DOUBLE)) AS s FROM lineitem) WHERE abs((CAST(l_extendedprice AS DOUBLE) - m) / s) > 3"),
    ("stat_crosstab", lambda t: count(t.sub, "contract_type", "churn"), "SELECT contract_type, churn, count(*) AS n FROM sub GROUP BY 1, 2"),
    ("stat_chi2", lambda t: stats.chi2(t.sub, CAT, "churn").select("name", "dof", f.rnd(C("chi2"), 6).alias("chi2"), f.rnd(stats.chi2_tail(C("chi2"), C("dof")), 6).alias("p_value")), "SELECT name, dof, floor(chi2 * 1000000.0 + 0.5) / 1000000.0 AS chi2, floor(greatest(0.0::DOUBLE, 1.0::DOUBLE - (SELECT sum(exp((dof / 2.0::DOUBLE + n) * ln(chi2 / 2.0::DOUBLE) - chi2 / 2.0::DOUBLE - lgamma(dof / 2.0::DOUBLE + n + 1))) FROM range(2000) r(n))) * 1000000.0 + 0.5) / 1000000.0 AS p_value FROM chi"),
    ("stat_mi", lambda t: stats.mutual_information(t.sub, CAT, "churn").select("name", f.rnd(C("mi"), 6).alias("mi")), f"WITH c AS (SELECT name, v, churn, count(*) AS n FROM ({long_sql(CAT, 'VARCHAR')}) GROUP BY 1, 2, 3), m AS (SELECT name, n, sum(n) OVER (PARTITION BY name, v) AS a, sum(n) OVER (PARTITION BY name, churn) AS b, sum(n) OVER (PARTITION BY name) AS s FROM c) SELECT name, {R('sum(n / s::DOUBLE * ln(n::DOUBLE * s / (a::DOUBLE * b)))', 6)} AS mi FROM m GROUP BY 1"),
    ("stat_hist", lambda t: count(t.sub.withColumn("bin", F.least(F.floor(P() * 12), F.lit(11))), "bin"), "SELECT CAST(least(floor(churn_probability * 12), 11) AS BIGINT) AS bin, count(*) AS n FROM sub GROUP BY 1"),
    ("stat_box", lambda t: ranks.quantiles(t.sub, ["contract_type"], "monthly_charges", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}).select("contract_type", *(f.rnd(C(f"q{i}"), 4).alias(f"q{i}") for i in range(5))), "SELECT contract_type, " + ", ".join(f"{R(f'quantile_cont(monthly_charges, {p})', 4)} AS q{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM sub GROUP BY 1"),
    ("stat_countby", lambda t: count(stats.long(t.sub, CAT, "string", "churn"), "name", "v", "churn"), f"SELECT name, v, churn, count(*) AS n FROM ({long_sql(CAT, 'VARCHAR')}) GROUP BY 1, 2, 3"),
    ("stat_scatter", lambda t: count(t.gold.withColumns({"x": F.floor(C("tenure_months") / 12), "y": F.floor(C("monthly_charges") / 20)}), "x", "y", "customer_segment"), "SELECT CAST(floor(tenure_months / 12) AS BIGINT) AS x, CAST(floor(monthly_charges / 20) AS BIGINT) AS y, customer_segment, count(*) AS n FROM gold GROUP BY 1, 2, 3"),
    ("drift_psi", lambda t: drift.psi(t.base, t.now, "monthly_charges").select(f.rnd(C("psi"), 6).alias("psi"), "n_now"), "SELECT floor(psi * 1000000.0 + 0.5) / 1000000.0 AS psi, n_now FROM psi1"),
    ("join_range", lambda t: count(drift.binned(t.now, drift.edges(t.base, "monthly_charges"), "monthly_charges"), "bin"), "SELECT bin, count(*) AS n FROM now_bins GROUP BY 1"),
    ("ev_confusion", lambda t: count(t.sub.withColumn("pred", (P() >= 0.5).cast("int")), "churn", "pred"), "SELECT churn, CAST(churn_probability >= 0.5 AS INT) AS pred, count(*) AS n FROM sub GROUP BY 1, 2"),
    ("ev_calib", lambda t: t.sub.groupBy(F.greatest(F.lit(0), F.ceil(P() * 10) - 1).alias("bin")).agg(F.count("*").alias("n"), F.avg("churn").alias("rate"), mean("churn_probability").alias("mean_p")), f"SELECT CAST(greatest(0, ceil(churn_probability * 10) - 1) AS BIGINT) AS bin, count(*) AS n, avg(churn) AS rate, {A('churn_probability')} AS mean_p FROM sub GROUP BY 1"),
)
