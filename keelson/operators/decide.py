"""What-if scenarios, attributions, action plans and feature checks of subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f
from ..functions import rules
from ..functions.columns import rnd
from .gold import mean

C = F.col


def what_if(sub: DataFrame) -> DataFrame:
    """Every subscriber under every scenario: probability and projected value before and after."""
    names = ("scenario", "contract", "support", "payment", "factor")
    table = F.array(*(F.struct(*(F.lit(v).cast("double" if n == "factor" else "string").alias(n) for n, v in zip(names, s))) for s in rules.SCENARIOS))
    rows = sub.select("*", F.inline(table))
    monthly = C("monthly_charges") * C("factor")
    after = f.linear_probability(contract_type=F.coalesce("contract", "contract_type"), tech_support=F.coalesce("support", "tech_support"), payment_method=F.coalesce("payment", "payment_method"), monthly_charges=monthly)
    rows = rows.select("customer_id", "scenario", C("churn_probability").alias("before"), after.alias("after"), f.ltv_projected(C("churn_probability")).alias("ltv_before"), monthly.alias("m"))
    rows = rows.withColumns({"ltv_after": f.ltv_projected(C("after"), C("m")), "reduction": rnd(C("before") - C("after"), 4)})
    return rows.select(
        "customer_id", "scenario", "before", "after", "reduction", rnd(C("reduction") / F.greatest(F.lit(0.01), C("before")) * 100.0, 1).alias("reduction_pct"),
        rnd(C("ltv_after") - C("ltv_before"), 2).alias("ltv_change"), rnd(F.greatest(F.lit(0.0), C("reduction") * C("ltv_after")), 2).alias("saved"),
    )


def rule_impacts(sub: DataFrame) -> DataFrame:
    """(customer_id, place, feature, impact, cumulative, probability): six impacts, largest first, summed from the base rate.

    The six are one short array of the row, so sorting and summing need no shuffle."""

    def holds(feature, value) -> Column:
        if feature == "tenure_months":
            return C(feature) < value
        return C(feature) > value if feature == "monthly_charges" else C(feature) == value

    items = F.array(*(F.struct(F.when(holds(n, v), -abs(a)).otherwise(-abs(b)).alias("size"), F.lit(i).alias("i"), F.lit(n).alias("feature"), F.when(holds(n, v), a).otherwise(b).alias("impact")) for i, (n, v, a, b) in enumerate(rules.IMPACTS)))
    upto = lambda n: F.aggregate(F.slice("items", 1, n), F.lit(rules.IMPACT_BASE), lambda total, x: total + x["impact"])
    rows = sub.select("customer_id", F.array_sort(items).alias("items"))
    lines = F.transform("items", lambda x, i: F.struct((i + 1).alias("place"), x["feature"].alias("feature"), x["impact"].alias("impact"), rnd(upto(i + 1), 4).alias("cumulative")))
    p = rnd(F.greatest(F.lit(0.01), F.least(F.lit(0.99), upto(F.size("items")))), 4)
    return rows.select("customer_id", p.alias("probability"), F.inline(lines))


def linear_impacts(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(customer_id, feature, impact): each feature's part of the linear score less its mean in the baseline."""
    terms = f.linear_terms()
    means = base.agg(F.struct(*(mean(v).alias(n) for n, v in terms.items())).alias("m")).scalar()
    rows = rows.withColumn("__m", means)
    return rows.select("customer_id", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), rnd(v - C("__m")[n], 6).alias("impact")) for n, v in terms.items()))))


def importance(impacts: DataFrame) -> DataFrame:
    """(feature, importance): mean size of the impacts; features are few."""
    return impacts.groupBy("feature").agg(rnd(mean(F.abs(C("impact"))), 6).alias("importance"))


def action_plan(sub: DataFrame) -> DataFrame:
    """Risk level, confidence, action, offer code, recoverable value and steps by tier."""
    p = C("churn_probability")
    names = ("low", "risk_level", "confidence", "action", "offer_code", "months", "share")
    plans = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, plan)), F.array(*map(F.lit, plan[-1])).alias("steps")) for plan in rules.ACTION_PLANS]
    rows = sub.withColumn("plan", f.chain(((p >= plan[0], s) for plan, s in zip(rules.ACTION_PLANS[:-1], plans)), plans[-1]))
    value = rnd(C("monthly_charges") * C("plan.months") * C("plan.share"), 2)
    return rows.select("customer_id", "plan.risk_level", "plan.confidence", "plan.action", "plan.offer_code", value.alias("recoverable"), "plan.steps")


def feature_errors(df: DataFrame) -> DataFrame:
    """(customer_id, feature, error): missing, not numeric, below or above its range, or not an allowed value."""
    found = []
    for name, (low, high) in rules.FEATURE_RANGES.items():
        x = C(name).try_cast("double") if dict(df.dtypes)[name] == "string" else C(name).cast("double")
        found.append((name, F.when(C(name).isNull(), "missing").when(x.isNull(), "not numeric").when(x < low, "below range").when(x > high, "above range")))
    for name, allowed in rules.FEATURE_VALUES.items():
        found.append((name, F.when(C(name).isNull(), "missing").when(~C(name).isin(*allowed), "not allowed")))
    rows = F.array_compact(F.array(*(F.when(e.isNotNull(), F.struct(F.lit(n).alias("feature"), e.alias("error"))) for n, e in found)))
    return df.select("customer_id", F.inline(rows))


def retention_plan(sub: DataFrame) -> DataFrame:
    """Contact window, risk level, actions and message of every subscriber."""
    p = C("churn_probability")
    priority = F.when(p >= rules.HIGH_RISK, rules.CONTACT[True]).otherwise(rules.CONTACT[False])

    def filled(template: str) -> Column:
        out = F.lit(template)
        for mark, value in (("{contract}", C("contract_type")), ("{priority}", priority), ("{tenure}", C("tenure_months").cast("string"))):
            out = F.replace(out, F.lit(mark), value) if mark in template else out
        return out

    return sub.select("customer_id", priority.alias("priority"), f.tier3(p, ("CRITICAL", "HIGH", "MEDIUM")).alias("risk_level"), F.array(*map(filled, rules.PLAN_ACTIONS)).alias("actions"), filled(rules.PLAN_MESSAGE).alias("message"))


def best_strategy() -> Column:
    """The strategy of the highest net value, the earlier one on ties; found within the row."""
    annual, keep = C("monthly_charges") * 12.0, 1.0 - C("churn_probability")
    options = []
    for i, (name, share, fixed, cut) in enumerate(rules.STRATEGIES):
        kept = rnd(F.least(F.lit(rules.RETENTION_CAP), keep + cut) if cut else keep, 3)
        net = rnd(rnd(kept * annual, 2) - rnd(annual * share + fixed, 2), 2)
        options.append(F.struct(net.alias("net"), F.lit(-i).alias("earlier"), F.lit(name).alias("strategy")))
    return F.array_max(F.array(*options))["strategy"]


def outreach(sub: DataFrame, tone: str = "Professional") -> DataFrame:
    """A message to every subscriber with the best strategy, in one of the tones of the rules."""
    subject, greeting, close = rules.TONES[tone]
    rows = sub.withColumns({"strategy": best_strategy(), "ltv": f.ltv_total()})
    filled = lambda s: F.format_string(s, C("customer_id"), C("tenure_months").cast("string"))
    monthly = C("monthly_charges")
    body = F.format_string(rules.OUTREACH, C("tenure_months").cast("string"), "contract_type", "strategy", monthly, monthly * 12.0 * rules.OUTREACH_SAVING)
    return rows.select(
        "customer_id", F.lit(tone).alias("tone"), rnd(C("churn_probability") * 100.0, 1).alias("churn_pct"), C("ltv").alias("predicted_ltv"), "strategy", filled(subject).alias("subject"),
        F.concat_ws("\n\n", filled(greeting), body, F.lit(close)).alias("body"), rnd(C("ltv") * rules.OUTREACH_LTV, 2).alias("saved"),
    )
