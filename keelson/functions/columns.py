"""Column expressions: features, tiers, values, scores, segments. No UDFs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

C = F.col


def rnd(x: Column, digits: int) -> Column:
    """Half up in double arithmetic; the oracles use the same formula, since engines differ at ties of round()."""
    power = float(10**digits)
    return F.floor(x * power + 0.5) / power


def chain(cases, otherwise) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


# features
def total_services() -> Column:
    return reduce(add, (F.when(F.lower(F.trim(C(c))) == "yes", 1).otherwise(0) for c in rules.SERVICES))


def tenure_group(t: Column) -> Column:
    return chain(((t <= 12, "0-12m"), (t <= 24, "12-24m"), (t <= 48, "24-48m"), (t <= 60, "48-60m")), "60m+")


def auto_payment(method: Column) -> Column:
    return F.lower(method).contains("automatic").cast("int")


def charges_ratio() -> Column:
    return C("monthly_charges") / (C("tenure_months") + 1)


def charges_log() -> Column:
    return F.log1p("total_charges")


# tiers
def tier3(p: Column, labels=("High", "Medium", "Low")) -> Column:
    return chain(((p >= rules.HIGH_RISK, labels[0]), (p >= rules.MEDIUM_RISK, labels[1])), labels[2])


def tier4(p: Column) -> Column:
    return chain(((p >= rules.CRITICAL_RISK, "Critical"), (p >= rules.HIGH_RISK, "High"), (p >= rules.MEDIUM_RISK, "Medium")), "Monitor")


# values
def ltv_total() -> Column:
    return rnd(C("monthly_charges") * F.greatest(F.lit(1), C("tenure_months")), 2)


def ltv_projected(p: Column, monthly: Column | None = None) -> Column:
    return rnd((C("monthly_charges") if monthly is None else monthly) * 24.0 * (1.0 - p), 2)


def ltv_actuarial(monthly: Column, p: Column, margin: float = 0.70, months: float = 60.0) -> Column:
    return rnd(F.least(monthly * margin / F.greatest(p, F.lit(0.01)), monthly * margin * months), 2)


def remaining_months(p: Column, tenure: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 / F.greatest(F.lit(0.01), p) - tenure)


def linear_terms(**changed: Column) -> dict[str, Column]:
    """What each feature adds to the linear churn score; ``changed`` takes the place of columns of that name."""
    c, w = lambda name: changed.get(name, C(name)), rules.LINEAR
    return {
        "contract_type": F.when(c("contract_type") == "Month-to-month", w["Month-to-month"]).when(c("contract_type") == "Two year", w["Two year"]).otherwise(0.0),
        "tenure_months": -(c("tenure_months") * w["month"]),
        "monthly_charges": c("monthly_charges") * w["charge"],
        "internet_service": F.when(c("internet_service") == "Fiber optic", w["Fiber optic"]).otherwise(0.0),
        "tech_support": F.when(c("tech_support") == "Yes", -w["tech support"]).otherwise(0.0),
        "payment_method": F.when(c("payment_method") == "Electronic check", w["Electronic check"]).otherwise(0.0),
    }


def linear_probability(**changed: Column) -> Column:
    z = reduce(add, linear_terms(**changed).values(), F.lit(rules.LINEAR["intercept"]))
    return F.round(1 / (1 + F.exp(-z)), 6)


def score(p: Column, ltv: Column, max_ltv: Column, tenure: Column, services: Column) -> Column:
    cap = lambda x: F.least(F.lit(100.0), x)
    w = rules.SCORE_WEIGHTS
    raw = w["churn"] * ((1.0 - p) * 100) + w["ltv"] * cap(F.ln(ltv + 1) / F.ln(max_ltv + 1) * 100) + w["tenure"] * cap(tenure / 72.0 * 100) + w["services"] * cap(services / 8.0 * 100)
    return rnd(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 6)


def score_category(s: Column) -> Column:
    return chain(((s >= low, name) for low, name in rules.SCORE_CATEGORIES), "Critical")


def segment() -> Column:
    m, t = C("monthly_charges"), C("tenure_months")
    return chain((((m >= 80.0) & (t >= 24), "High-Value Subscribers"), (t >= 36, "Loyal Subscribers"), (m < 45.0, "Budget Subscribers")), "Growth Subscribers")


def rfm_fixed(p: Column, tenure: Column, total: Column) -> dict[str, Column]:
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(5), x.cast("int")))
    return {"r_score": clamp(F.bround((1.0 - p) * 5, 0)), "f_score": clamp(F.floor(tenure / 15.0) + 1), "m_score": clamp(F.floor(total / 1500.0) + 1)}


def persona(r: Column, f: Column, m: Column) -> Column:
    return chain(
        (
            ((r >= 4) & (f >= 4) & (m >= 4), "VIP Subscribers"), ((r >= 3) & (f >= 3) & (m >= 4), "Loyal Subscribers"), ((r >= 3) & (f >= 3), "High-Potential Subscribers"),
            ((r <= 2) & (f >= 3), "At-Risk Subscribers"), ((r <= 2) & (f <= 2), "Churned Subscribers"),
        ),
        "Dormant Subscribers",
    )


def recommendations(p: Column, ltv: Column) -> Column:
    """Array of (rule, recommendation, priority, confidence, saved) in priority order; the last rule if no other holds."""
    online = ~F.lower("internet_service").contains("no")
    holds = (
        (p >= rules.MEDIUM_RISK) & (ltv >= 3500.0), F.lower("contract_type").contains("month-to-month"), F.lower("tech_support").contains("no") & online, (C("total_services") <= 2) & online, C("is_auto_payment") == 0,
    )

    def item(i):
        name, priority, confidence, share = rules.RECOMMENDATIONS[i]
        return F.struct(F.lit(rules.PRIORITIES[priority]).alias("rank"), F.lit(i + 1).alias("rule"), F.lit(name).alias("recommendation"), F.lit(priority).alias("priority"), (p if confidence is None else F.lit(confidence)).alias("confidence"), rnd(p * ltv * share, 2).alias("saved"))

    found = F.array_sort(F.array_compact(F.array(*(F.when(h, item(i)) for i, h in enumerate(holds)))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(item(5)))
