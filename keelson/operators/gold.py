"""The scored subscriber table that KPIs, reports and decisions read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f
from ..functions import rules

C = F.col


def engineered(sub: DataFrame) -> DataFrame:
    return sub.withColumns({"total_services": f.total_services(), "tenure_group": f.tenure_group(C("tenure_months")), "is_auto_payment": f.auto_payment(C("payment_method")), "charges_ratio": f.charges_ratio(), "total_charges_log": f.charges_log()})


def scored(sub: DataFrame) -> DataFrame:
    """Features, values, segment, personas, score and first recommendation of every subscriber."""
    p = C("churn_probability")
    rows = engineered(sub).withColumns({"predicted_ltv": f.ltv_total(), "projected_future_ltv": f.ltv_projected(p), "customer_segment": f.segment(), **f.rfm_fixed(p, C("tenure_months"), C("total_charges"))})
    highest = rows.agg(F.max("predicted_ltv").alias("max_ltv"))
    rows = rows.withColumn("max_ltv", highest.scalar())
    rows = rows.withColumn("intelligence_score", f.score(p, C("predicted_ltv"), C("max_ltv"), C("tenure_months"), C("total_services")))
    first = F.element_at(f.recommendations(p, C("predicted_ltv")), 1)
    rows = rows.withColumns({"intelligence_category": f.score_category(C("intelligence_score")), "rfm_persona": f.persona(C("r_score"), C("f_score"), C("m_score")), "first": first})
    return rows.withColumns({"primary_recommendation": C("first.recommendation"), "recommendation_priority": C("first.priority"), "estimated_revenue_saved": C("first.saved")}).drop("first", "max_ltv")


def levels(p: Column, threshold: float = rules.HIGH_RISK) -> dict[str, Column]:
    """Prediction, risk label and confidence of a probability."""
    label, confidence = rules.ABOVE_THRESHOLD
    below = F.when(p < rules.SURE_BELOW, "High").otherwise("Medium")
    return {
        "churn_prediction": (p >= threshold).cast("int"),
        "risk_level": f.chain((*((p >= low, name) for low, name, _ in rules.MODEL_LEVELS), (p >= threshold, label)), rules.BELOW_THRESHOLD),
        "confidence": f.chain((*((p >= low, sure) for low, _, sure in rules.MODEL_LEVELS), (p >= threshold, confidence)), below),
    }


def bundled(rows: DataFrame) -> DataFrame:
    """What a row with a ``churn_probability`` gets at ingestion, from its own columns."""
    p, monthly, months = C("churn_probability"), C("monthly_charges"), F.greatest(F.lit(1), C("tenure_months"))
    offer = lambda i: f.chain(((p >= o[0], o[i]) for o in rules.INGEST_OFFERS[:-1]), rules.INGEST_OFFERS[-1][i])
    segment = f.chain((((monthly >= 80.0) & (months >= 24), "High-Value Subscribers"), (months >= 36, "Loyal Subscribers"), (monthly < 45.0, "Budget Subscribers")), "Growth Subscribers")
    return rows.withColumns({
        **levels(p), "predicted_ltv": f.ltv_total(), "projected_future_ltv": f.ltv_projected(p), "intelligence_score": f.rnd((1.0 - p) * 100.0, 1), "customer_segment": segment,
        "primary_recommendation": offer(1), "recommendation_priority": offer(2), "estimated_revenue_saved": f.rnd(monthly * offer(3) * offer(4), 2),
        "rfm_persona": F.when(monthly > 70.0, "High Spender").otherwise("Regular Subscriber"),
    })


def bundle(rows: DataFrame) -> DataFrame:
    """Score and bundle rows that come in; absent columns and nulls have their defaults."""
    for c, v in rules.COLUMN_DEFAULTS.items():
        rows = rows.withColumn(c, F.coalesce(C(c), F.lit(v)) if c in rows.columns else F.lit(v))
    return bundled(rows.withColumn("churn_probability", f.linear_probability()))


def money(c, digits: int = 6):
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast(f"decimal(18,{digits})") if isinstance(c, str) else c.cast(f"decimal(18,{digits})")).cast("double")


def mean(c, digits: int = 6):
    return money(c, digits) / F.count(c if isinstance(c, str) else c)
