"""DuckDB views that the oracles share."""

from ..functions import rules
from ..sources.fixture import RAW, SUB

_half = lambda x, n: f"(FLOOR(({x}) * {float(10**n)} + 0.5) / {float(10**n)})"
_services = " + ".join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for c in rules.SERVICES)
_rec = rules.RECOMMENDATIONS


def _rule(i: int, holds: str) -> str:
    name, priority, _, share = _rec[i]
    return f"SELECT customer_id, {rules.PRIORITIES[priority]} AS rank, {i + 1} AS rule, '{name}' AS recommendation, '{priority}' AS priority, {_half(f'churn_probability * predicted_ltv * {share}::DOUBLE', 2)} AS saved FROM eng2 WHERE {holds}"


_recs = " UNION ALL ".join(
    _rule(i, h)
    for i, h in enumerate((
        "churn_probability >= 0.4 AND predicted_ltv >= 3500", "contract_type = 'Month-to-month'", "tech_support LIKE 'No%' AND internet_service <> 'No'", "total_services <= 2 AND internet_service <> 'No'", "is_auto_payment = 0",
    ))
)
_roi = " UNION ALL ".join(
    f"SELECT customer_id, '{n}' AS strategy, {_half(f'annual * {s}::DOUBLE + {c}::DOUBLE', 2)} AS cost, {_half(f'least(0.95::DOUBLE, 1.0::DOUBLE - churn_probability + {r}::DOUBLE)' if r else '1.0::DOUBLE - churn_probability', 3)} AS retention, annual FROM (SELECT *, monthly_charges * 12.0::DOUBLE AS annual FROM sub)"
    for n, s, c, r in rules.STRATEGIES
)
_cat = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v, churn FROM sub" for c in ("gender", "contract_type", "internet_service", "payment_method"))
_score = "0.3::DOUBLE * ((1.0::DOUBLE - churn_probability) * 100) + 0.3::DOUBLE * least(100.0::DOUBLE, ln(predicted_ltv + 1) / ln(max_ltv + 1) * 100) + 0.2::DOUBLE * least(100.0::DOUBLE, tenure_months / 72.0::DOUBLE * 100) + 0.2::DOUBLE * least(100.0::DOUBLE, total_services / 8.0::DOUBLE * 100)"

VIEWS = {
    "sub": SUB,
    "raw": RAW,
    "eng": f"SELECT *, {_services} AS total_services, CASE WHEN tenure_months <= 12 THEN '0-12m' WHEN tenure_months <= 24 THEN '12-24m' WHEN tenure_months <= 48 THEN '24-48m' WHEN tenure_months <= 60 THEN '48-60m' ELSE '60m+' END AS tenure_group, CASE WHEN payment_method LIKE '%(automatic)' THEN 1 ELSE 0 END AS is_auto_payment FROM sub",
    "eng2": f"SELECT *, {_half('monthly_charges * greatest(1, tenure_months)', 2)} AS predicted_ltv, {_half('monthly_charges * 24.0::DOUBLE * (1.0::DOUBLE - churn_probability)', 2)} AS projected_future_ltv, CASE WHEN monthly_charges >= 80 AND tenure_months >= 24 THEN 'High-Value Subscribers' WHEN tenure_months >= 36 THEN 'Loyal Subscribers' WHEN monthly_charges < 45 THEN 'Budget Subscribers' ELSE 'Growth Subscribers' END AS customer_segment, CAST(greatest(1, least(5, round_even((1.0::DOUBLE - churn_probability) * 5, 0))) AS INT) AS r_score, CAST(greatest(1, least(5, tenure_months // 15 + 1)) AS INT) AS f_score, CAST(greatest(1, least(5, floor(total_charges / 1500) + 1)) AS INT) AS m_score FROM eng",
    "recs0": _recs,
    "recs": f"SELECT * FROM recs0 UNION ALL SELECT customer_id, 3, 6, '{_rec[5][0]}', 'Low', 0.0 FROM eng2 WHERE customer_id NOT IN (SELECT customer_id FROM recs0)",
    "firsts": "SELECT customer_id, recommendation AS primary_recommendation, priority AS recommendation_priority, saved AS estimated_revenue_saved FROM recs QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY rank, rule) = 1",
    "gold0": f"SELECT eng2.*, {_half(f'least(100.0::DOUBLE, greatest(0.0::DOUBLE, {_score}))', 6)} AS intelligence_score, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'VIP Subscribers' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 4 THEN 'Loyal Subscribers' WHEN r_score >= 3 AND f_score >= 3 THEN 'High-Potential Subscribers' WHEN r_score <= 2 AND f_score >= 3 THEN 'At-Risk Subscribers' WHEN r_score <= 2 AND f_score <= 2 THEN 'Churned Subscribers' ELSE 'Dormant Subscribers' END AS rfm_persona FROM eng2, (SELECT max(predicted_ltv) AS max_ltv FROM eng2)",
    "gold": "SELECT gold0.*, CASE WHEN intelligence_score >= 80 THEN 'Excellent' WHEN intelligence_score >= 60 THEN 'Good' WHEN intelligence_score >= 40 THEN 'Moderate' WHEN intelligence_score >= 20 THEN 'Poor' ELSE 'Critical' END AS intelligence_category, primary_recommendation, recommendation_priority, estimated_revenue_saved FROM gold0 JOIN firsts USING (customer_id)",
    "roi": f"SELECT customer_id, strategy, cost, retention, {_half(_half('retention * annual', 2) + ' - cost', 2)} AS net FROM ({_roi})",
    "chi0": f"SELECT *, count(*) OVER (PARTITION BY name) AS total FROM ({_cat})",
    "chi1": "SELECT name, v, churn, n, sum(n) OVER (PARTITION BY name, v)::DOUBLE AS a, sum(n) OVER (PARTITION BY name, churn)::DOUBLE AS b, sum(n) OVER (PARTITION BY name)::DOUBLE AS s FROM (SELECT name, v, churn, count(*) AS n FROM chi0 GROUP BY ALL)",
    "chi2": "SELECT name, s, count(DISTINCT v) AS r, count(DISTINCT churn) AS c FROM chi1 GROUP BY ALL",
    "chi": "SELECT name, CAST(s AS BIGINT) AS total, least(r - 1, c - 1) AS least, (r - 1) * (c - 1) AS dof, sum(power(CASE WHEN r = 2 AND c = 2 THEN abs(n - a * b / s) - least(0.5, abs(n - a * b / s)) ELSE abs(n - a * b / s) END, 2) / (a * b / s)) AS chi2 FROM chi1 JOIN chi2 USING (name, s) GROUP BY ALL",
    "e1": "SELECT list_sort(list_distinct(quantile_cont(monthly_charges, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM sub WHERE k % 2 = 0",
    "all_bins": "SELECT k, least(len(list_filter(e, lambda x: x <= monthly_charges)), len(e) - 1) - 1 AS bin FROM sub, e1 WHERE monthly_charges BETWEEN e[1] AND e[-1]",
    "now_bins": "SELECT CAST(bin AS INT) AS bin FROM all_bins WHERE k % 2 = 1",
    "psi0": "SELECT i AS bin, CASE WHEN coalesce(a, 0) = 0 THEN 1e-6::DOUBLE ELSE a END AS x, CASE WHEN coalesce(b, 0) = 0 THEN 1e-6::DOUBLE ELSE b END AS y, coalesce(b, 0) AS b FROM (SELECT unnest(range(len(e) - 1)) AS i FROM e1) LEFT JOIN (SELECT bin AS i, count_if(k % 2 = 0)::DOUBLE AS a, count_if(k % 2 = 1)::DOUBLE AS b FROM all_bins GROUP BY 1) USING (i)",
    "psi1": "SELECT abs(sum((y / sy - x / sx) * ln((y / sy) / (x / sx)))) AS psi, CAST(sum(b) AS BIGINT) AS n_now FROM psi0, (SELECT sum(x) AS sx, sum(y) AS sy FROM psi0)",
}


def _counted(sql: str) -> str:
    """count_if(...) as BIGINT; DuckDB gives HUGEINT."""
    head, mark, rest = sql.partition("count_if(")
    if not mark:
        return sql
    depth = 1
    for i, c in enumerate(rest):
        depth += (c == "(") - (c == ")")
        if not depth:
            return f"{head}CAST({mark}{rest[: i + 1]} AS BIGINT){_counted(rest[i + 1 :])}"
    raise ValueError(sql)


def with_views(sql: str) -> str:
    """``sql`` with the views in front of it; it may begin with views of its own."""
    sql = _counted(sql.strip())
    views = ", ".join(f"{n} AS ({v.strip()})" for n, v in VIEWS.items())
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
