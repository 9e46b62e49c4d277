"""Subscriber views derived from the ``customer`` table; the same text runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUB = """
WITH a AS (
  SELECT c_custkey AS k, c_name AS customer_id,
    CASE WHEN (c_custkey*7+1)%2=0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN (c_custkey*13+5)%100<16 THEN 1 ELSE 0 END AS senior_citizen,
    CASE WHEN (c_custkey*17+3)%100<48 THEN 'Yes' ELSE 'No' END AS partner,
    CASE WHEN (c_custkey*29+7)%100<30 THEN 'Yes' ELSE 'No' END AS dependents,
    CAST((c_custkey*37+11)%73 AS INT) AS tenure_months,
    CASE WHEN (c_custkey*11+2)%100<90 THEN 'Yes' ELSE 'No' END AS phone_service,
    CASE WHEN (c_custkey*19+4)%100<44 THEN 'Fiber optic' WHEN (c_custkey*19+4)%100<78 THEN 'DSL' ELSE 'No' END AS internet_service,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE') THEN 'Month-to-month'
         WHEN c_mktsegment='MACHINERY' THEN 'One year' ELSE 'Two year' END AS contract_type,
    CASE WHEN (c_custkey*23+9)%100<59 THEN 'Yes' ELSE 'No' END AS paperless_billing,
    CASE c_nationkey%4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
         WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS payment_method,
    ROUND(CAST(18.25 AS DOUBLE)+(FLOOR(ABS(c_acctbal)*100)%10051)/CAST(100 AS DOUBLE),2) AS monthly_charges
  FROM customer),
b AS (
  SELECT a.*,
    CASE WHEN phone_service='No' THEN 'No phone service' WHEN (k*31+8)%100<42 THEN 'Yes' ELSE 'No' END AS multiple_lines,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*41+1)%100<37 THEN 'Yes' ELSE 'No' END AS online_security,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*43+6)%100<44 THEN 'Yes' ELSE 'No' END AS online_backup,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*47+2)%100<44 THEN 'Yes' ELSE 'No' END AS device_protection,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*53+3)%100<37 THEN 'Yes' ELSE 'No' END AS tech_support,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*59+5)%100<49 THEN 'Yes' ELSE 'No' END AS streaming_tv,
    CASE WHEN internet_service='No' THEN 'No internet service' WHEN (k*61+9)%100<50 THEN 'Yes' ELSE 'No' END AS streaming_movies,
    ROUND(monthly_charges*tenure_months,2) AS total_charges
  FROM a),
c AS (
  SELECT b.*, ROUND(1/(1+EXP(-(CAST(-1.3 AS DOUBLE)
      + CASE contract_type WHEN 'Month-to-month' THEN 1.1 WHEN 'Two year' THEN -1.2 ELSE 0 END
      - tenure_months*CAST(0.03 AS DOUBLE) + monthly_charges*CAST(0.01 AS DOUBLE)
      + CASE WHEN internet_service='Fiber optic' THEN 0.5 ELSE 0 END
      - CASE WHEN tech_support='Yes' THEN 0.4 ELSE 0 END
      + CASE WHEN payment_method='Electronic check' THEN 0.3 ELSE 0 END))),6) AS churn_probability
  FROM b)
SELECT c.*, CASE WHEN ((k*7919)%1000)/CAST(1000 AS DOUBLE)<churn_probability THEN 1 ELSE 0 END AS churn FROM c
"""

#: Raw columns that are plain renames of clean ones.
PLAIN = {
    "SeniorCitizen": "senior_citizen", "Partner": "partner", "Dependents": "dependents", "PhoneService": "phone_service", "MultipleLines": "multiple_lines", "InternetService": "internet_service",
    "OnlineSecurity": "online_security", "OnlineBackup": "online_backup", "DeviceProtection": "device_protection", "TechSupport": "tech_support", "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies", "Contract": "contract_type", "PaperlessBilling": "paperless_billing", "PaymentMethod": "payment_method",
}
_plain = ", ".join(f'{clean} AS "{raw}"' for raw, clean in PLAIN.items())
RAW = f"""
SELECT k*2 AS row_no, CASE WHEN k%9=0 THEN CONCAT('  ',customer_id,' ') ELSE customer_id END AS "customerID",
  CASE WHEN k%61=0 THEN 'Unknown' ELSE gender END AS gender, tenure_months AS tenure, monthly_charges AS "MonthlyCharges",
  CASE WHEN tenure_months=0 OR k%40=0 THEN ' ' ELSE CONCAT(' ',CAST(total_charges AS VARCHAR(32))) END AS "TotalCharges",
  CASE WHEN k%97=0 THEN 'Maybe' WHEN churn=1 THEN 'Yes' ELSE 'No' END AS "Churn", {_plain} FROM sub
UNION ALL
SELECT k*2+1, customer_id, gender, tenure_months+1, monthly_charges, CAST(total_charges AS VARCHAR(32)), 'No', {", ".join(PLAIN.values())} FROM sub WHERE k%50=0
"""


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean subscribers with a churn probability and label."""
    return spark.sql(SUB.replace("FROM customer)", "FROM {customer})"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def raw_subscribers(sub: DataFrame) -> DataFrame:
    """Dirty raw subscribers: padding, blanks, repeated ids, bad labels; row_no is the file order."""
    return sub.sparkSession.sql(RAW.replace('"', "`").replace("FROM sub", "FROM {sub}"), sub=sub)
