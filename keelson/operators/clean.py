"""Cleaning of raw subscriber rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fixture import PLAIN

C = F.col
RENAMED = {"customerID": "customer_id", "tenure": "tenure_months", "MonthlyCharges": "monthly_charges", "TotalCharges": "total_charges", "Churn": "churn", **PLAIN}


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMED)


def trimmed(df: DataFrame) -> DataFrame:
    return df.select(*(F.trim(c).alias(c) if kind == "string" else C(c) for c, kind in df.dtypes))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def number(c: str):
    return C(c).try_cast("double")


def imputed(df: DataFrame) -> DataFrame:
    """Totals that aren't numbers: 0 in the first month, else one monthly charge; ``imputed`` tells."""
    total = number("total_charges")
    fill = F.when(total.isNotNull(), total).when(C("tenure_months") == 0, 0.0).otherwise(C("monthly_charges"))
    return df.withColumns({"imputed": total.isNull().cast("int"), "total_charges": fill})


def labelled(df: DataFrame) -> DataFrame:
    """Yes and No become 1 and 0; rows with other labels go."""
    return df.withColumn("churn", F.when(C("churn") == "Yes", 1).when(C("churn") == "No", 0)).filter("churn is not null")


def cleaned(raw: DataFrame) -> DataFrame:
    return labelled(imputed(first_of_each(trimmed(renamed(raw)), "customer_id", "row_no")))


def numbered(df: DataFrame, order: str, out: str, width: int = 65_536) -> DataFrame:
    """Adds the place (from 0) of each row by an integer column without repeated values.

    Rows are counted by ranges of that column and numbered within each, so no task sees more than a range."""
    rows = df.withColumn("__b", F.floor(C(order) / width))
    ranges = rows.groupBy("__b").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    return rows.withColumn("__i", inside).join(ranges.select("__b", before.alias("__before")), "__b").withColumn(out, C("__before") + C("__i")).drop("__b", "__i", "__before")


def with_ids(df: DataFrame, order: str, stamp: str) -> DataFrame:
    """Adds ``customer_id``: the trimmed id column (by name), or TEL-stamp-place where a table has none."""
    found = next((c for c in df.columns if c == "id" or c.lower() in ("customer_id", "customerid")), None)
    if found:
        return df.withColumn("customer_id", F.trim(C(found).cast("string")))
    return numbered(df, order, "__n").withColumn("customer_id", F.format_string(f"TEL-{stamp}-%04d", "__n")).drop("__n")


def with_absent_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Adds the columns that are absent with their defaults; nulls of columns that are there stay."""
    return df.select("*", *(F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns))


def input_failures(df: DataFrame, key: str, schema: dict) -> DataFrame:
    """(key, column, check, value) of all values that a model's input schema refuses, found in one pass."""
    found = []
    for c, (kind, low, allowed) in schema.items():
        as_text = C(c).cast("string")
        typed = as_text.try_cast(kind)
        bad = F.when(C(c).isNull(), "missing").when(typed.isNull(), "type")
        bad = bad if low is None else bad.when(typed < low, "range")
        bad = bad if allowed is None else bad.when(~typed.isin(*allowed), "domain")
        found.append(F.when(bad.isNotNull(), F.struct(F.lit(c).alias("column"), bad.alias("check"), as_text.alias("value"))))
    return df.select(key, F.inline(F.array_compact(F.array(*found))))


def display_name(column: str) -> str:
    words = column.replace("_", " ").title()
    for plain, shown in (("Ltv", "LTV"), ("Id", "ID"), ("Rfm", "RFM")):
        words = words.replace(plain, shown)
    return words


def plain_name(label: str) -> str:
    return label.strip().lower().replace(" ", "_").replace("-", "_")
