"""Checks of raw and clean subscribers by one table of rules, inside the job that stages them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clean
from .store import COLUMNS, Store, load

C = F.col
#: Values of the columns that have a closed set of them. Fixed values.
YES_NO, NET = ("Yes", "No"), ("Yes", "No", "No internet service")
PAYMENTS = ("Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)")
#: Clean column: type, lowest value, allowed values; nulls are allowed nowhere.
RULES = {
    "customer_id": ("string", None, None), "gender": ("string", None, ("Female", "Male")), "senior_citizen": ("int", None, (0, 1)), "partner": ("string", None, YES_NO), "dependents": ("string", None, YES_NO),
    "tenure_months": ("int", 0, None), "phone_service": ("string", None, YES_NO), "multiple_lines": ("string", None, ("Yes", "No", "No phone service")), "internet_service": ("string", None, ("DSL", "Fiber optic", "No")),
    "online_security": ("string", None, NET), "online_backup": ("string", None, NET), "device_protection": ("string", None, NET), "tech_support": ("string", None, NET), "streaming_tv": ("string", None, NET),
    "streaming_movies": ("string", None, NET), "contract_type": ("string", None, ("Month-to-month", "One year", "Two year")), "paperless_billing": ("string", None, YES_NO), "payment_method": ("string", None, PAYMENTS),
    "monthly_charges": ("double", 0, None), "total_charges": ("double", 0, None), "churn": ("int", None, (0, 1)),
}
_raw_name = {c: r for r, c in clean.RENAMED.items()}
#: Raw column: the same rules, but totals are any text and labels are words.
RAW_RULES = {_raw_name.get(c, c): rule for c, rule in RULES.items()} | {"TotalCharges": ("string", None, None), "Churn": ("string", None, YES_NO)}


def failures(df: DataFrame, rules: dict, closed: bool = False, unique: Column | None = None) -> Column:
    """The rules that a row breaks: array of (column, check, failure_value), in the order of the rules.

    check: column (absent from the table), missing (null), type, range, domain; unexpected for further columns of a
    ``closed`` schema; unique where ``unique`` is false, said of the first column."""
    out = []
    for c, (kind, low, allowed) in rules.items():
        if c not in df.columns:
            out.append((c, F.lit("column"), F.lit(None).cast("string")))
            continue
        text = C(f"`{c}`").cast("string")
        typed = text.try_cast(kind)
        bad = F.when(C(f"`{c}`").isNull(), "missing").when(typed.isNull(), "type")
        bad = bad if low is None else bad.when(typed < low, "range")
        out.append((c, bad if allowed is None else bad.when(~typed.isin(*allowed), "domain"), text))
    if unique is not None:
        first = next(iter(rules))
        out.append((first, F.when(~unique, "unique"), C(f"`{first}`").cast("string")))
    if closed:
        out += [(c, F.lit("unexpected"), F.lit(None).cast("string")) for c in df.columns if c not in rules]
    return F.array_compact(F.array(*(F.when(bad.isNotNull(), F.struct(F.lit(c).alias("column"), bad.alias("check"), value.alias("failure_value"))) for c, bad, value in out)))


def raw_report(raw: DataFrame, index: str = "row_no") -> DataFrame:
    """(index, column, check, failure_value) of all rules that raw rows break; further columns are allowed."""
    return raw.select(C(index).alias("index"), F.inline(failures(raw, RAW_RULES)))


def clean_report(rows: DataFrame, index: str, closed: bool = True) -> DataFrame:
    """The same of clean rows: a closed schema but for the index, and an id may occur once.

    Ids are counted first (equal ids meet as counts, not as rows); only ids that repeat are joined back."""
    again = rows.groupBy("customer_id").agg(F.count("*").alias("__n")).filter("__n > 1 AND customer_id IS NOT NULL")
    checked = rows.join(again, "customer_id", "left")
    shown = rows.drop(index)
    return checked.select(C(index).alias("index"), F.inline(failures(shown, RULES, closed, C("__n").isNull())))


def summary(report: DataFrame) -> DataFrame:
    """(column, check, n, failures_count, status) of a report: one row for each rule that is broken."""
    rows = report.groupBy("column", "check").agg(F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy())  # over one row a rule
    return rows.select("column", "check", "n", every.alias("failures_count"), F.lit("failed").alias("status"))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key with its number of rows, ``copies``; partial aggregates keep one row a key and task."""
    own = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*own), order).alias("r"), F.count("*").alias("copies")).select(key, "r.*", "copies")


def staged(rows: DataFrame, path: str, checks: Column, dropped: Column | None = None) -> tuple[DataFrame, dict]:
    """Write rows with their ``failures`` and their ``side`` (valid, failed, dropped) in one pass, and count them.

    Returns the stored rows and counts that are read from them, by their folders. No Observation is used: in this Spark
    version a session that has one can't run MLlib's logistic models any more (they carry the session)."""
    side = F.when(F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False), "dropped").when(F.size("failures") > 0, "failed").otherwise("valid")
    out = rows.withColumn("failures", checks).withColumn("side", side)
    out.write.mode("overwrite").partitionBy("side").parquet(path)
    stored = rows.sparkSession.read.schema(out.schema).parquet(path)
    return stored, stored.agg(F.count("*").alias("rows"), F.count_if(C("side") == "failed").alias("failed")).first().asDict()


def ingest(store: Store, raw: DataFrame, filename: str, batch: str, order: str = "row_no") -> dict:
    """Check raw rows (a warning), clean them, check the clean rows and load them; a bad clean row stops the load.

    One pass cleans, checks and stages: rows of an unknown label are dropped, others are valid or failed. Only if none
    has failed are they published, by one commit of the store; else the store stays at its last commit."""
    warned = raw.agg(F.sum(F.size(failures(raw, RAW_RULES))).alias("n")).first()["n"]
    rows = clean.trimmed(clean.renamed(raw))
    rows = first_rows(rows, "customer_id", order)
    rows = clean.imputed(rows).withColumn("churn", F.when(C("churn") == "Yes", 1).when(C("churn") == "No", 0))
    ids = rows.select(*(c for c in rows.columns if c in RULES))
    stored, seen = staged(rows, store.folder(batch, "checked"), failures(ids, RULES, closed=True), C("churn").isNull())
    count = stored.agg(F.count("*").alias("ids"), F.sum("copies").alias("rows"), F.count_if(C("side") == "dropped").alias("dropped"), F.count_if((C("side") != "dropped") & (C("imputed") == 1)).alias("imputed"), F.sum(F.when(C("side") == "failed", F.size("failures"))).alias("failures")).first()
    out = {"filename": filename, "initial": count["rows"] or 0, "duplicates_removed": (count["rows"] or 0) - count["ids"], "dropped_rows": count["dropped"], "missing_imputed": count["imputed"], "raw_failures": warned or 0, "failures_count": count["failures"] or 0}
    if seen["failed"]:
        return out | {"status": "failed", "rows_processed": 0, "rows_inserted": 0, "rows_skipped": 0, "rows_failed": 0}
    note = load(store, stored.filter("side = 'valid'").select(*COLUMNS), filename, batch)
    return out | {k: note[k] for k in ("status", "rows_processed", "rows_inserted", "rows_skipped", "rows_failed")}
