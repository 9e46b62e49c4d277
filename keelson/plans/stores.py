"""Queries that write through the stores and read back what they wrote, and the checks on the way there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f
from ..operators import check, clean, gold, store
from ..operators.store import COLUMNS, Store
from ..sources.fixture import SUB
from ..streaming import arrivals
from .measures import BUNDLE, BUNDLE_SQL
from .queries import T3, Tables, many

C = F.col


def new_store(t: Tables, schemas: dict[str, str] | None = None) -> Store:
    """An empty store in the shared folder, of the four related tables if nothing else is given."""
    return Store.create(t.spark, store.scratch(t.spark, "store"), schemas or store.SCHEMAS)


# checks
def _cases(rules: dict) -> list[tuple[str, str]]:
    """(column, CASE of the rule that it breaks) in SQL."""
    out = []
    for c, (kind, low, allowed) in rules.items():
        typed = f'TRY_CAST("{c}" AS {kind})'
        case = f"""CASE WHEN "{c}" IS NULL THEN 'missing' WHEN {typed} IS NULL THEN 'type'"""
        case += f" WHEN {typed} < {low} THEN 'range'" if low is not None else ""
        case += f" WHEN {typed} NOT IN ({', '.join(map(repr, allowed))}) THEN 'domain'" if allowed else ""
        out.append((c, case + " END"))
    return out


def _report_sql(rules: dict, rows: str, more: str = "") -> str:
    parts = [f"""SELECT row_no AS index, '{c}' AS "column", {case} AS "check", CAST("{c}" AS VARCHAR) AS failure_value FROM {rows}""" for c, case in _cases(rules)]
    return f"""SELECT * FROM ({" UNION ALL ".join(parts)}{more}) WHERE "check" IS NOT NULL"""


_raw_name = {c: r for r, c in clean.RENAMED.items()}
_TEXT = [c for c in COLUMNS if c not in ("senior_citizen", "tenure_months", "monthly_charges")]
#: Trimmed rows of all columns; the first of each id of those that a condition keeps; imputed and labelled.
_RENAMED = ", ".join(f'''{'trim("%s")' % _raw_name.get(c, c) if c in _TEXT else '"%s"' % _raw_name[c]} AS {c}''' for c in COLUMNS)
_IMPUTED = "* REPLACE (coalesce(TRY_CAST(total_charges AS DOUBLE), CASE WHEN tenure_months = 0 THEN 0.0 ELSE monthly_charges END) AS total_charges, CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn), CAST(TRY_CAST(total_charges AS DOUBLE) IS NULL AS INT) AS imputed"


def _whole(keep: str = "true") -> str:
    return f"WITH renamed AS (SELECT row_no, {_RENAMED} FROM raw WHERE {keep}), firsts1 AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS copies FROM renamed QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY row_no) = 1), imputed1 AS (SELECT {_IMPUTED} FROM firsts1)"


def unchecked(t: Tables) -> DataFrame:
    """Clean rows that still repeat ids, with a column that a closed schema doesn't have."""
    return clean.labelled(clean.imputed(clean.trimmed(clean.renamed(t.raw))))


def sides(t: Tables) -> DataFrame:
    """Raw rows on their side, read back from what one pass wrote, with all that is wrong with them."""
    stored, _ = check.staged(t.raw, store.scratch(t.spark, "sides"), check.failures(t.raw, check.RAW_RULES))
    return stored.select("row_no", "customerID", "side", F.array_join(F.transform("failures", lambda x: F.concat_ws(":", x["column"], x["check"])), ",").alias("reason"))


_reasons = ", ".join(f"'{c}:' || {case}" for c, case in _cases(check.RAW_RULES))
many(
    ("dq_raw", lambda t: check.raw_report(t.raw), _report_sql(check.RAW_RULES, "raw")),
    ("dq_report", lambda t: check.summary(check.raw_report(t.raw)), f"""SELECT "column", "check", count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS failures_count, 'failed' AS status FROM ({_report_sql(check.RAW_RULES, "raw")}) GROUP BY 1, 2"""),
    (
        "dq_clean",
        lambda t: check.clean_report(unchecked(t), "row_no"),
        f"WITH renamed AS (SELECT row_no, {_RENAMED} FROM raw), c AS (SELECT {_IMPUTED} FROM renamed WHERE churn IN ('Yes', 'No')) "
        + _report_sql(check.RULES, "c", " UNION ALL SELECT row_no, 'customer_id', CASE WHEN count(*) OVER (PARTITION BY customer_id) > 1 THEN 'unique' END, customer_id FROM c UNION ALL SELECT row_no, 'imputed', 'unexpected', NULL FROM c"),
    ),
    ("sink_quar", sides, f"""SELECT row_no, "customerID", CASE WHEN reason = '' THEN 'valid' ELSE 'failed' END AS side, reason FROM (SELECT row_no, "customerID", concat_ws(',', {_reasons}) AS reason FROM raw)"""),
)


# loads
def loaded(t: Tables) -> Store:
    """Two files, the second one twice (a replay), then its rows again in a further file, and a file with faults."""
    s = new_store(t)
    rows = t.sub.select("k", *COLUMNS)
    store.load(s, rows.filter("k % 3 = 0"), "first.csv", "load-1")
    for _ in range(2):
        store.load(s, rows, "all.csv", "load-2")
    store.load(s, rows, "again.csv", "load-3")
    faults = rows.filter("k % 5 = 0").withColumn("customer_id", F.when(C("k") % 10 != 0, C("customer_id")))
    store.load(s, faults.unionByName(faults.filter("k % 15 = 0")), "faults.csv", "load-4")
    return s


def ingested(t: Tables) -> tuple[Store, list[dict]]:
    """A first load, a file whose clean rows break a rule, and the same file mended."""
    s = new_store(t)
    store.load(s, t.sub.filter("k % 3 = 0"), "first.csv", "load-1")
    return s, [check.ingest(s, t.raw, "raw.csv", "load-2"), check.ingest(s, t.raw.filter("gender <> 'Unknown'"), "mended.csv", "load-3")]


def ingest_report(t: Tables) -> DataFrame:
    s, found = ingested(t)
    counts = ("initial", "duplicates_removed", "dropped_rows", "missing_imputed", "raw_failures", "failures_count", "rows_processed", "rows_inserted", "rows_skipped", "rows_failed")
    rows = [(r["filename"], r["status"], *(int(r[c]) for c in counts)) for r in found]
    out = t.spark.createDataFrame(rows, "filename string, status string, " + ", ".join(f"{c} long" for c in counts))
    return out.join(store.history(s).groupBy().agg(F.count("*").alias("loads")), how="cross")


_INGESTED = "SELECT 'raw.csv' AS filename, * FROM ({raw}) UNION ALL SELECT 'mended.csv', * FROM ({mended})"


def _ingest_sql(keep: str, ok: bool) -> str:
    load = "count_if(NOT gone)", "count_if(NOT gone AND NOT known)", "count_if(NOT gone AND known)"
    counts = ", ".join(f"CAST({x if ok else '0'} AS BIGINT) AS {n}" for x, n in zip((*load, "0"), ("rows_processed", "rows_inserted", "rows_skipped", "rows_failed")))
    broken = " + ".join(f"CASE WHEN {case} IS NOT NULL THEN 1 ELSE 0 END" for _, case in _cases(check.RULES))
    raw_broken = " + ".join(f"CASE WHEN {case} IS NOT NULL THEN 1 ELSE 0 END" for _, case in _cases(check.RAW_RULES))
    marked = f"{_whole(keep)} SELECT *, churn IS NULL AS gone, {broken} AS broken, customer_id IN (SELECT customer_id FROM sub WHERE k % 3 = 0) AS known FROM imputed1"
    return f"SELECT '{'success' if ok else 'failed'}' AS status, CAST(sum(copies) AS BIGINT) AS initial, CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed, count_if(gone) AS dropped_rows, count_if(NOT gone AND imputed = 1) AS missing_imputed, (SELECT CAST(sum({raw_broken}) AS BIGINT) FROM raw WHERE {keep}) AS raw_failures, CAST(coalesce(sum(broken) FILTER (NOT gone AND broken > 0), 0) AS BIGINT) AS failures_count, {counts}, CAST(2 AS BIGINT) AS loads FROM ({marked})"


_columns = ", ".join(COLUMNS)
_keys = "md5(customer_id) AS id, md5(customer_id) AS contract_id, md5(customer_id) AS service_id, md5(customer_id) AS billing_id"
_mended = f"{_whole('''gender <> 'Unknown' ''')} SELECT {_columns} FROM imputed1 WHERE churn IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM sub WHERE k % 3 = 0)"
many(
    ("sink_split", lambda t: store.joined(loaded(t)), f"SELECT {_keys}, {_columns} FROM sub"),
    (
        "sink_idem",
        lambda t: store.history(loaded(t)),
        "SELECT 1::BIGINT AS version, 'load-1' AS batch, 'first.csv' AS filename, count_if(k % 3 = 0) AS rows_processed, count_if(k % 3 = 0) AS rows_inserted, 0::BIGINT AS rows_skipped, 0::BIGINT AS rows_failed, 'success' AS status FROM sub "
        "UNION ALL SELECT 2, 'load-2', 'all.csv', count(*), count_if(k % 3 <> 0), count_if(k % 3 = 0), 0, 'success' FROM sub UNION ALL SELECT 3, 'load-3', 'again.csv', count(*), 0, count(*), 0, 'success' FROM sub "
        "UNION ALL SELECT 4, 'load-4', 'faults.csv', count_if(k % 5 = 0) + count_if(k % 15 = 0), 0, count_if(k % 10 = 5), count_if(k % 10 = 0) + count_if(k % 15 = 0), 'degraded' FROM sub",
    ),
    ("etl_pipeline", lambda t: store.joined(ingested(t)[0]).select(*COLUMNS), f"SELECT * FROM ({_mended}) UNION ALL SELECT {_columns} FROM sub WHERE k % 3 = 0"),
    ("etl_report", ingest_report, _INGESTED.format(raw=_ingest_sql("true", False), mended=_ingest_sql("gender <> 'Unknown' ", True))),
)


# versions
def upserted(t: Tables) -> DataFrame:
    """The last row of each id after three batches, with a fold after each; the last batch comes twice."""
    s = new_store(t, {"rows": "version long, id string, row_no long, tenure int"})
    rows = t.raw.select(F.trim("customerID").alias("id"), C("row_no").cast("long"), C("tenure").cast("int"))
    again = rows.filter("row_no % 6 = 0").withColumn("tenure", C("tenure") + 1)
    for n, batch in enumerate((rows.filter("row_no % 2 = 0"), rows.filter("row_no % 2 = 1"), again, again)):
        store.upsert(s, "rows", batch, "id", f"batch-{min(n, 2)}", order="row_no")
        store.fold(s, "rows", "id")
    return store.state(s, "rows", "id")


def predictions_updated(t: Tables) -> DataFrame:
    """Two stored columns of the ids that match; a null leaves what is there, further ids aren't inserted."""
    s = new_store(t, {"scores": "version long, customer_id string, churn_risk string, predicted_ltv double, tenure_months int"})
    store.upsert(s, "scores", t.sub.select("customer_id", F.lit("unknown").alias("churn_risk"), F.lit(0.0).alias("predicted_ltv"), "tenure_months"), "customer_id", "first")
    new = t.gold.filter("k % 3 = 0").select("k", "customer_id", F.when(C("k") % 6 != 0, f.tier3(C("churn_probability"))).alias("churn_risk"), "predicted_ltv")
    new = new.drop("k").unionByName(new.filter("k % 9 = 0").drop("k").withColumn("customer_id", F.concat(F.lit("new "), "customer_id")))
    for _ in range(2):
        store.update(s, "scores", new, "customer_id", ["churn_risk", "predicted_ltv"], "second")
    return store.state(s, "scores", "customer_id")


def streamed(t: Tables) -> DataFrame:
    """The same three batches as files that a stream takes in one by one; it is started again when there are no new ones."""
    at = store.scratch(t.spark, "stream")
    s = Store.create(t.spark, f"{at}/store", {"rows": "version long, id string, row_no long, tenure int"})
    rows = t.raw.select(F.trim("customerID").alias("id"), C("row_no").cast("long"), C("tenure").cast("int"))
    again = rows.filter("row_no % 6 = 0").withColumn("tenure", C("tenure") + 1)
    for batch in (rows.filter("row_no % 2 = 0"), rows.filter("row_no % 2 = 1"), again):
        batch.coalesce(1).write.mode("append").parquet(f"{at}/files")
        for _ in range(2):
            stream = t.spark.readStream.schema(rows.schema).parquet(f"{at}/files")
            arrivals.upserts(stream, s, "rows", "id", f"{at}/checkpoint", "row_no").awaitTermination()
    return store.state(s, "rows", "id")


def imports(t: Tables) -> DataFrame:
    """Import records of the log role of ``events``: an event is a file of its user's rows, ``error`` ones have failed."""
    ok = F.coalesce(C("event_type") != "error", F.lit(False))
    n = F.coalesce(C("user_id"), F.lit(0)) % 50 + 1
    return t.events.select(C("event_id").alias("file"), C("ts").cast("timestamp").alias("at"), n.alias("n_rows"), F.when(ok, n).otherwise(F.lit(0)).alias("n_valid"), F.when(ok, "processed").otherwise("failed").alias("outcome"))


def counted(t: Tables) -> DataFrame:
    """Counters of a stream over the import log in two parts, started again after each."""
    at = store.scratch(t.spark, "counters")
    s = Store.create(t.spark, f"{at}/store", {"counters": "version long, key string, " + arrivals.COUNTS})
    log = imports(t)
    for part in (0, 1):
        log.filter(F.pmod(F.hash("file"), F.lit(2)) == part).write.mode("append").parquet(f"{at}/log")
        for _ in range(2):
            arrivals.running_state(t.spark.readStream.schema(log.schema).parquet(f"{at}/log"), s, "counters", f"{at}/checkpoint").awaitTermination()
    return arrivals.sync_state(s, "counters").withColumn("last_sync", F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss"))


SCORED = ("contract_type", "monthly_charges", "churn_probability", *BUNDLE)


def database(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Subscribers with their optional contract and bill on two days; on the second a fourth of them has changed."""
    one = t.customers.filter("id % 10 <> 9").withColumn("updated_at", F.expr("timestampadd(MINUTE, id % 100, timestamp'2026-01-01 00:00:00')"))
    changed = F.col("id") % 4 == 0
    two = t.customers.withColumn("updated_at", F.when(changed | (C("id") % 10 == 9), F.expr("timestampadd(MINUTE, id % 10, timestamp'2026-01-02 00:00:00')")).otherwise(F.expr("timestampadd(MINUTE, id % 100, timestamp'2026-01-01 00:00:00')")))
    two = two.withColumn("tenure_months", F.when(changed, C("tenure_months") + 1).otherwise(C("tenure_months")))
    contracts = t.contracts.filter("id % 7 <> 0").withColumnRenamed("id", "contract_id")
    return tuple(rows.join(contracts, "contract_id", "left").join(t.billings.withColumnRenamed("id", "billing_id"), "billing_id", "left").drop("contract_id", "service_id", "billing_id", "churn") for rows in (one, two))


def synced(t: Tables) -> DataFrame:
    """Both days synced, each twice: rows are scored when they are new or have changed, and in no other sync."""
    s = new_store(t, {"scored": "version long, customer_id string, updated_at timestamp, sync int, " + ", ".join(f"{c} {'int' if c == 'churn_prediction' else 'double' if c in ('monthly_charges', 'churn_probability', 'predicted_ltv', 'projected_future_ltv', 'intelligence_score', 'estimated_revenue_saved') else 'string'}" for c in SCORED)})
    for n, rows in enumerate(rows for rows in database(t) for _ in range(2)):
        score = lambda df, n=n: gold.bundle(df).select("customer_id", "updated_at", F.lit(n).alias("sync"), *SCORED)
        store.sync(s, "scored", rows, "customer_id", score, f"sync-{n}")
    rows = store.state(s, "scored", "customer_id")
    return rows.select("customer_id", ((F.unix_timestamp("updated_at") - F.unix_timestamp(F.lit("2026-01-01 00:00:00").cast("timestamp"))) / 60).cast("long").alias("updated"), "sync", *SCORED)


_d = {k: repr(v) for k, v in gold.rules.COLUMN_DEFAULTS.items()}
_services = ", ".join(f"{_d[c]} AS {c}" for c in store.RELATIONS["services"])
_p = SUB[SUB.index("ROUND(1/(1+EXP") : SUB.index(" AS churn_probability")]
_src = f"src0 AS (SELECT * REPLACE ({_services}, CAST(CASE WHEN k % 4 = 0 THEN tenure_months + 1 ELSE tenure_months END AS INT) AS tenure_months, CASE WHEN k % 7 <> 0 THEN contract_type ELSE {_d['contract_type']} END AS contract_type, CASE WHEN k % 7 <> 0 THEN paperless_billing ELSE {_d['paperless_billing']} END AS paperless_billing, CASE WHEN k % 7 <> 0 THEN payment_method ELSE {_d['payment_method']} END AS payment_method) FROM sub), src AS (SELECT * REPLACE ({_p} AS churn_probability) FROM src0)"
_sync = f"WITH {_src} SELECT customer_id, CASE WHEN k % 4 = 0 OR k % 10 = 9 THEN 1440 + k % 10 ELSE k % 100 END AS updated, CAST(CASE WHEN k % 4 = 0 OR k % 10 = 9 THEN 2 ELSE 0 END AS INT) AS sync, contract_type, monthly_charges, churn_probability, {BUNDLE_SQL} FROM src"
_last = "SELECT customer_id AS id, CASE WHEN k % 3 <> 0 AND k % 50 = 0 THEN 2 * k + 1 ELSE 2 * k END AS row_no, CAST(CASE WHEN k % 3 = 0 OR k % 50 = 0 THEN tenure_months + 1 ELSE tenure_months END AS INT) AS tenure FROM sub"
_n = "(coalesce(user_id, 0) % 50 + 1)"
_ok = "coalesce(event_type <> 'error', false)"
many(
    ("sink_upsert", upserted, _last),
    ("st_upsert", streamed, _last),
    ("st_state", counted, f"SELECT CAST(ts AS DATE) AS day, count_if({_ok}) AS files_ok, count_if(NOT {_ok}) AS files_failed, CAST(sum({_n}) AS BIGINT) AS records, CAST(sum(CASE WHEN {_ok} THEN {_n} ELSE 0 END) AS BIGINT) AS valid, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_sync FROM events GROUP BY 1"),
    ("sink_predupd", predictions_updated, f"SELECT customer_id, CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN {T3} ELSE 'unknown' END AS churn_risk, CASE WHEN k % 3 = 0 THEN predicted_ltv ELSE 0.0::DOUBLE END AS predicted_ltv, tenure_months FROM gold"),
    ("src_dbsync", synced, _sync),
)
