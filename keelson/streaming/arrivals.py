"""Structured Streaming jobs: files that arrive are checked, cleaned and stored; events are rolled up by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as f
from ..operators import clean, sinks, store
from ..sources.files import CORE_SCHEMA

C = F.col
VALID = "trim(customerID) <> '' and gender in ('Female', 'Male') and Churn in ('Yes', 'No') and tenure >= 0 and MonthlyCharges >= 0"


def import_log(rows: DataFrame) -> DataFrame:
    """(file, n_rows, n_valid, outcome) of rows with ``file`` and ``ok``: processed with a valid row, else failed."""
    log = rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_valid"))
    return log.withColumn("outcome", F.when(C("n_valid") > 0, "processed").otherwise("failed"))


def store_batch(rows: DataFrame, batch: int, table: str, log: str) -> None:
    """Valid rows of a batch go to ``table`` as version ``batch``, the outcome of each file to ``log``.

    Of repeated ids the first row counts, by file and then by the row's own values. Both writes replace what the same
    batch wrote before, so a restarted batch changes nothing. Rows without a valid id are counted and go no further."""
    rows = rows.withColumn("ok", F.coalesce(F.expr(VALID), F.lit(False)))
    good = clean.trimmed(clean.renamed(rows.filter("ok").drop("ok")))
    order = F.struct("file", *(c for c in good.columns if c != "file"))
    first = clean.first_of_each(good.withColumn("row_no", order), "customer_id", "row_no").drop("row_no", "file")
    sinks.put_version(clean.labelled(clean.imputed(first)), table, batch)
    sinks.put_version(import_log(rows), log, batch)


def watch(spark: SparkSession, folder: str, table: str, log: str, checkpoint: str, every: str | None = None, schema: str = CORE_SCHEMA) -> StreamingQuery:
    """Take in new CSV files of a folder: what is there now, or for good at each ``every`` (such as ``1 minute``).

    The checkpoint knows which files were read, so files need not be moved."""
    rows = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(folder).withColumn("file", C("_metadata.file_path"))
    out = rows.writeStream.foreachBatch(lambda df, batch: store_batch(df, batch, table, log)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def by_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) of events, as a stream or a table; a stream keeps a day's state until it is ``late``."""
    rows = events.withColumn("at", C("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(C("value").cast("decimal(18,4)")).alias("total"))
    return out.select(C("w.start").alias("day"), "event_type", "n", "total")


def rescore(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Score subscriber rows that were added to a table of Parquet files, now or at each ``every`` (such as ``5 minutes``).

    Each batch is stored as a version of its own, so a replay changes nothing."""

    def store(rows: DataFrame, batch: int) -> None:
        p = f.linear_probability()
        sinks.put_version(rows.select("customer_id", p.alias("churn_probability"), f.tier3(p).alias("risk")), table, batch)

    out = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def upserts(rows: DataFrame, to: store.Store, name: str, key: str, checkpoint: str, order: str | None = None, share: float = store.FOLD) -> StreamingQuery:
    """Keep the last row of each key of a stream in a table of a store: what is there now, then it ends.

    A batch is one commit whose name has the stream's batch number, so a batch that runs again after a restart changes
    nothing. After each batch the buckets with many old versions are folded."""

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(to, name, batch, key, f"{name}-stream-{number}", order)
        store.fold(to, name, key, share)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = "day date, outcome string, files long, records long, valid long, latest timestamp"


def running_state(log: DataFrame, to: store.Store, name: str, checkpoint: str) -> StreamingQuery:
    """Counters by day and outcome over a stream of import records (file, at, n_rows, n_valid, outcome).

    The state is Spark's own: a streaming aggregate in update mode hands on the counters that have changed, with
    what came before, and they replace those in the store. So a replayed batch writes the same counters."""
    counts = log.groupBy(F.to_date("at").alias("day"), "outcome").agg(F.count("*").alias("files"), F.sum("n_rows").alias("records"), F.sum("n_valid").alias("valid"), F.max("at").alias("latest"))
    keyed = counts.withColumn("key", F.concat_ws("/", F.col("day").cast("string"), "outcome"))

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(to, name, batch, "key", f"{name}-stream-{number}", order="files")
        store.fold(to, name, "key")

    return keyed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_state(to: store.Store, name: str) -> DataFrame:
    """(day, files_ok, files_failed, records, valid, last_sync) of the counters in the store."""
    rows = store.state(to, name, "key").groupBy("day")
    of = lambda outcome: F.coalesce(F.sum(F.when(C("outcome") == outcome, C("files"))), F.lit(0))
    return rows.agg(of("processed").alias("files_ok"), of("failed").alias("files_failed"), F.sum("records").alias("records"), F.sum("valid").alias("valid"), F.max("latest").alias("last_sync"))
