"""Writers of reports, logs and versioned tables. Every path is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def write_csv(df: DataFrame, uri: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(uri)


def write_report(df: DataFrame, uri: str, day: str) -> None:
    """JSON documents of a run date; writing a date again replaces that date alone."""
    df.withColumn("run_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(uri)


def append_log(df: DataFrame, uri: str, ts: str = "ts") -> None:
    """Append records to a log that is partitioned by their date."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(uri)


def put_version(df: DataFrame, uri: str, version: int) -> None:
    """Store a batch as a version of its own; the same version again replaces itself, so a replay changes nothing.

    What is written grows with the batch, not with the table."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(uri)


def newest(spark: SparkSession, uri: str, key: str) -> DataFrame:
    """The row of the highest version for each key; of several in one version the greatest row."""
    rows = spark.read.parquet(uri)
    own = [c for c in rows.columns if c not in (key, "version")]
    last = rows.groupBy(key).agg(F.max(F.struct("version", *own)).alias("__r"))
    return last.select(key, *(C("__r").getField(c).alias(c) for c in own))
