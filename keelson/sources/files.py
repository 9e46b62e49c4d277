"""Readers of subscriber files. Every path is the caller's and may be any Hadoop URI; a missing path raises Spark's error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The columns that scoring and cleaning need, in the order of a stream's files.
CORE_SCHEMA = "customerID string, gender string, tenure int, MonthlyCharges double, TotalCharges string, Churn string"
#: All 21 columns of a raw file.
RAW_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, tenure int, PhoneService string, MultipleLines string, InternetService string, OnlineSecurity string, OnlineBackup string, "
    "DeviceProtection string, TechSupport string, StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)


def _named(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, found by name among columns of text; absent ones and what doesn't fit is null."""
    fields = StructType.fromDDL(schema).fields
    return rows.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def read_csv(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Rows of CSV files with a header, which says where each column is; fields that don't fit their type become null."""
    return _named(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path), schema)


def read_folder(spark: SparkSession, folder: str, schema: str = RAW_SCHEMA, pattern: str = "*.csv") -> DataFrame:
    """All files of a folder that match, with one header, and the file each row is from."""
    rows = spark.read.option("header", True).option("pathGlobFilter", pattern).csv(folder).withColumn("file", F.col("_metadata.file_path"))
    return _named(rows, schema + ", file string")


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str = RAW_SCHEMA) -> DataFrame:
    """CSV or Parquet, by ``kind`` or else by the suffix of the path."""
    kind = (kind or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in ("csv", "parquet"):
        raise ValueError(f"neither csv nor parquet: {kind}")
    return spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path, schema)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document for each day, with the date from its file name (yyyy-mm-dd); files without a date go."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder)
    day = F.regexp_extract(F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})", 0), r"(.+)", 1)
    return rows.withColumn("day", F.try_to_date(day)).filter("day is not null").orderBy("day")


def psi_trend(reports: DataFrame) -> DataFrame:
    """(day, feature, psi) of report rows that hold a map ``numerical_drift`` of feature to PSI."""
    return reports.select("day", F.explode("numerical_drift").alias("feature", "psi"))
