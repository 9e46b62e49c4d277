"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_dir

#: One word: a run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    It cuts the lineage (a lost executor costs no recomputation of what came before) and gives the
    planner the true size of the table. Results are lazy and read these tables, so nothing here deletes them: the
    caller removes ``keelson`` below the shared folder when the results are stored."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keelson/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send a module's functions to the workers by value: executors need no copy of this package."""
    register_pickle_by_value(sys.modules[module])
