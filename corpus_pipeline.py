"""A training corpus from raw documents: stages that each write Parquet and read it again.

toxicity -> near duplicates -> personal data -> mixing -> packing. All but the last return the columns of
``documents``; the last returns a row for each packed piece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import mixing, packing, simhash, surrogates, toxicity
from keelson.llm.common import read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the network, XXH64 or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written below spark.checkpoint.dir and read again."""
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/keelson/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
