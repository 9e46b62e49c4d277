"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, written

#: Salts over which the copies of one text are dealt before the last merge.
SALTS = 64
#: A group is hot if it holds more than 1 / HOT of all rows, so there are fewer than HOT hot groups.
HOT = 10_000


def rank(doc_id: str, text: str) -> Column:
    """One number by which rows of equal texts compare: code points of the text, then the smaller id; no id comes last.

    A number and not a struct, so that its maximum is kept in a hash aggregate."""
    place = f"coalesce(9223372036854775808BD - cast({doc_id} AS decimal(20, 0)), 0BD)"
    return F.expr(f"cast(length({text}) AS decimal(10, 0)) * 100000000000000000000BD + {place}")


def ranked_id(best: Column) -> Column:
    """The id within a rank."""
    place = best % F.expr("100000000000000000000BD")
    return F.when(place > 0, F.expr("9223372036854775808BD") - place).cast("long")


def contents(docs: DataFrame, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """(doc_id, content, text_sha256, key, rank, salt) of every row; ``content`` is the text without white space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.regexp_replace("text", GAP, "").alias("content"), rank("doc_id", "text").alias("rank"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("content").cast("binary"), 256))
    return rows.withColumns({"key": digest(F.col("text_sha256")), "salt": F.spark_partition_id() % salts})


def combined(rows: DataFrame) -> DataFrame:
    """(key, content, n, best) of each distinct content; whole contents are compared at each of three stages.

    Local: the partial aggregate keeps one row a content in each input partition, and all its copies there have
    one salt. Salted: partitions of one salt are merged, so a third of all rows is spread over the salts. Global:
    what is left, at most one row a salt, is merged by digest."""
    salted = rows.groupBy("key", "salt", "content").agg(F.count("*").alias("n"), F.max("rank").alias("best"))
    return salted.repartition("key").groupBy("key", "content").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def marked(docs: DataFrame, salts: int = SALTS, hot: int = HOT, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``, dropped ones too.

    Texts are equal if they agree without white space (U+0009 to U+000D, U+0020). Of equal texts the one with the
    most code points stays, then the smallest id; rows without an id come last, and if only such rows are equal
    keep_id is null. A null text is an empty one. Exactly one row of a group is kept: of rows that repeat both
    the id and the length of the row that stays, any one. Other columns are ignored; empty in, empty out.

    Rows find their group by digest. Hot groups, fewer than ``hot`` by definition, are broadcast and their rows not
    shuffled; other groups have at most 1 / ``hot`` of the rows. Should one digest belong to several
    contents, rows find their group by whole content."""
    rows = contents(docs, digest, salts)
    whole = combined(rows)
    groups = written(whole.groupBy("key").agg(F.count("*").alias("variants"), F.sum("n").alias("n"), F.max("best").alias("best")), "digests")
    on = ["key"]
    if not groups.filter("variants > 1").isEmpty():
        on, groups = ["key", "content"], written(whole, "contents")
    slim = written(rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text_sha256", "rank", "row", *on), "copies")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = groups.filter("n > 1").select(*on, "n", "best")
    if on == ["key"]:
        many = F.broadcast(copies.filter(F.col("n") * hot > total))
        found = slim.join(many, on).unionByName(slim.join(many.select(*on), on, "left_anti").join(copies.filter(F.col("n") * hot <= total), on, "left"))
    else:
        found = slim.join(copies, on, "left")
    stays = F.col("n").isNull() | (F.col("rank") == F.col("best"))
    if not slim.groupBy(*on, "rank").count().filter("count > 1").isEmpty():
        firsts = found.filter(stays & F.col("n").isNotNull()).groupBy(*on).agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
        found = found.join(firsts, "row", "left")
        stays = F.col("n").isNull() | F.col("first").isNotNull()
    return found.select("doc_id", ranked_id(F.coalesce("best", "rank")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``; the rules are those of ``marked``."""
    rows = contents(docs, lambda sha: sha, salts)
    winners = written(combined(rows).select("key", "content", "best"), "contents")
    clean = F.coalesce("text", F.lit(""))
    given = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), clean.alias("text"))
    given = given.select("__row", F.regexp_replace("text", GAP, "").alias("content"), rank("doc_id", "text").alias("best"))
    found = given.join(winners.select("content", "best"), ["content", "best"], "left_semi")
    order = F.xxhash64(*(F.col("__row")[c] for c, t in docs.dtypes if "map<" not in t))
    return found.groupBy("content").agg(F.min_by("__row", order).alias("__row")).select("__row.*")


def marked_documents(docs: DataFrame) -> DataFrame:
    return marked(docs)
