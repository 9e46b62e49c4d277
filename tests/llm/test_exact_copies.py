"""Exact duplicates against plain brute force, on the small table, odd rows, hot groups and colliding digests."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from keelson.llm import exact_copies
from keelson.llm.oracles import ORACLES

GAPS = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """Rows of (doc_id, text) -> counted (doc_id, keep_id, group_size, text_sha256), and kept rows by content."""
    groups = defaultdict(list)
    for r in rows:
        groups[GAPS.sub("", r.text or "")].append(r)
    out, kept = Counter(), Counter()
    for content, of in groups.items():
        best = min(of, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out.update((r.doc_id, best.doc_id, len(of), sha) for r in of)
        kept[best.doc_id, sha] += 1
    return out, kept


def check(df, **more):
    out = exact_copies.marked(df, **more).collect()
    want, kept = brute(df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert Counter((r.doc_id, r.text_sha256) for r in out if r.kept) == kept


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("width, hot", [(64, 10_000), (1, 10_000), (64, 1)])
def test_marked(table, width, hot, request):
    """Also with digests of one hex digit, which many contents share, and with no group that counts as hot."""
    check(request.getfixturevalue(table), hot=hot, digest=lambda sha: F.substring(sha, 1, width))


def test_a_third_of_all_rows_are_one_text(spark):
    rows = spark.range(0, 3000, 1, 12).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("the same"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")), F.lit("text"))).otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text"), F.lit(1).alias("key"), F.lit(2).alias("salt"), F.lit("x").alias("content"))
    check(rows)
    check(rows, salts=3, hot=2)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_deduplicated_keeps_whole_rows(table, request):
    df = request.getfixturevalue(table)
    out = exact_copies.deduplicated(df)
    assert out.columns == df.columns
    rows = out.collect()
    _, kept = brute(df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, hashlib.sha256(GAPS.sub("", r.text or "").encode()).hexdigest()) for r in rows) == kept
    assert set(rows) <= set(df.collect())


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(ORACLES["op12_exact_copies"])
    names = [d[0] for d in cur.description]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in exact_copies.marked_documents(docs).collect())


def test_texts_are_compared_at_every_stage(docs):
    """Grouping keys of both exchanges hold the whole content, and a partial aggregate comes before the first."""
    plan = exact_copies.combined(exact_copies.contents(docs, lambda sha: sha, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("content#") >= 6 and "partial_count" in plan and "Python" not in plan and "Arrow" not in plan
