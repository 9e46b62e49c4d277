"""Temporal URL lists: every capture is judged by the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time slice in seconds. A key's entries and captures meet slice by slice.
SLICE = 3600
ADDED = ("blocked", "matched_key", "category", "listed_since")


def normal_url(url: Column) -> Column:
    """Scheme, www., port, query, fragment and final slashes removed, host in lower case; null if there is no host."""
    rest = F.regexp_replace(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(rest, "/", 1)), r"^[^@]*@", ""), r":\d*$|\.$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def keys_of(url: Column) -> Column:
    """Keys under which a list may hold a normal URL: the URL itself, its host and the host's parent domains of two labels or more."""
    labels = F.split(F.substring_index(url, "/", 1), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.array_append(domains, F.concat(F.lit("u:"), url))


def slice_intervals(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, slice, valid_from, valid_to, since, category): what holds within the wanted slices of each key.

    ``entries``: key, ts (seconds), action, category. Of entries of one key and second, an addition wins over
    a removal and the smaller category over the others. An entry holds until the next one of its key.
    What a slice inherits is the last entry of the nearest earlier slice, so a key with very many entries is
    handled slice by slice and never by one task."""
    best = entries.groupBy("key", "ts").agg(F.max((F.col("action") == "add").cast("int")).alias("on"), F.min(F.when(F.col("action") == "add", F.col("category"))).alias("category"))
    best = best.withColumn("slice", F.floor(F.col("ts") / SLICE))
    inside = Window.partitionBy("key", "slice").orderBy("ts")
    held = best.select("key", "slice", F.col("ts").alias("valid_from"), F.coalesce(F.lead("ts").over(inside), (F.col("slice") + 1) * SLICE).alias("valid_to"), F.col("ts").alias("since"), "on", "category")
    ends = best.groupBy("key", "slice").agg(F.max(F.struct("ts", "on", "category")).alias("last"), F.min("ts").alias("first"))
    line = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ends.join(wanted, ["key", "slice"], "full")
    carried = slices.withColumn("was", F.last("last", ignorenulls=True).over(line)).filter("was is not null")
    carried = carried.select("key", "slice", (F.col("slice") * SLICE).alias("valid_from"), F.coalesce("first", (F.col("slice") + 1) * SLICE).alias("valid_to"), F.col("was.ts").alias("since"), F.col("was.on").alias("on"), F.col("was.category").alias("category"))
    return held.unionByName(carried).filter("on = 1 and valid_from < valid_to").drop("on")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds blocked, matched_key, category and listed_since to captures (url, fetch_ts and any other columns).

    captures.fetch_ts and entries.ts are timestamps. An entry's key is ``d:`` and a domain or ``u:`` and a
    normal URL. Of several active entries, that of the longest key counts. Captures without a host or
    time, and entries with a null key or time, match nothing; an action other than ``add`` removes. Equal captures
    are judged once. Columns of captures named like the added ones are replaced."""
    at = F.unix_timestamp("fetch_ts")
    rows = captures.select(F.struct("*").alias("row"), normal_url(F.col("url")).alias("__url"), at.alias("__at"))
    asked = rows.select("__url", "__at").filter("__url is not null and __at is not null").distinct()
    probes = asked.select("__url", "__at", F.explode(F.array_distinct(keys_of(F.col("__url")))).alias("key")).withColumn("slice", F.floor(F.col("__at") / SLICE))
    listed = entries.filter("key is not null and ts is not null").select("key", F.unix_timestamp("ts").alias("ts"), "action", "category")
    spans = slice_intervals(listed, probes.select("key", "slice").distinct())
    hits = probes.join(spans, ["key", "slice"]).filter("valid_from <= __at and __at < valid_to")
    best = hits.groupBy("__url", "__at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "category", "since")).alias("__hit"))
    out = rows.join(best.withColumnsRenamed({"__url": "__u", "__at": "__t"}), (F.col("__url") == F.col("__u")) & (F.col("__at") == F.col("__t")), "left")
    own = (F.col("row").getField(c).alias(c) for c in captures.columns if c not in ADDED)
    return out.select(*own, F.col("__hit").isNotNull().alias("blocked"), F.col("__hit.key").alias("matched_key"), F.col("__hit.category").alias("category"), F.timestamp_seconds("__hit.since").alias("listed_since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch time in 2024, spread by page_id (the table has none)."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 7919, F.lit(86400)))
    return pages.select("page_id", "url", ts.alias("fetch_ts"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from ``pages``: every tenth page adds or removes its host or its own URL."""
    n = F.col("page_id")
    url = normal_url(F.col("url"))
    key = F.when(n % 20 == 3, F.concat(F.lit("d:"), F.substring_index(url, "/", 1))).otherwise(F.concat(F.lit("u:"), url))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod(n * 53, F.lit(366)) * 86400 + F.pmod(n * 6271, F.lit(86400)))
    action = F.when(n % 30 == 3, "remove").otherwise("add")
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (n % 7 % 3 + 1).cast("int"))
    return pages.filter("page_id % 10 = 3").select(key.alias("key"), ts.alias("ts"), action.alias("action"), category.alias("category"))


def judged_pages(pages: DataFrame) -> DataFrame:
    out = judge_captures(captures_of(pages), entries_of(pages))
    return out.select("page_id", "url", F.unix_timestamp("fetch_ts").alias("fetched"), "blocked", "matched_key", "category", F.unix_timestamp("listed_since").alias("listed_since"))
