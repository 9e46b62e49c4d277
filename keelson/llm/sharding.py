"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items, taken without replacement from good + bad, are good.

    Inversion that starts at the mode and walks outwards, so the steps are in the order of the standard
    deviation and populations may be of any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    pick = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = down = mode
    p_up = p_down = exp(pick(good, mode) + pick(bad, draws - mode) - pick(good + bad, draws))
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(part_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: partitions, columns: shards; row sums are ``part_sizes``, column sums ``shard_sizes``.

    The law is that of a uniform permutation: each row is a multivariate hypergeometric draw from what
    the shards still lack."""
    rng, lack, out = random.Random(seed), list(shard_sizes), []
    for size in part_sizes:
        rest, row = sum(lack), []
        for s, room in enumerate(lack):
            n = hypergeometric(rng, room, rest - room, size)
            row.append(n)
            rest, size = rest - room, size - n
            lack[s] -= n
        out.append(row)
    return out


def uniform_shuffle(df: DataFrame, key: list[Column], shards: int, seed: int = 0, parts: int = 240, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` with its shard and its slot there (gapless from 0); shard sizes differ by one row at most.

    1. Rows fall into ``parts`` logical partitions by a hash of ``key``: a function of the row, so a
       recomputed task gives the same rows to the same place.
    2. The partition sizes (``parts`` numbers) are the only thing the driver sees; it draws the exact
       partition-to-shard counts.
    3. Each partition permutes its rows (order of a seeded hash) and deals runs of the drawn lengths.
    4. Rows are exchanged by shard and permuted once more by another hash, which gives the slot.

    ``key`` should tell rows apart; rows equal in all of ``key`` are interchangeable, and null values
    are values like others. Rows keep all their columns; those named as ``names`` are replaced. An empty
    table gives an empty result. A shard is one output unit, so one task holds one shard at a time:
    choose ``shards`` and ``parts`` with the table (the sort spills)."""
    shard, slot = names
    tag = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *key)
    rows = df.withColumn("__part", F.pmod(tag(1), F.lit(parts)).cast("int"))
    found = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}
    sizes = [found.get(p, 0) for p in range(parts)]
    each, more = divmod(sum(sizes), shards)
    matrix = communication_matrix(sizes, [each + (s < more) for s in range(shards)], seed)
    ends = []
    for row in matrix:
        at, line = 0, []
        for n in row:
            at += n
            line.append(str(at))
        ends.append(f"[{','.join(line)}]")
    bounds = F.from_json(F.lit(f"[{','.join(ends)}]"), "array<array<bigint>>")
    local = Window.partitionBy("__part").orderBy(tag(2), *key)
    again = Window.partitionBy(shard).orderBy(tag(3), *key)
    return (
        rows.withColumn("__place", F.row_number().over(local) - 1)
        .withColumn(shard, F.size(F.filter(F.element_at(bounds, F.col("__part") + 1), lambda end: end <= F.col("__place"))))
        .withColumn(slot, (F.row_number().over(again) - 1).cast("long"))
        .drop("__part", "__place")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """The digest of sharding ``documents``: null texts have size 8 and the checksum of an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = uniform_shuffle(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
