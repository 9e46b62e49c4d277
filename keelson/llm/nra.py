"""Exact top-k inner products by aggregation of sorted lists without random access (NRA)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

K = 20
SCALE = 64
#: Vectors whose lists a task sorts at once, and queries of a task.
BLOCK, ASKED = 8192, 4096
#: Queries whose bounds are computed together, and candidates for each place that are few enough to resolve.
TOGETHER, FEW = 128, 16


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) in double; vectors null or with null or non-finite components go, rows without an id too."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    good = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~F.coalesce(F.exists(x, bad), F.lit(False)))
    return good.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * float(scale)).cast("long")).alias("v"))


def nra(rows, asked, places):
    """For each query (row of ``asked``): rows of a block that may be among its best ``places``.

    Every component is a sorted list, read from the end at which its products with the query are largest. A
    round halves what is left of the lists: all of them are read down to one depth. A row's lower bound takes the
    list's smallest product for what it lacks, its upper bound the last product read. Which entries are seen
    depends on depth and end alone, so the bounds of many queries are two matrix products. A query stops when
    the unseen and all but a few of the seen have an upper bound below the lower bound of the last place. Ties
    stay: only bounds strictly below go. Sums of integers below 2^24 are exact in float32; beyond, float64 with a
    slack takes its place."""
    import numpy as np

    m, d = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    values, rank = np.take_along_axis(rows, order, 0), np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(m)[:, None], 0)
    reach = float((np.abs(values[[0, -1]]).max(0).astype(float) * np.abs(asked)).sum(1).max())
    kind, slack = (np.float32, 0.0) if 2 * reach < 2**24 else (np.float64, 1e-9 * reach)
    weights = np.hstack([np.maximum(asked, 0), np.minimum(asked, 0)]).astype(kind)
    alive, pending = [None] * len(asked), np.arange(len(asked))
    for depth in sorted({m - (m >> i) for i in range(1, 5)} - {0} | {m}):
        seen = np.hstack([rank >= m - depth, rank < depth])
        worst, front = (np.concatenate(ends) for ends in ((values[0], values[-1]), (values[m - depth], values[depth - 1])))
        twice = np.hstack([rows, rows])
        above_worst, below_front = ((seen * (twice - end)).astype(kind).T for end in (worst, front))
        waiting = []
        for a in range(0, len(pending), TOGETHER):
            some = pending[a : a + TOGETHER]
            w, at = weights[some], m - places[some]
            lower, unseen = w @ above_worst + (w @ worst.astype(kind))[:, None], w @ front.astype(kind)
            bar = np.partition(lower, np.unique(at), axis=1)[np.arange(len(some)), at] - slack
            may = w @ below_front + unseen[:, None] >= bar[:, None]
            done = (unseen < bar) & (may.sum(1) <= FEW * places[some]) | (depth == m)
            for i in np.flatnonzero(done):
                alive[some[i]] = np.flatnonzero(may[i])
            waiting.append(some[~done])
        pending = np.concatenate(waiting)
        if not len(pending):
            break
    return alive


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """The k best other vectors of each query by integer inner product; ties to the smaller id.

    Vectors are dealt into blocks and queries into groups of bounded size, both by a hash of the id, and each
    pair of them is one task, which reads the block's sorted lists (above), resolves the exact scores of what is
    left and keeps k; the blocks' best are merged by query. A row with the id of the query is its own row
    (repeated ids too). Shorter vectors count as filled up with zeros. Repeated candidates are candidates like
    others; a repeated query is asked once. Empty in, empty out."""
    queries = queries.distinct()
    n, asks = vectors.count(), queries.count()
    parts, groups = max(1, ceil(n / block)), max(1, ceil(asks / asked))
    of = lambda c, m: F.pmod(F.xxhash64(F.lit(3), c), F.lit(m)).cast("int")
    # repeated ids hash alike: rows of one id are dealt by their vector as well
    left = vectors.withColumn("part", of(F.struct("vec_id", "v"), parts)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("ask", F.lit(False))
    right = queries.withColumn("grp", of(F.struct("vec_id", "v"), groups)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("ask", F.lit(True))

    def solve(t):
        import numpy as np
        import pyarrow as pa

        ids = t.column("vec_id").to_numpy()
        v = pa.concat_arrays(t.column("v").chunks)
        lengths, at, flat = v.value_lengths().to_numpy(), v.offsets.to_numpy(), v.values.to_numpy()
        d = int(lengths.max(initial=0))
        x = np.zeros((len(ids), d), np.int64)
        inside = np.arange(d) < lengths[:, None]
        x[inside] = flat[at[0] : at[-1]]
        ask = t.column("ask").to_numpy(zero_copy_only=False)
        rows, row_ids, qs, q_ids, q_keys = x[~ask], ids[~ask], x[ask], ids[ask], t.column("q").to_numpy()[ask]
        out = [], [], [], []
        if len(rows) and len(qs):
            line = np.sort(row_ids)
            own = np.searchsorted(line, q_ids, "right") - np.searchsorted(line, q_ids)
            # own rows aren't candidates: with room for them, the k best of the others are kept
            found = nra(rows, qs, np.minimum(len(rows), k + own))
            for q, q_id, q_key, some in zip(qs, q_ids, q_keys, found):
                some = some[row_ids[some] != q_id]
                score = rows[some] @ q
                best = np.lexsort((row_ids[some], -score))[:k]
                out[0].append(np.full(len(best), q_id))
                out[1].append(np.full(len(best), q_key))
                out[2].append(row_ids[some][best])
                out[3].append(score[best])
        cat = lambda a: pa.array(np.concatenate(a) if a else np.empty(0, np.int64), pa.int64())
        return pa.Table.from_arrays([cat(a) for a in out], names=["query_id", "q", "vec_id", "score"])

    tasks = left.unionByName(right).withColumn("q", F.xxhash64("vec_id", "v"))
    found = tasks.groupBy("part", "grp").applyInArrow(solve, "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_scores(embeddings: DataFrame) -> DataFrame:
    v = quantized(embeddings)
    return top_k(v, v.filter(F.col("vec_id") % 20 == 0))


ship(__name__)
