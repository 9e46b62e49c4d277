"""SimHash near-duplicates, linked by BK-trees."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

WORDS_PER_SHINGLE = 3
SEED = 42
RADIUS = 2
#: Parts of a fingerprint; two fingerprints within the radius agree in at least BLOCKS - RADIUS of them.
BLOCKS = 4
#: Largest BK-tree; fingerprints of one shard beyond it go to further trees, and every tree is searched.
TREE = 512


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, fp): words of the text in lower case (A-Z), shingles of three, a bit for each majority.

    A text of fewer words is one shingle; no words (null, empty): fingerprint 0. ``fp`` is the unsigned
    value in a signed long."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                words = (text.as_py() or "").encode().lower().split()  # bytes: only A-Z change, only \t-\r and space split
                if not words:
                    continue
                line = b" ".join(words)
                n = max(1, len(words) - WORDS_PER_SHINGLE + 1)
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(lengths + 1) - 1
                first, last = (ends - lengths)[:n].tolist(), ends[min(WORDS_PER_SHINGLE, len(words)) - 1 :].tolist()
                votes = np.zeros(64, np.int64)
                for a in range(0, n, 65536):  # whole texts, in steps of bounded memory
                    h = np.array([digest(line[x:y], SEED) for x, y in zip(first[a : a + 65536], last[a : a + 65536])], "<u8")
                    votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = weight[2 * votes > n].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), *more, "text")
    return rows.mapInArrow(hashed, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", fp long")


def grow(fp, roots):
    """BK-trees over ``fp`` (uint64), one for each value of ``roots`` (the row that is the root of each row).

    Returns child: child[v, d] is the child of v on the edge d, or -1. All trees grow together, a level at
    a time: of the rows that wait at a node with the same distance, the first becomes that child and the
    others wait there."""
    import numpy as np

    child = np.full((len(fp), 65), -1, np.int32)
    wait = np.flatnonzero(roots != np.arange(len(fp)))
    at = roots[wait]
    while len(wait):
        d = np.bitwise_count(fp[wait] ^ fp[at]).astype(np.int64)
        edge = at * 65 + d
        _, first, group = np.unique(edge, return_index=True, return_inverse=True)
        new = wait[first]
        child[at[first], d[first]] = new
        keep = np.ones(len(wait), bool)
        keep[first] = False
        wait, at = wait[keep], new[group][keep]
    return child


def search(fp, child, queries, starts, radius):
    """(query row, tree row) of all hits within ``radius``, following only edges d with |d - distance| <= radius."""
    import numpy as np

    q, v = np.arange(len(queries)), starts
    steps = np.arange(-radius, radius + 1)
    while len(q):
        d = np.bitwise_count(queries[q] ^ fp[v]).astype(np.int64)
        hit = d <= radius
        yield q[hit], v[hit]
        edges = d[:, None] + steps
        to = np.where((edges >= 0) & (edges <= 64), child[v[:, None], np.clip(edges, 0, 64)], -1)
        row, column = np.nonzero(to >= 0)
        q, v = q[row], to[row, column].astype(np.int64)


def links(unique: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """(a, b), a > b: for each shard tree, a spanning forest of its hits. ``unique``: distinct ``fp``.

    Fingerprints within the radius agree in ``blocks - radius`` of ``blocks`` parts, so each choice of parts
    sends a fingerprint to the shard of its bits there, and no link is lost. A shard's tree goes to the
    queries that can reach it, not to all executors: the set of all trees grows with the corpus and has no
    size bound that a broadcast could have. A shard of more than ``tree`` fingerprints becomes several
    trees, and slices of its fingerprints are sent to each; slice and tree are two hash classes, so a hot
    shard is spread over tasks. Hits are joined within the task, so a group of n near copies gives less
    than n links for each tree and not n * n."""
    width = 64 // blocks
    part = lambda i: F.shiftleft(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1), width * i)
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        bits = part(chosen[0])
        for i in chosen[1:]:
            bits = bits.bitwiseOR(part(i))
        masks.append(F.struct(F.lit(len(masks)).alias("mask"), bits.alias("bits")))
    rows = unique.select("fp", F.inline(F.array(*masks)))
    sizes = rows.groupBy("mask", "bits").count().filter("count > 1")  # alone in its shard: no link there
    rows = rows.join(sizes, ["mask", "bits"])
    classes = F.ceil(F.col("count") / F.lit(tree)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), classes).cast("int")
    # a pair of classes (x, y), x <= y: tree of class x, queries of class y
    rows = rows.select("fp", "mask", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), classes - 1)).alias("other"))
    rows = rows.select("fp", "mask", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"))
    where = ["mask", "bits", "x", "y"]
    rows = rows.repartition(*where).sortWithinPartitions(*where, F.col("in_tree").desc(), "fp")

    def find(batches):
        import numpy as np
        import pyarrow as pa

        def solve(t):
            fp = t.column("fp").to_numpy().view(np.uint64)
            keys = [t.column(c).to_numpy() for c in where]
            new = np.ones(len(fp), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            root = np.flatnonzero(new)[np.cumsum(new) - 1]
            member = t.column("in_tree").to_numpy(zero_copy_only=False)
            tree_rows = np.flatnonzero(member)
            local = np.cumsum(member) - 1
            usable = member[root]  # a slice without a tree has nothing to meet
            child = grow(fp[tree_rows], local[root[tree_rows]])
            asks = np.flatnonzero(t.column("asks").to_numpy(zero_copy_only=False) & usable)
            best = np.arange(len(fp))
            ends = [], []
            for s in range(0, len(asks), 4000):
                some = asks[s : s + 4000]
                for q, v in search(fp[tree_rows], child, fp[some], local[root[some]], radius):
                    a, b = some[q], tree_rows[v]
                    apart = a != b
                    a, b = a[apart], b[apart]
                    if len(a):  # at once: no list of all hits is kept
                        join(best, a, b)
            top = find_all(best)
            moved = np.flatnonzero(top != np.arange(len(fp)))
            ends[0].append(fp[moved])
            ends[1].append(fp[top[moved]])
            return np.concatenate(ends[0]).view(np.int64), np.concatenate(ends[1]).view(np.int64)

        def find_all(best):
            while True:
                up = best[best]
                if (up == best).all():
                    return up
                best = up

        def join(best, a, b):
            while True:
                best[:] = find_all(best)
                x, y = best[a], best[b]
                apart = x != y
                if not apart.any():
                    return
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(best, np.maximum(x, y), np.minimum(x, y))

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            last = [t.column(c)[-1].as_py() for c in where]
            same = np.logical_and.reduce([t.column(c).to_numpy() == x for c, x in zip(where, last)])
            cut = len(same) if not same.all() else 0
            while cut and same[cut - 1]:
                cut -= 1
            held = t.slice(cut)
            if cut:
                a, b = solve(t.slice(0, cut))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held is not None and len(held):
            a, b = solve(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = rows.mapInArrow(find, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` that isn't the smallest of its component, with that smallest node.

    Alternating large and small stars until the edges stay the same; each round is written to the shared
    folder. A node's neighbours are reduced to their minimum before any exchange of rows, and edges are
    joined with that minimum, so no task collects a node's neighbours."""
    now = written(edges, "links")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k"))
        now = written(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state


def near_duplicates(docs: DataFrame, *more: str, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """(doc_id, *more, fp, root, component_id) of every document.

    Equal fingerprints are one node, so copies cost nothing; ``component_id`` is the smallest id of a
    component (null ids are ignored; null if it has no other). Repeated rows come out as often as they
    went in. Null and empty texts have fingerprint 0 and link like any other."""
    prints = written(fingerprints(docs, *more), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    stars = components(links(nodes.select("fp"), radius, blocks, tree))
    rooted = nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    return prints.join(named, "fp").select("doc_id", *more, "fp", "root", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash)."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.col("text").cast("binary")).alias("text_hash"))


#: Smallest id first, rows without an id last, then by text.
FIRST = "min(struct(doc_id IS NULL AS no_id, doc_id, text_hash)) AS first"


def first_rows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The row of ``docs`` for each ``first`` (no_id, doc_id, text_hash); of rows that agree in both, one.

    An id and a text hash occur once in ``firsts``, as a text belongs to one component: no row is doubled and
    no id, nor its absence, stands for another text."""
    keep = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__key"), F.md5(F.col("text").cast("binary")).alias("__text"))
    found = rows.join(keep, F.col("__text").eqNullSafe(F.col("__hash")) & F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    order = F.xxhash64(*(F.col("__row")[c] for c, t in docs.dtypes if "map<" not in t))
    return found.groupBy("__key", "__text").agg(F.min_by("__row", order).alias("__row")).select("__row.*")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of the smallest id, with all columns of ``docs``."""
    found = near_duplicates(text_hash(docs), "text_hash")
    return first_rows(docs, found.groupBy("root").agg(F.expr(FIRST)))


ship(__name__)
