"""Spelling variants by composing the vocabulary's minimal acceptor with a one-edit transducer and the acceptor again."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

#: A word is a run of these letters.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One occurrence in so many loses a letter.
SLIPS = 199
#: A form is at least so many times as frequent.
TIMES = 5
#: Code points of the words that one task composes; a larger set is split at later states.
POINTS = 200_000
#: Depth of the first initial states.
DEPTH = 3


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, counted after one occurrence in ``SLIPS`` has lost a letter.

    Only A-Z become small. Which occurrence loses which letter depends on the document's id (none: empty) and the
    word alone. Counts are added up in each task before they are exchanged."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.filter(F.length("run") >= least_length)
    plain = F.length("run") == F.octet_length("run")  # ASCII alone: nothing but A-Z can change
    rows = rows.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def acceptor(words):
    """The minimal acyclic automaton of sorted distinct words: ([final], [{character: state}]), the start state last.

    States are closed from the end of a word to where the next one branches off; states with the same right language
    are one."""
    final, arcs, known, path, before = [], [], {}, [[False, []]], ""

    def close(depth):
        while len(path) > depth:
            end, to = path.pop()
            key = end, tuple(to)
            if key not in known:
                known[key] = len(final)
                final.append(end)
                arcs.append(dict(to))
            if path:
                path[-1][1][-1] = path[-1][1][-1], known[key]

    for word in words:
        k = 0
        while k < len(before) and k < len(word) and before[k] == word[k]:
            k += 1
        close(k + 1)
        for c in word[k:]:
            path[-1][1].append(c)
            path.append([False, []])
        path[-1][0] = True
        before = word
    close(0)
    return final, arcs


def near_pairs(words):
    """Pairs of sorted distinct words that differ by one inserted, deleted or replaced character.

    Paths of the composition acceptor, one-edit transducer, acceptor: a state is (left, edits, right). Before
    the edit left = right, so these paths run along the acceptor; an edit arc leads to a state (p, 1, q) from which both
    sides read the same, so what follows is accepted by p and by q. Arcs into states that accept nothing together are
    trimmed; that is found once for each pair of states. An insertion is taken where the words first differ."""
    final, arcs = acceptor(words)
    known: dict[tuple[int, int], bool] = {}

    def steps(p, q):
        few, more = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
        return [(c, arcs[p][c], arcs[q][c]) for c in few if c in more]

    def meet(p, q):
        """Whether some string is accepted from both states."""
        wait = [(min(p, q), max(p, q))]
        while wait:
            p, q = wait[-1]
            if p == q or (p, q) in known:
                wait.pop()
                continue
            after = [(min(a, b), max(a, b)) for _, a, b in steps(p, q)]
            if final[p] and final[q] or any(a == b or known.get((a, b)) for a, b in after):
                known[p, q] = True
            elif open_ones := [x for x in after if x not in known]:
                wait.append(open_ones[0])
            else:
                known[p, q] = False
        return p == q or known[min(p, q), max(p, q)]

    def shared(p, q):
        """The strings that both states accept."""
        wait = [(p, q, "")]
        while wait:
            p, q, s = wait.pop()
            if final[p] and final[q]:
                yield s
            wait += [(a, b, s + c) for c, a, b in steps(p, q) if meet(a, b)]

    edits = []
    for q, out in enumerate(arcs):
        replaced = [(a, p, b, r) for (a, p), (b, r) in combinations(out.items(), 2) if meet(p, r)]
        edits.append((replaced, [(a, p) for a, p in out.items() if meet(p, q)]))
    wait = [(len(final) - 1, "")] if final else []
    while wait:
        q, head = wait.pop()
        replaced, inserted = edits[q]
        for a, p, b, r in replaced:
            for s in shared(p, r):
                yield head + a + s, head + b + s
        for a, p in inserted:
            for s in shared(p, q):
                if not s.startswith(a):
                    yield head + s, head + a + s
        wait += [(p, head + c) for c, p in arcs[q].items()]


def composed(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): near pairs of (word, n) that share ``key``, an initial state, and differ after it."""

    def enumerate_pairs(table):
        import pyarrow as pa

        n = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        start = len(table.column("key")[0].as_py())
        head = next(iter(n))[:start]
        pairs = [(head + a, head + b) for a, b in near_pairs(sorted(w[start:] for w in n))]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "an": pa.array([n[a] for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.string()), "bn": pa.array([n[b] for _, b in pairs], pa.int64())})

    return words.groupBy("key").applyInArrow(enumerate_pairs, "a string, an long, b string, bn long")


def edited(words: DataFrame, low: int, high: int) -> DataFrame:
    """(a, an, b, bn): near pairs of (word, n) whose first difference is after ``low`` to ``high`` - 1 characters.

    These are the edit arcs at states that lie before the initial ones: words with the same head and the same rest
    after the edit. Words are distinct, so a head and a rest have one word for each letter and one without."""
    head = lambda d: F.substr("word", F.lit(1), d)
    side = lambda d, c, rest: F.struct(d.alias("d"), head(d).alias("head"), c.alias("c"), rest.alias("rest"))
    depths = F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high - 1)))
    sides = F.flatten(F.transform(depths, lambda d: F.array(side(d, F.substr("word", d + 1, F.lit(1)), F.substr("word", d + 2)), side(d, F.lit(""), F.substr("word", d + 1)))))
    rows = words.filter(F.length("word") >= low).select("word", "n", F.inline(F.array_distinct(sides)))
    same = rows.groupBy("d", "head", "rest").agg(F.collect_list(F.struct("c", "word", "n")).alias("m")).filter(F.size("m") > 1)
    rest = F.substr("rest", F.lit(1), F.lit(1))
    after = lambda x: F.filter("m", lambda y: (x["c"] < y["c"]) & ((x["c"] != "") | (y["c"] != rest)))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(after(x), lambda y: F.struct(x["word"].alias("a"), x["n"].alias("an"), y["word"].alias("b"), y["n"].alias("bn")))))
    return same.select(F.inline(pairs))


def near(words: DataFrame, points: int = POINTS, depth: int = DEPTH) -> DataFrame:
    """(a, an, b, bn): every pair of near words of (word, n) once.

    Words are split by the state that the acceptor reaches after ``depth`` characters; each set is composed in one
    task. Pairs that differ earlier take their edit before those states (``edited``). A set of more than ``points``
    characters is split again at states twice as deep, so one frequent beginning doesn't fill a task."""
    found, left, low = [], words, 0
    while True:
        found.append(edited(left, low, depth))
        left = left.filter(F.length("word") >= depth).withColumn("key", F.substr("word", F.lit(1), F.lit(depth)))
        sizes = written(left.groupBy("key").agg(F.sum(F.length("word")).alias("points"), F.count("*").alias("many")).filter("many > 1"), "states")
        found.append(composed(left.join(sizes.filter(F.col("points") <= points), "key", "left_semi")))
        large = sizes.filter(F.col("points") > points)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = written(left.join(large, "key", "left_semi").drop("key"), "words")
        low, depth = depth, 2 * depth


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of (word, form); a form is more frequent, so there are no rings.

    A word's root so far takes the root of that word, so each round doubles the steps that are done."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, points: int = POINTS, depth: int = DEPTH) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least 6 code points and 5 occurrences.

    form: the most frequent near word (ties: smallest in code-point order) if it is at least 5 times as frequent, else
    null. root: the last form, or the word. Null and empty texts have no words, a null id counts as an empty one,
    repeated rows count as often as they occur, and other columns are ignored. Empty in, empty out."""
    words = written(vocabulary(docs), "vocabulary")
    pairs = written(near(words, points, depth), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("on")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("on")))
    # the most frequent, then the smallest: the order of (-n, word)
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("on")).alias("on"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    some = -F.col("best.on") >= TIMES * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(some, F.col("best.other")).alias("form"), F.when(some, -F.col("best.on")).alias("form_n")), "forms")
    roots = rooted(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(docs)


ship(__name__)
