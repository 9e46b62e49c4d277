"""Spelling variants against brute force: the automata alone, the split states, and whole tables."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from keelson.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    """{word: (n, n_near, form, form_n, root)}; near words have a string in common that lacks at most one letter of each."""
    lack, near = {}, {w: set() for w in n}
    for w in n:
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            lack.setdefault(s, []).append(w)
    for of in lack.values():
        for a, b in combinations(of, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def check(df, **more):
    out = spelling.variants(df, **more).collect()
    want = brute(count(df.select("doc_id", "text").collect()))
    assert len(out) == len(want)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in out} == want
    return want


def test_composition_gives_each_pair_once():
    rng = random.Random(1)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abc"[: rng.choice((1, 2, 3))]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))})
        assert sorted(tuple(sorted(p)) for p in spelling.near_pairs(words)) == sorted(p for p in combinations(words, 2) if one_edit(*p))


def test_acceptor_is_minimal():
    final, arcs = spelling.acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(final) == 5 and sum(map(len, arcs)) == 5
    words = sorted(["a" * n for n in range(5000, 5040)])
    assert len(spelling.acceptor(words)[0]) == 5040  # long words: nothing recursive
    assert len(list(spelling.near_pairs(words))) == 39
    assert list(spelling.near_pairs([])) == []


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_tables(table, request):
    check(request.getfixturevalue(table))


@pytest.mark.parametrize("points, depth", [(200_000, 3), (300, 1), (40, 2), (200_000, 6)])
def test_states_that_are_split(spark, points, depth):
    """Words with long common beginnings, in sets that are split until they are small; variants in chains; ties."""
    rng = random.Random(9)
    words, head = {}, "gemeinsam"
    for _ in range(60):
        w = "".join(rng.choice("abÀé") for _ in range(rng.randint(0, 5)))
        words[rng.choice((head, "Gemeinsam", "anfang")) + w] = rng.choice((5, 6, 30, 150, 800))
    for k in range(6, 40, 3):
        words["q" * k] = words["q" * (k + 1)] = 5
    words |= {"chained": 3000, "chainad": 500, "chainab": 60, "ahainab": 7, "ahainb": 5, "tiedone": 50, "tiedtwo": 9, "tiedtne": 9, "tiedtoe": 50, "éclairs": 40, "Éclairs": 8, "short": 99}
    rows = [(i, " ".join(w for w, k in words.items() if i < k), "x", 3, "y") for i in range(max(words.values()))]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, key string")
    want = check(df, points=points, depth=depth)
    assert want["ahainab"][4] == "chained" and any(v[1] > 3 for v in want.values())
