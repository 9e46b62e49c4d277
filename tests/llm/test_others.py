"""URL lists, preference pairs, exact top k and the pipeline against plain brute force."""

import datetime as dt
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from keelson.llm import mixing, nra, preference, toxicity, url_lists

from test_documents import fingerprint, roots

SF = "/root/testdata/sf0.01"

# URL lists
def plain_url(url):
    if url is None:
        return None
    rest = re.sub(r"[?#].*$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "", url.strip(" ")), flags=re.S)
    host, slash, path = rest.partition("/")
    host = re.sub(r":\d*$|\.$", "", re.sub(r"^[^@]*@", "", host.lower()))
    host = host.removeprefix("www.")
    return host + (slash + path).rstrip("/") if host else None

def plain_keys(url):
    labels = url.partition("/")[0].split(".")
    return {"u:" + url} | {"d:" + ".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}

def judged(url, at, entries):
    """(key, category, since) of the longest key whose last entry up to ``at`` is an addition."""
    url, best = plain_url(url), None
    if url is None or at is None:
        return None
    for key in plain_keys(url):
        past = [e for e in entries.get(key, ()) if e[0] <= at]
        if past:
            last = max(e[0] for e in past)
            added = [c for t, a, c in past if t == last and a == "add"]
            if added:
                found = len(key), key, min((c for c in added if c is not None), default=None), last
                best = max(best or found, found, key=lambda f: f[:2])
    return best and best[1:]

def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        if r.key is not None and r.ts is not None:
            out[r.key].append((int(r.ts.replace(tzinfo=dt.UTC).timestamp()), r.action, r.category))
    return out

def test_pages_against_their_list(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    entries = by_key(url_lists.entries_of(pages).selectExpr("key", "cast(ts as timestamp_ntz) ts", "action", "category").collect())
    out = url_lists.judged_pages(pages).collect()
    assert len(out) == pages.count() and any(r.blocked for r in out) and not all(r.blocked for r in out)
    for r in out:
        want = judged(r.url, r.fetched, entries)
        assert ((r.matched_key, r.category, r.listed_since) if r.blocked else None) == want, r

def test_odd_captures(spark):
    at = lambda h, m=0, s=0: dt.datetime(2024, 5, 1 + h // 24, h % 24, m, s)
    entries = [
        ("d:bad.com", at(1), "add", "spam"), ("d:bad.com", at(5), "remove", None), ("d:bad.com", at(5), "add", "malware"), ("d:bad.com", at(5), "add", "adult"), ("d:bad.com", at(30), "remove", "spam"),
        ("u:sub.bad.com/a", at(2), "add", None), ("u:sub.bad.com/a", at(2, 30), "remove", None), ("u:sub.bad.com/a", at(2, 30, 1), "add", "spam"), ("d:alone", at(0), "add", "spam"), (None, at(0), "add", "x"), ("d:late.org", None, "add", "x"), ("d:late.org", at(3), None, "x"),
        *[("d:busy.net", at(h, m), "add" if (h + m) % 3 else "remove", f"c{m % 2}") for h in range(40) for m in range(0, 60, 7)],
    ]
    urls = ["http://www.Bad.com/", "https://sub.bad.com/a/?q=1#x", "//user@sub.bad.com:80/a", "bad.com.", "notbad.com", "alone", "late.org/x", "busy.net/y", "a.busy.net", "", "http://", None, "  bad.com/a b ", "http://bücher.bad.com/ü"]
    rows = [(u, at(h, m), "own", "own", "own", "own") for u in urls for h in (0, 1, 2, 3, 5, 29, 30, 39, 60) for m in (0, 14, 30, 59)] * 2 + [(u, None, None, None, None, None) for u in urls]
    captures = spark.createDataFrame(rows, "url string, fetch_ts timestamp_ntz, category string, __url string, key string, `a.b` string").withColumn("fetch_ts", url_lists.F.col("fetch_ts").cast("timestamp"))
    listed = spark.createDataFrame(entries, "key string, ts timestamp_ntz, action string, category string")
    table = by_key(listed.collect())
    out = url_lists.judge_captures(captures, listed.withColumn("ts", url_lists.F.col("ts").cast("timestamp")).withColumn("slice", url_lists.F.lit("x")))
    assert out.columns == ["url", "fetch_ts", "__url", "key", "a.b", "blocked", "matched_key", "category", "listed_since"]
    got = out.selectExpr("url", "unix_timestamp(fetch_ts) t", "blocked", "matched_key", "category", "unix_timestamp(listed_since) since", "__url").collect()
    assert Counter((r.url, r.t) for r in got) == Counter((u, t and int(t.replace(tzinfo=dt.UTC).timestamp())) for u, t, *_ in rows)
    for r in got:
        assert ((r.matched_key, r.category, r.since) if r.blocked else None) == judged(r.url, r.t, table), r
        assert r["__url"] == ("own" if r.t else None)
    assert url_lists.judge_captures(captures.limit(0), listed).count() == 0
    assert url_lists.judge_captures(captures, listed.limit(0)).filter("blocked").count() == 0

# preference pairs
def rendered(turns):
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in turns)

def spans(turns):
    at, out = 0, []
    for _, role, text in turns:
        size = len(role) + len(text) + 13
        if role == "assistant":
            out.append((at + len(role) + 5, at + size))
        at += size
    return out

def paired(chosen, rejected):
    clean = lambda side: sorted({(t, r or "", x or "") for t, r, x in side}, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
    c, r = clean(chosen), clean(rejected)
    n = 0
    while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
        n += 1
    return n, rendered(c[:n]), rendered(c[n:]), spans(c[n:]), rendered(r[n:]), spans(r[n:])

def test_conversations_become_pairs(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    by = defaultdict(set)
    for r in conversations.collect():
        by[r.conv_id].add((r.turn, r.role, r.text))
    last = {k: max((t[0], t[2] or "") for t in v if t[1] == "assistant") for k, v in by.items() if any(t[1] == "assistant" for t in v)}
    want = {k: paired(v, []) for k, v in by.items() if k not in last}
    assert want
    for k, (turn, _) in last.items():
        other = [(turn, "assistant", last[k ^ 1][1])] if k ^ 1 in last else []
        want[k] = paired(by[k], [t for t in by[k] if t[0] < turn] + other)
    out = preference.formatted_conversations(conversations).collect()
    text = lambda s: ";".join(f"{a}:{b}" for a, b in s)
    assert {r.conv_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in out} == {k: (n, p, c, text(m), r, text(q)) for k, (n, p, c, m, r, q) in want.items()}
    assert len(out) == len(want)
    assert preference.formatted_conversations(conversations.limit(0)).collect() == []

def test_turns_without_a_conversation(spark):
    rows = [(None, 0, "user", "hi", "x"), (None, 1, "assistant", None, "x"), (None, 0, "user", "hi", "x"), (8, 0, "user", "alone", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id string")
    out = [(r.conv_id, r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.formatted_conversations(df).collect()]
    assert Counter(out) == Counter([(None, 0, "", "<|user|>\nhi<|end|>\n", "", "", "")] * 2 + [(None, 0, "", "<|assistant|>\n<|end|>\n", "14:22", "", ""), (8, 0, "", "<|user|>\nalone<|end|>\n", "", "", "")])

def test_odd_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi", "x"), (1, "chosen", 0, "user", "hi", "x"), (1, "chosen", 1, "assistant", "a" * 200_000, "x"), (1, "rejected", 0, "user", "hi", None), (1, "rejected", 1, "assistant", "no", "x"),
        (2, "chosen", 0, None, None, "x"), (2, "rejected", None, "user", "q", "x"), (3, "chosen", 0, "user", "only", "x"), (4, "rejected", 5, "assistant", "", "x"), (5, "chosen", 0, "user", "same", "x"), (5, "rejected", 0, "user", "same", "x"),
        (6, "other", 0, "user", "gone", "x"), (None, "chosen", 0, "user", "Ünï", "x"), (None, "rejected", 0, "user", "Ün", "x"), (7, None, 0, "user", "gone", "x"),
    ]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, c string")
    sides = defaultdict(lambda: ([], []))
    for k, side, *t, _ in rows:
        if side in ("chosen", "rejected"):
            sides[k][side == "rejected"].append(tuple(t))
    out = preference.format_pairs(turns).collect()
    assert {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask]) for r in out} == {k: paired(*v) for k, v in sides.items()}
    for r in out:
        for side, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(side[: a].endswith("<|assistant|>\n") and side[a:b].endswith("<|end|>\n") for a, b in mask)
    assert preference.format_pairs(turns.limit(0)).count() == 0

# exact top k
def best(rows, k=20):
    """Of (vec_id, vector) rows: what every distinct row with an id divisible by 20 gets."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out.update((q, n, i, -s) for n, (s, i) in enumerate(found, 1))
    return out

@pytest.mark.parametrize("block, asked", [(8192, 4096), (70, 9)])
def test_top_scores_of_the_table(spark, block, asked):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = nra.quantized(vectors)
    out = nra.top_k(v, v.filter("vec_id % 20 = 0"), block=block, asked=asked)
    assert Counter(map(tuple, out.collect())) == best([(r.vec_id, r.embedding) for r in vectors.collect()])

def test_top_scores_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(200)]
    rows += [(i + 500, rows[20][1]) for i in range(60)]  # ties
    rows += [(40, [1.0] * 6), (40, rows[40][1]), (7, rows[7][1]), (300, None), (320, [None, 1.0]), (340, [float("nan")]), (360, [float("inf"), 0.0]), (380, []), (400, [0.5]), (420, [0.0] * 6), (None, [1.0] * 6), (440, [-2.0] * 8), (460, [1e6, -1e6])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, q string, score string")
    for block, asked in ((8192, 4096), (30, 3)):
        v = nra.quantized(df)
        out = nra.top_k(v, v.filter("vec_id % 20 = 0"), block=block, asked=asked)
        assert Counter(map(tuple, out.collect())) == best(rows)
    assert nra.top_scores(df.limit(0)).count() == 0
    assert nra.top_scores(df.filter("vec_id = 20")).count() == 0

# the pipeline
def pieces(rows, tokenizer):
    out = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            out[r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    return out

def test_pipeline_stage_by_stage(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    columns = docs[0].columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], sf).write.parquet(str(tmp_path / name))
        docs.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in docs[:-1])
    given, clean, single, private, mixed, packed = (d.collect() for d in docs)
    marked = {r.doc_id: r.predicted for r in toxicity.scored_documents(docs[0], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert Counter(clean) == Counter(r for r in given if not marked[r.doc_id])
    prints = {r.doc_id: fingerprint(r.text) for r in clean}
    nodes = sorted(set(prints.values()))
    top = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    assert Counter(top[prints[r.doc_id]] for r in single) == Counter(set(top.values())) and set(single) <= set(clean)
    assert Counter(r.doc_id for r in private) == Counter(r.doc_id for r in single)
    assert all(r.n_chars == len(r.text) for r in private)
    times = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(docs[3]).collect() if r.taken}
    assert Counter(mixed) == Counter({r: times[r.doc_id] for r in private if r.doc_id in times})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = pieces(mixed, tokenizer)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in run.collect()) == want
