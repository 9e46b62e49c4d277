"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Words of a window and words from one window to the next; neighbours overlap, and windows cover a text to its end.
WINDOW, STRIDE = 32, 24
#: Bound on labelled rows that the network is fitted on: toxic ones and others.
FIT_TOXIC, FIT_OTHER = 1500, 2000
#: Bound on the bytes of their texts.
FIT_BYTES = 64 << 20
THRESHOLD = 0.3
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 17, 16, 6, 6
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 11
#: Fewest steps of the fit: few labelled rows are gone through in more epochs.
STEPS = 400
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¿¡«»“”„…"
#: Bytes of text that are scored at once.
AT_ONCE = 8 << 20


def tokens(texts):
    """Words between ASCII white space of an Arrow array of strings: (distinct words, word numbers, words of each text).

    An empty text has one empty word."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    line = parts.flatten().dictionary_encode()
    return line.dictionary, line.indices.to_numpy().astype(np.int64), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


def features(words):
    """Hashed inputs of an Arrow array of words: (word bucket, buckets of all character grams, word of each gram).

    A word is taken in lower case and without punctuation around it; its characters enter as grams of three
    and five UTF-8 bytes, with marks for its start and end, so unseen words share inputs with known ones."""
    import pyarrow.compute as pc

    marked = pc.binary_join_element_wise("^", pc.utf8_lower(pc.utf8_trim(words, PUNCTUATION)), "$", "")
    start = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    c = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[start[0] : start[-1]].astype(np.uint32)
    n, start = np.diff(start), start[:-1] - start[0]
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)

    def mixed(h, bits):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)).astype(np.int64)

    power = np.cumprod(np.full(max(1, int(n.max(initial=1))), 0x01000193, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(c * power[np.arange(len(c)) - start[owner]], start, dtype=np.uint32) if len(c) else np.empty(0, np.uint32)
    grams, of = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for size, salt in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        if len(c) < size:
            continue
        h = np.full(len(c) - size + 1, salt, np.uint32)
        for k in range(size):
            h = (h ^ c[k : len(c) - size + 1 + k]) * np.uint32(0x01000193) + np.uint32(k)
        inside = owner[: len(h)] == owner[size - 1 :]
        grams.append(mixed(h[inside], GRAM_BITS))
        of.append(owner[: len(h)][inside])
    return mixed(whole, WORD_BITS), np.concatenate(grams), np.concatenate(of)


def inputs(model: dict, feats):
    """The input vector of each word: its own embedding and the mean of its grams' embeddings."""
    word, gram, of = feats
    total = np.stack([np.bincount(of, model["grams"][gram, k], len(word)) for k in range(DIM)], 1) if len(gram) else np.zeros((len(word), DIM))
    count = np.maximum(1, np.bincount(of, minlength=len(word)))[:, None]
    return np.concatenate([model["words"][word], total / count], 1).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forward(model: dict, xf, xb, live, keep: bool = False):
    """Logits of windows. xf, xb: (T, N, 3 * HIDDEN) projected inputs of the two directions, each in its reading order;
    live: (T, N) 1 for words, 0 for filling; ``keep`` returns what the gradient needs."""
    steps, n = live.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, 2, n, HIDDEN), np.float32)
    cache, k = [], HIDDEN
    full = bool(live.all())
    for t in range(steps):
        x = np.stack([xf[t], xb[t]])
        g = np.matmul(h, model["u"])
        gates = sigmoid(x[..., : 2 * k] + g[..., : 2 * k])
        z, r = gates[..., :k], gates[..., k:]
        c = g[..., 2 * k :] + model["c"]
        new = np.tanh(x[..., 2 * k :] + r * c)
        on = None if full else np.stack([live[t], live[steps - 1 - t]])[..., None]
        if keep:
            cache.append((h, z, r, c, new, on))
        h = new + z * (h - new)
        if not full:
            h = h * on
        states[t] = h
    both = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # (T, N, 2 * HIDDEN) in the order of the words
    e = np.where(live > 0, both @ model["v"], np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a *= live
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, both)
    logit = pooled @ model["o"] + model["b"][0]
    return (logit, pooled, a, both, states, cache) if keep else logit


def fresh(rng) -> dict:
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {
        "words": draw(1 << WORD_BITS, DIM, s=0.3), "grams": draw(1 << GRAM_BITS, DIM, s=0.3), "w": draw(2, 2 * DIM, 3 * HIDDEN, s=0.4), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "u": draw(2, HIDDEN, 3 * HIDDEN, s=0.3), "c": np.zeros((2, 1, HIDDEN), np.float32), "v": draw(2 * HIDDEN, s=0.3), "o": draw(2 * HIDDEN, s=0.3), "b": np.zeros(1, np.float32),
    }


def gradient(model: dict, feats, ids, live, label, weight) -> dict:
    """Gradient of the weighted logistic loss over windows; ids: (T, N) rows of ``feats``."""
    steps, n = live.shape
    x = inputs(model, feats)
    p = np.matmul(x, model["w"]) + model["bx"]
    logit, pooled, a, both, states, cache = forward(model, p[0][ids], p[1][ids[::-1]], live, keep=True)
    k, grad = HIDDEN, {name: np.zeros_like(v) for name, v in model.items() if name not in ("words", "grams")}
    dl = (weight * (sigmoid(logit) - label) / n).astype(np.float32)
    grad["o"], grad["b"][0] = pooled.T @ dl, dl.sum()
    dpool = dl[:, None] * model["o"]
    s = np.einsum("tnh,nh->tn", both, dpool)
    de = a * (s - (a * s).sum(0))
    grad["v"] = np.einsum("tn,tnh->h", de, both)
    dboth = a[..., None] * dpool + de[..., None] * model["v"]
    dstate = np.stack([dboth[..., :k], dboth[::-1, :, k:]], 1)
    dh, dx = np.zeros((2, n, k), np.float32), np.zeros((steps, 2, n, 3 * k), np.float32)
    for t in reversed(range(steps)):
        h, z, r, c, new, on = cache[t]
        dh = dh + dstate[t]
        if on is not None:
            dh = dh * on
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * c * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r], -1)
        dx[t] = np.concatenate([dz, dr, dn], -1)
        grad["u"] += np.matmul(h.transpose(0, 2, 1), dg)
        grad["c"] += (dn * r).sum(1, keepdims=True)
        dh = dh * z + np.matmul(dg, model["u"].transpose(0, 2, 1))
    dx[:, 1] = dx[::-1, 1]  # back to the order of the words
    dx *= live[:, None, :, None]
    grad["bx"] = dx.sum((0, 2))[:, None]
    dp = np.zeros((2, len(x), 3 * k), np.float32)
    flat = ids.ravel()
    for d in range(2):
        g = dx[:, d].reshape(-1, 3 * k)
        for j in range(3 * k):
            dp[d, :, j] = np.bincount(flat, g[:, j], len(x))
    grad["w"] = np.matmul(x.T, dp)
    dinput = np.matmul(dp, model["w"].transpose(0, 2, 1)).sum(0)
    word, gram, of = feats
    count = np.maximum(1, np.bincount(of, minlength=len(word)))[:, None]
    for name, rows, g in (("words", word, dinput[:, :DIM]), ("grams", gram, (dinput[:, DIM:] / count)[of])):
        used, at = np.unique(rows, return_inverse=True)  # of the tables only the rows that take part
        grad[name] = used, np.stack([np.bincount(at, g[:, j], len(used)) for j in range(DIM)], 1).astype(np.float32)
    return grad


def lexicon(words, part: int = 20_000):
    """Word buckets, gram buckets in the order of the words, and how many grams each word has."""
    out = [], [], []
    for a in range(0, len(words), part):
        word, gram, of = features(words.slice(a, part))
        order = np.argsort(of, kind="stable")
        for column, v in zip(out, (word, gram[order], np.bincount(of, minlength=len(word)))):
            column.append(v.astype(np.int32))
    return tuple(np.concatenate(x) for x in out)


def windows(lengths):
    """(document, first word, words) of every window of documents with so many words each."""
    lengths = np.asarray(lengths, np.int64)
    count = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(lengths) - lengths)[doc] + k * STRIDE
    return doc, first, np.minimum(WINDOW, lengths[doc] - k * STRIDE), count


def laid(ids, first, size):
    """(T, N) ids and live marks of windows over the line of all words."""
    at = np.arange(WINDOW)[:, None]
    live = (at < size).astype(np.float32)
    if not len(ids):
        return np.zeros(live.shape, np.int64), live
    return ids[np.minimum(first + at, len(ids) - 1)], live


def logits(model, pf, pb, ids, first, size, chunk: int = 4096):
    """Logits of windows; pf, pb: projected inputs by word id."""
    out = np.empty(len(first), np.float32)
    order = np.argsort(size != WINDOW, kind="stable")  # full windows together: they need no marks
    for s in range(0, len(order), chunk):
        some = order[s : s + chunk]
        words, live = laid(ids, first[some], size[some])
        out[some] = forward(model, pf[words], pb[words[::-1]], live)
    return out


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict | None:
    """The network, or None if one of the classes is missing.

    A text is toxic if one of its windows is: in each epoch the window that scores highest stands for its text,
    and a further one drawn at random for texts that aren't toxic. Before the first epoch windows are ranked
    by the log odds of their words."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    import pyarrow as pa

    distinct, ids, lengths = tokens(pa.array(texts, pa.string()))
    known, ids = len(distinct), ids.astype(np.int32)
    buckets, grams, each = lexicon(distinct)
    gram_at = np.cumsum(each) - each
    doc, first, size, count = windows(lengths)
    at = np.cumsum(count) - count

    def taken(used):
        """Inputs of some of the words."""
        n = each[used].astype(np.int64)
        of = np.repeat(np.arange(len(used)), n)
        return buckets[used], grams[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(gram_at[used], n)], of

    rng = np.random.default_rng(seed)
    model = fresh(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))

    owner = np.repeat(np.arange(len(y)), lengths)
    who, which = np.divmod(np.unique(owner * known + ids), known)
    n = [np.bincount(buckets[which], w[who], 1 << WORD_BITS) for w in (y, 1 - y)]
    odds = (np.log((n[0] + 0.5) / (y.sum() + 1)) - np.log((n[1] + 0.5) / (len(y) - y.sum() + 1)))[buckets].astype(np.float32)
    del who, which, n
    top = np.empty(len(first), np.float32)
    for a in range(0, len(first), 4096):
        line, live = laid(ids, first[a : a + 4096], size[a : a + 4096])
        top[a : a + 4096] = np.where(live > 0, odds[line], -9).max(0)
    share, step = float(y.mean()), 0
    epochs = max(epochs, -(-STEPS * BATCH // (len(y) + int((y == 0).sum()))))
    for epoch in range(epochs):
        if epoch and epoch % 2 == 0:
            for a in range(0, len(first), 4096):  # a part of the windows and the words in them at a time
                line, live = laid(ids, first[a : a + 4096], size[a : a + 4096])
                used, local = np.unique(line, return_inverse=True)
                p = np.matmul(inputs(model, taken(used)), model["w"]) + model["bx"]
                line = local.reshape(line.shape)
                for s in range(0, line.shape[1], 4096):
                    some = line[:, s : s + 4096]
                    top[a + s : a + s + some.shape[1]] = forward(model, p[0][some], p[1][some[::-1]], live[:, s : s + 4096])
        best = np.lexsort((-top, doc))[at]
        other = np.flatnonzero(y == 0)
        more = at[other] + (rng.random(len(other)) * count[other]).astype(np.int64)
        chosen = rng.permutation(np.concatenate([best, more]))
        for s in range(0, len(chosen), BATCH):
            some = chosen[s : s + BATCH]
            line, live = laid(ids, first[some], size[some])
            used, local = np.unique(line, return_inverse=True)
            label = y[doc[some]]
            weight = np.where(label > 0, (1 - share) / share, 1).astype(np.float32)
            grad = gradient(model, taken(used), local.reshape(line.shape), live, label, weight)
            step += 1
            rate = RATE * (1 - 0.9 * step / (epochs * (len(chosen) // BATCH + 1)))
            for k, g in grad.items():
                rows, g = g if isinstance(g, tuple) else (slice(None), g)
                m1[k][rows] += 0.1 * (g - m1[k][rows])
                m2[k][rows] += 0.001 * (g * g - m2[k][rows])
                model[k][rows] -= (rate / (1 - 0.9**step) * m1[k][rows] / (np.sqrt(m2[k][rows] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def score(model: dict, texts):
    """The highest probability among the windows of each text of an Arrow array without nulls."""
    distinct, ids, lengths = tokens(texts)
    p = np.matmul(inputs(model, features(distinct)), model["w"]) + model["bx"]
    _, first, size, count = windows(lengths)
    return sigmoid(np.maximum.reduceat(logits(model, p[0], p[1], ids, first, size), np.cumsum(count) - count).astype(np.float64))


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def trained(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, other: int = FIT_OTHER, most_bytes: int = FIT_BYTES) -> dict | None:
    """The network fitted on at most so many toxic and other labelled rows and bytes, chosen by a hash of the id.

    Rows that are held out, and labels that are null, are never looked at. A repeated label counts as toxic
    if one of its rows does; a repeated id brings one text. Whole texts are taken, in the order of the hash, as long as
    their sum stays within the bytes. The fit runs in one task on the bounded rows; the driver gets the weights."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")
    chosen = rows.filter("toxic = 1").orderBy(*order).limit(toxic).union(rows.filter("toxic = 0").orderBy(*order).limit(other))
    # at most FIT_TOXIC + FIT_OTHER rows of two numbers: small enough to broadcast at any size of the corpus
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    size = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("size", size).filter(F.col("size") <= most_bytes).select("doc_id", "text", "toxic")

    def fitted(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        if model is not None:
            np.savez(out := io.BytesIO(), **model)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])

    weights = found.mapInArrow(fitted, "weights binary").first()
    return dict(np.load(io.BytesIO(weights[0]))) if weights else None


def scores(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text: the highest probability among its windows.

    A text without words (null, empty) has one window of an empty word; without a model every score is 0. Only
    texts go to the workers, and scores come back."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.cast(pa.string()).fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            out, a = [np.empty(0)], 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + AT_ONCE, side="right")))
                out.append(score(model, texts.slice(a, b - a)))
                a = b
            yield pa.array(np.concatenate(out))

    return docs.withColumn(column, F.arrow_udf(scored, "double")("text"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scores(docs.select("doc_id", "text"), trained(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts that the network calls toxic."""
    return scores(docs, trained(docs, labels), "__toxicity").filter(F.col("__toxicity") < THRESHOLD).select(*docs.columns)


ship(__name__)
