"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

CAPACITY = 2048
#: Bytes of words, and again of other parts of texts, whose ids a worker remembers.
REMEMBERED = 100 << 20
#: What an entry takes besides its characters and ids.
ENTRY = 200


def encoder(path: str):
    """text -> its ids as little-endian bytes.

    The tokenizer composes characters, makes them small, splits words by a pattern that drops white space, writes bytes
    as letters and then merges. On printable ASCII, its white space and the letters of Latin-1 all but the last are plain:
    such a text is split here, and each word is merged once by the tokenizer's model. Another text is cut at spaces and
    line feeds, and its parts that aren't plain, or may hold the name of a special token, go through the whole
    tokenizer. What is remembered is bounded by bytes."""
    import os
    import re
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    model = tok.model
    letters = Tokenizer(model)
    letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    strange = re.compile(r"[^ \t\n\r!-~À-ÖØ-öø-ÿ]").search
    # the tokenizer's own pattern with the letters and digits of plain texts: a fixed value
    words = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\ra-zß-öø-ÿ0-9]+").findall

    class Known(dict):
        size = 0

        def __init__(self, make):
            self.make = make

        def __missing__(self, key):
            ids = self.make(key)
            self.size += len(key) + len(ids) + ENTRY
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            self[key] = ids
            return ids

    def merged(word):
        if word.isascii():
            return array("I", [t.id for t in model.tokenize(word)]).tobytes()
        return array("I", letters.encode(word, add_special_tokens=False).ids).tobytes()

    of_word = Known(merged).__getitem__

    def of_part(part):
        if "<|" in part or strange(part):
            return array("I", tok.encode(part, add_special_tokens=False).ids).tobytes()
        return b"".join(map(of_word, words(part.lower())))

    of_part = Known(of_part).__getitem__

    def ids(text):
        if "<|" in text or strange(text):
            return b"".join(map(of_part, text.replace("\n", " ").split(" ")))
        return b"".join(map(of_word, words(text.lower())))

    return ids


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then id 0, cut at ``capacity``.

    The encoder lives as long as its worker process: it hangs on a
    module of its own name, as the functions of this one are sent anew with each task."""

    def cut(batches):
        import sys
        import types
        import zlib

        import pyarrow as pa

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        kept = vars(sys.modules.setdefault("keelson_worker_encoders", types.ModuleType("keelson_worker_encoders")))
        if path not in kept:
            kept[path] = encoder(path)
        encode = kept[path]
        end, width = b"\0\0\0\0", 4 * capacity
        for batch in batches:
            out = [], [], [], [], []
            source = []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    source.append(row)
                    for column, v in zip(out, (k, at // 4, len(piece) // 4, zlib.crc32(piece))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int, first: int) -> list[tuple[int, int]]:
    """The combination of available lengths that holds ``first`` and fills a bin best: [(length, how many)].

    Subset sums are bits of one integer; lengths come in powers of two of their count, and the bitset
    before each step is kept to walk back from the highest sum."""
    room = capacity - first
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, bunch = min(counts[length] - (length == first), room // length), 1
        while n > 0:
            k = min(bunch, n)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & full
            n, bunch = n - k, 2 * bunch
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {first: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] = taken.get(length, 0) + k
    return sorted(taken.items(), reverse=True)


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: [(number of equal bins, combination)].

    Each bin holds the longest length left. What is found is removed; while the same combination is still
    there it stays the fullest, so it is taken as often as the counts allow. The work depends on the
    number of lengths, not on the number of pieces."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        combination = fullest(left, capacity, max(left))
        times = min(left[length] // k for length, k in combination)
        out.append((times, combination))
        for length, k in combination:
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return out


def ranked(pieces: DataFrame, by: str, key: list[Column], buckets: int = 256) -> DataFrame:
    """Adds ``rank`` (from 0) among the rows of equal ``by``; a value with very many rows is dealt over ``buckets``."""
    rows = pieces.withColumn("__b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "__b").count().withColumn("__at", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(by, "__b").orderBy(*key)
    rows = rows.withColumn("__r", F.row_number().over(inside) - 1)
    return rows.join(starts, [by, "__b"]).withColumn("rank", F.col("__at") + F.col("__r")).drop("__b", "__at", "__r")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    The driver sees the histogram of lengths (``capacity`` numbers at most) and fills bins over it; pieces
    of one length are interchangeable, so a piece finds its bin from its rank among them."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    keys, ranks, firsts, each, offsets, bin_at = [], [], [], [], [], 0
    used: dict[int, int] = {}
    for times, combination in bins(counts, capacity):
        offset = 0
        for length, k in combination:
            r = used.get(length, 0)
            keys.append((length, r))
            ranks.append(r)
            firsts.append(bin_at)
            each.append(k)
            offsets.append(offset)
            used[length] = r + times * k
            offset += length * k
        bin_at += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    table = [[col[i] for i in order] for col in ([k[0] for k in keys], ranks, firsts, each, offsets)]
    names = pieces.columns

    def place(batches):
        import numpy as np
        import pyarrow as pa

        length, start, first, k, offset = (np.array(x, np.int64) for x in table)
        at = (length << 48) + start
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(at, (n << 48) + r, side="right") - 1
            r = r - start[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(first[i] + r // k[i]), pa.array(offset[i] + r % k[i] * n)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked(pieces, "length", [F.col(c) for c in names]).select(*names, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as minimum bin slack finds.

    A null text is an empty one (one id, 0); a null id stays null; repeated rows are packed as often as
    they occur; very long texts are cut into pieces; other columns are ignored. Empty in, empty out."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


ship(__name__)
