"""Quality rules whose thresholds follow quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words_of, written

#: Rules on ratios per thousand: metric -> (numerator, denominator). High values are bad.
METRICS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Least distance between the quartiles, per thousand: a metric that hardly varies doesn't make a rule out of noise.
SPREAD = {"symbols": 10, "dup_lines": 50, "repeats": 50, "word_length": 1000}
FENCE = 3
#: Documents from which a sketch speaks for itself; smaller groups use the merged sketch of their language, then of all.
ENOUGH = 30
#: A bucket holds values that agree in their SHARP leading bits after the first (relative error 1 / 2**SHARP).
SHARP = 5


def base_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w):
        n = F.size(w)
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(places, window)

        def covered(h):
            # windows by (hash, place): one is repeated if a neighbour has its hash and its words
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def marked(p):
                same = lambda a, b: (a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"])) & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2))
                near = F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)))
                spots = F.sort_array(F.transform(near, lambda x: x["i"]))
                # each window adds the words up to the next one, three at most
                return let(spots, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, marked))

        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), let(hashes, covered).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    parts = F.struct(let(words_of(text), of_words).alias("w"), by_line.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return let(parts, lambda p: F.struct(p["w"]["n_words"].alias("n_words"), p["w"]["word_chars"].alias("word_chars"), p["n_symbols"].alias("n_symbols"), p["l"]["n_lines"].alias("n_lines"), p["l"]["n_dup_lines"].alias("n_dup_lines"), p["w"]["n_repeat_words"].alias("n_repeat_words")))


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number >= 0: small values are their own, others keep SHARP bits after the first."""
    shift = F.greatest(F.length(F.bin(v)) - 1 - SHARP, F.lit(0))
    return F.expr("0") + shift.cast("long") * (1 << SHARP) + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long")


def upper_end(b: Column) -> Column:
    """The largest value of a bucket."""
    top = 1 << SHARP
    shift = F.greatest(F.floor(b / F.lit(float(top))).cast("long") - 1, F.lit(0))
    return ((b - shift * top + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def ratio(metric: str) -> Column:
    a, b = METRICS[metric]
    return F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, b, n): per group and metric a histogram over buckets, the sketch.

    Merging is adding counts, so partial sketches of any split of the rows give the same result, in any
    order; a sketch has at most a few hundred buckets."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(ratio(m)).alias("b")) for m in METRICS))
    return rows.filter(~F.col("base_failed")).select("lang", "source", F.inline(each)).groupBy("lang", "source", "metric", "b").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, metric, total, q1, q3) of sketches merged to ``by``."""
    merged = sketch.groupBy(*by, "metric", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    run = merged.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("b"))})
    at = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("total") * part, upper_end(F.col("b"))))
    return run.groupBy(*by, "metric").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the highest and (for word length) lowest value that passes each metric."""
    own, lang, all_ = (quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    rows = own.alias("o").join(lang.alias("g"), F.col("o.lang").eqNullSafe(F.col("g.lang")) & (F.col("o.metric") == F.col("g.metric")))
    rows = rows.join(all_.alias("a"), F.col("o.metric") == F.col("a.metric"))
    pick = lambda c: F.when(F.col("o.total") >= ENOUGH, F.col(f"o.{c}")).when(F.col("g.total") >= ENOUGH, F.col(f"g.{c}")).otherwise(F.col(f"a.{c}"))
    rows = rows.select("o.lang", "o.source", "o.metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = F.element_at(F.create_map(*(x for m, v in SPREAD.items() for x in (F.lit(m), F.lit(v)))), F.col("metric"))
    width = F.greatest(F.col("q3") - F.col("q1"), spread)
    rows = rows.withColumns({"high": F.col("q3") + FENCE * width, "low": F.col("q1") - FENCE * width})
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return rows.groupBy("lang", "source").agg(*(one(m, "high").alias(f"high_{m}") for m in METRICS), one("word_length", "low").alias("low_word_length"))


def judge(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, the base metrics, base_failed and kept.

    A document that passes the base rules is kept if each metric lies within the fences of its language and
    source: quartiles of the sketch, three times their distance beyond. Null languages and sources are
    groups of their own; null and empty texts have no words and fail the base rules; repeated rows count
    as often as they occur. Empty in, empty out."""
    rows = docs.select(*carry, "lang", "source", base_metrics(F.col("text")).alias("__m")) if not {"lang", "source"} & set(carry) else docs.select(*carry, base_metrics(F.col("text")).alias("__m"))
    rows = rows.select("*", "__m.*").drop("__m")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed), "quality")
    limits = written(thresholds(sketches(rows)), "thresholds").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    passes = F.lit(True)
    for m in METRICS:
        passes = passes & (ratio(m) <= F.col(f"high_{m}"))
    passes = passes & (ratio("word_length") >= F.col("low_word_length"))
    kept = ~F.col("base_failed") & F.coalesce(passes, F.lit(True))
    return rows.withColumn("kept", kept).select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged_documents(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"])
