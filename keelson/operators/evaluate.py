"""Evaluation of scores and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rnd
from .gold import mean
from .ranks import running, running_counts
from .store import stored

C = F.col


def classification(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    n = lambda c: F.count_if(c).cast("double")
    tp, fp, fn, tn = n(predicted & (label == 1)), n(predicted & (label == 0)), n(~predicted & (label == 1)), n(~predicted & (label == 0))
    gap, all_rows, part = C("churn_probability") - label, F.count("*").cast("double"), F.try_divide
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (all_rows * all_rows)
    out = {
        "accuracy": part(tp + tn, all_rows), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "balanced": (part(tp, tp + fn) + part(tn, tn + fp)) / 2,
        "mcc": part(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": part(part(tp + tn, all_rows) - chance, 1 - chance), "brier": mean(gap * gap, 12),
    }
    return df.agg(*(rnd(v, 6).alias(k) for k, v in out.items()))


def areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, average_precision): the area under the ROC curve by average ranks, and precision averaged over the recall gained.

    Scores are counted once with their labels; places among all rows and among positive ones are two prefix sums."""
    counts = stored(df.filter(C(score).isNotNull()).groupBy(C(score).cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(C(label) == 1).alias("pos")), "scores")
    of_all = running_counts(counts, [])
    of_pos = running_counts(counts.select("v", C("pos").alias("n")), []).select("v", C("n").alias("pos"), C("before").alias("pos_before"), C("total").alias("positive"))
    rows = of_all.join(of_pos, "v")
    ranks = F.sum(C("pos") * (C("before") + (C("n") + 1) / 2.0))
    p, every = F.max("positive").cast("double"), F.max("total")
    gained = F.sum(C("pos") * (C("positive") - C("pos_before")) / (C("total") - C("before")))
    return rows.agg(rnd(F.try_divide(ranks - p * (p + 1) / 2.0, p * (every - p)), 6).alias("auc"), rnd(F.try_divide(gained, p), 6).alias("average_precision"))


def sweep(df: DataFrame, p: Column, label: Column) -> DataFrame:
    """(th, tp, fp, precision, recall, f1, best) at each hundredth: rows are counted by hundredth once, then summed from above.

    best: the highest F1, the smallest threshold on ties."""
    bins = df.groupBy(F.floor(p * 100).alias("th")).agg(F.count_if(label == 1).alias("a"), F.count_if(label == 0).alias("b"))
    every = df.sparkSession.range(0, 101).withColumnRenamed("id", "th")
    down, whole = Window.orderBy(F.desc("th")), Window.partitionBy()  # 101 rows
    rows = every.join(bins, "th", "left").fillna(0, ["a", "b"])
    rows = rows.select("th", F.sum("a").over(down).alias("tp"), F.sum("b").over(down).alias("fp"), F.sum("a").over(whole).alias("p")).filter("th between 1 and 99")
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumns({"precision": part(C("tp"), C("tp") + C("fp")), "recall": part(C("tp"), C("p")), "f1": part(2 * C("tp"), C("tp") + C("fp") + C("p"))})
    best = F.row_number().over(Window.orderBy(F.desc("f1"), "th")) == 1
    return rows.select("th", "tp", "fp", *(rnd(C(c), 6).alias(c) for c in ("precision", "recall", "f1")), best.alias("best"))


def latency(events: DataFrame, keys: list[str]) -> DataFrame:
    """n, avg_value and the p50, p95, p99 of floor nearest rank for each key, over all records."""
    rows = running(events, keys, "value")
    at = lambda p: F.max(F.when((C("before") < C("r")[p]) & (C("r")[p] <= C("before") + C("n")), C("v")))
    rows = rows.withColumn("r", F.array(*(F.greatest(F.lit(1), F.floor(C("total") * p / F.lit(100))) for p in (50, 95, 99))))
    picked = rows.groupBy(*keys).agg(at(0).alias("p50"), at(1).alias("p95"), at(2).alias("p99"))
    base = events.groupBy(*keys).agg(F.count("value").alias("n"), rnd(mean("value", 4), 4).alias("avg_value"))
    return base.join(picked, keys)


def picked_latency(events: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """n, mean, median, p95, p99, least and most for each key; a percentile is the value at place floor(n * q), from 0."""
    rows = running(events, keys, column)
    at = lambda r: F.max(F.when((C("before") <= r) & (r < C("before") + C("n")), C("v")))
    place = lambda q: F.floor(C("total") * F.lit(q))
    middle = (at(F.floor((C("total") - 1) / 2)) + at(F.floor(C("total") / 2))) / 2
    picked = rows.groupBy(*keys).agg(middle.alias("median"), at(place(0.95)).alias("p95"), at(place(0.99)).alias("p99"), F.min("v").alias("least"), F.max("v").alias("most"))
    base = events.groupBy(*keys).agg(F.count(column).alias("n"), rnd(mean(column, 4), 2).alias("avg"))
    return base.join(picked, keys)


def curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision) at each distinct score, taken as the threshold.

    Labels are counted by score, then summed from above by thousandths of the score and within each of them, so no
    task sees all scores."""
    counts = df.groupBy(C(score).alias("score")).agg(F.count_if(C(label) == 1).alias("a"), F.count_if(C(label) == 0).alias("b")).withColumn("part", F.floor(C("score") * 1000))
    whole, above = Window.partitionBy(), Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    sums = sums.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"up_{c}") for c in ("pa", "pb")), F.sum("pa").over(whole).alias("pos"), F.sum("pb").over(whole).alias("neg"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    rows = counts.withColumns({"a": F.sum("a").over(down), "b": F.sum("b").over(down)}).join(sums, "part")
    tp, fp = C("a") + C("up_pa"), C("b") + C("up_pb")
    return rows.select("score", tp.alias("tp"), fp.alias("fp"), (tp / C("pos")).alias("tpr"), (fp / C("neg")).alias("fpr"), (tp / (tp + fp)).alias("precision"))
