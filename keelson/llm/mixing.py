"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weights by the place of a source in code-point order (null last), repeating.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the seeded order that choose a bucket of a source.
PREFIX = 3


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``size`` (words; null text: 0) and ``__order``, a seeded order of the documents of a source."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__order": key})


def targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size): adds ``weight`` and ``target``.

    Clamping the sources over their cap and resharing the excess by weight, again and again, ends at one
    water level: target = min(cap, level * weight). The sources clamped are the first ones by
    cap / weight, so one running sum over the sources finds the level without rounds. (One row a source.)"""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumns({"weight": w}).withColumn("__cap", F.col("source_size") * epochs)
    line = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "__total": F.sum("source_size").over(every) * share_percent / F.lit(100.0),
        "__full": F.coalesce(F.sum("__cap").over(line), F.lit(0)),
        "__rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(line), F.lit(0)),
    })
    # the level if all sources before this one are clamped; right for the first that stays under its cap
    rows = rows.withColumn("__level", (F.col("__total") - F.col("__full")) / F.col("__rest"))
    fits = F.col("__level") * F.col("weight") <= F.col("__cap")
    rows = rows.withColumn("__level", F.min_by(F.when(fits, F.col("__level")), F.when(fits, F.col("__cap") / F.col("weight"))).over(every))
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def plan(sizes: DataFrame) -> DataFrame:
    """(source, size, __order) of all documents -> per source: source_size, target, whole, last.

    A document is taken ``whole`` times, and once more if its order is at most ``last``: the seeded order
    is followed until the fractional part of target / source_size is reached, to the nearest document.
    Only the bucket of the order in which that happens is sorted by row; buckets are summed first, so no
    task gets the rows of a whole source. Documents of equal order (repeated rows) go together. A source without a
    fractional part has no such bucket, so nothing is taken more than ``EPOCHS`` times, empty texts included."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = targets(per)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = written(per.withColumns({"whole": F.floor(ratio).cast("int"), "part": F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio) * F.col("source_size"))}), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    bucket = F.substring("__order", 1, PREFIX)
    sums = sizes.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    edge = sums.join(per.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).filter((F.col("part") > 0) & (F.col("before") <= F.col("part")) & (F.col("before") + F.col("n") > F.col("part"))).drop("s")
    edge = written(edge.select("source", "b", "before", "part"), "mix-edges")
    rows = sizes.withColumn("b", bucket).groupBy("source", "b", "__order").agg(F.sum("size").alias("size"))
    e = edge.select(F.col("source").alias("s"), F.col("b").alias("eb"), "before", "part")
    rows = rows.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("eb")))
    run = Window.partitionBy("source", "b").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    # up to the nearest document: taken while its middle lies before the end of the part
    last = rows.filter(F.col("at") + F.col("size") / 2.0 <= F.col("part")).groupBy("source").agg(F.max("__order").alias("inner"))
    out = per.alias("p").join(edge.select(F.col("source").alias("s"), F.col("b").alias("edge")), F.col("p.source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.join(last.select(F.col("source").alias("s"), "inner"), F.col("p.source").eqNullSafe(F.col("s")), "left").drop("s")
    everything = F.when(F.col("part") > 0, F.lit("g")).otherwise(F.lit(""))  # no bucket holds the end: all or none
    out = out.withColumn("last", F.when(F.col("edge").isNull(), everything).otherwise(F.coalesce(F.col("inner"), F.col("edge"))))
    return written(out.select("source", "source_size", "target", "whole", "last"), "mix-plan")


def repetitions(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, ``copies`` and ``taken`` = copies * size.

    Nulls: a null source is a source of its own, the last; a null text has size 0; null ids share one
    place in the order with equal texts. Sources without words have target 0. Extra columns stay;
    columns named as the added ones are replaced. An empty table gives an empty result."""
    rows = sized(docs, seed)
    slim = written(rows.select("source", "size", "__order"), "mix-sizes")
    p = plan(slim).select(F.col("source").alias("__s"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "last")))
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("__s")))
    rows = rows.withColumn("copies", F.col("__whole") + (F.col("__order") <= F.col("__last")).cast("int"))
    rows = rows.withColumns({"source_size": F.col("__source_size"), "target": F.col("__target"), "taken": F.col("copies") * F.col("size")})
    return rows.drop("__s", "__source_size", "__target", "__whole", "__last", "__order")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    out = repetitions(docs, seed)
    return out.filter("copies > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text", "source")
    return repetitions(slim).select("doc_id", "size", "source_size", "target", "taken")
