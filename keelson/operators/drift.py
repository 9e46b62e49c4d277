"""Distribution drift between a baseline and current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, quantiles_of, running_counts
from .store import stored

C = F.col


def edges(base: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the distinct percentiles of the baseline, in order."""
    q = quantiles(base, [], column, {f"e{i}": i / bins for i in range(bins + 1)})
    return q.select(F.array_sort(F.array_distinct(F.array(*(C(f"e{i}") for i in range(bins + 1))))).alias("e"))


def binned(df: DataFrame, e: DataFrame, column: str) -> DataFrame:
    """Adds ``bin`` (from 0, the last one closed); rows beyond the edges go."""
    rows = df.withColumn("__e", e.scalar())
    n = F.size(F.filter("__e", lambda x: x <= C(column)))
    rows = rows.filter((C(column) >= F.element_at("__e", 1)) & (C(column) <= F.element_at("__e", -1)))
    return rows.withColumn("bin", F.least(n, F.size("__e") - 1) - 1).drop("__e")


def psi(base: DataFrame, now: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(feature, psi, n_now); psi is null if there are no current values. Zero counts become 1e-6 before shares are formed."""
    e = edges(base, column, bins)
    every = e.select(F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("bin", "__low")).select("bin")
    counted = lambda df, n: binned(df, e, column).groupBy("bin").agg(F.count("*").alias(n))
    rows = every.join(counted(base, "a"), "bin", "left").join(counted(now, "b"), "bin", "left")
    full = lambda c: F.when(F.coalesce(C(c), F.lit(0)) == 0, 1e-6).otherwise(C(c).cast("double"))
    rows = rows.withColumns({"x": full("a"), "y": full("b")})
    whole = Window.partitionBy()
    rows = rows.withColumns({"x": C("x") / F.sum("x").over(whole), "y": C("y") / F.sum("y").over(whole)})
    out = rows.agg(F.abs(F.sum((C("y") - C("x")) * F.ln(C("y") / C("x")))).alias("psi"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_now"))
    return out.select(F.lit(column).alias("feature"), F.when(C("n_now") > 0, C("psi")).alias("psi"), "n_now")


def severity(p: Column) -> Column:
    return F.when(p >= 0.25, "Critical").when(p >= 0.10, "Warning").otherwise("Normal")


#: Fewest current values of a number that is judged.
LEAST = 30


def both_sides(base: DataFrame, now: DataFrame, numbers, kinds) -> DataFrame:
    """(feature, v, kind, a, b): how often each value of each feature occurs in the baseline and now, from one scan of each.

    A number is in v, a value of a kind in ``kind``. Everything else is read from this table, which is
    stored: it grows with the distinct values and not with the rows."""
    none = lambda t: F.lit(None).cast(t)
    values = F.array(*(F.struct(F.lit(c).alias("feature"), C(c).cast("double").alias("v"), none("string").alias("kind")) for c in numbers), *(F.struct(F.lit(c).alias("feature"), none("double").alias("v"), C(c).cast("string").alias("kind")) for c in kinds))
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.inline(values))
    rows = one(base, 0).unionByName(one(now, 1)).filter("v IS NOT NULL OR kind IS NOT NULL")
    return stored(rows.groupBy("feature", "v", "kind").agg(F.count_if(C("side") == 0).alias("a"), F.count_if(C("side") == 1).alias("b")), "values")


def moments(values: DataFrame) -> DataFrame:
    """(feature, base_mean, base_std, now_mean, now_std, n_base, n_now) of counted numbers; std: sample, then population."""
    n = lambda c: F.sum(c).cast("double")
    means = values.groupBy("feature").agg(*(F.try_divide(n(C("v") * C(c)), n(c)).alias(f"{s}_mean") for s, c in (("base", "a"), ("now", "b"))), F.sum("a").alias("n_base"), F.sum("b").alias("n_now"))
    gap = lambda s, c: F.sum(C(c) * (C("v") - C(f"{s}_mean")) * (C("v") - C(f"{s}_mean")))
    rows = values.join(F.broadcast(means), "feature")  # one row a feature
    rows = rows.groupBy("feature", "base_mean", "now_mean", "n_base", "n_now").agg(gap("base", "a").alias("x"), gap("now", "b").alias("y"))
    return rows.select("feature", "base_mean", F.when(C("n_base") > 1, F.sqrt(C("x") / (C("n_base") - 1))).alias("base_std"), "now_mean", F.when(C("n_now") > 0, F.sqrt(C("y") / C("n_now"))).alias("now_std"), "n_base", "n_now")


def counted_psi(values: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, psi) of counted numbers: each feature's own percentiles of the baseline are its edges."""
    parts = {f"e{i}": i / bins for i in range(bins + 1)}
    found = quantiles_of(running_counts(values.filter("a > 0").withColumnRenamed("a", "n"), ["feature"]), ["feature"], parts)
    e = F.broadcast(found.select("feature", F.array_sort(F.array_distinct(F.array(*parts))).alias("e")))  # one row a feature
    rows = values.join(e, "feature").filter((C("v") >= F.element_at("e", 1)) & (C("v") <= F.element_at("e", -1)))
    rows = rows.groupBy("feature", F.least(F.size(F.filter("e", lambda x: x <= C("v"))), F.size("e") - 1).alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = e.select("feature", F.explode(F.when(F.size("e") > 1, F.sequence(F.lit(1), F.size("e") - 1))).alias("bin")).join(rows, ["feature", "bin"], "left")
    full = lambda c: F.when(F.coalesce(C(c), F.lit(0)) == 0, 1e-6).otherwise(C(c).cast("double"))
    rows = rows.withColumns({"x": full("a"), "y": full("b")})
    one = Window.partitionBy("feature")  # as many rows as bins
    rows = rows.withColumns({"x": C("x") / F.sum("x").over(one), "y": C("y") / F.sum("y").over(one)})
    return rows.groupBy("feature").agg(F.abs(F.sum((C("y") - C("x")) * F.ln(C("y") / C("x")))).alias("psi"))


def shares(values: DataFrame) -> DataFrame:
    """(feature, kind, base_share, now_share, shift) of counted values of kinds; a side without values has shares of 0."""
    sums = F.broadcast(values.groupBy("feature").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")))  # one row a feature
    share = lambda c, s: F.when(C(s) > 0, C(c) / C(s)).otherwise(0.0)
    rows = values.join(sums, "feature").select("feature", "kind", share("a", "sa").alias("base_share"), share("b", "sb").alias("now_share"))
    return rows.withColumn("shift", F.abs(C("now_share") - C("base_share")))


def run(base: DataFrame, now: DataFrame, numbers, kinds, least: int = LEAST) -> DataFrame:
    """One row for each feature: (feature, psi, max_shift, severity, base_mean, base_std, now_mean, now_std, overall).

    Columns that either side doesn't have are left out, and numbers with fewer than ``least`` current values. overall:
    the worst severity of all features."""
    have = lambda cs: [c for c in cs if c in base.columns and c in now.columns]
    values = both_sides(base, now, have(numbers), have(kinds))
    v, k = values.filter("v IS NOT NULL").drop("kind"), values.filter("kind IS NOT NULL").drop("v")
    of_numbers = moments(v).filter(C("n_now") >= least).join(counted_psi(v), "feature").withColumn("max_shift", F.lit(None).cast("double"))
    of_kinds = shares(k).groupBy("feature").agg(F.max("shift").alias("max_shift"))
    rows = of_numbers.drop("n_base", "n_now").unionByName(of_kinds, allowMissingColumns=True)
    rows = rows.withColumn("severity", severity(F.coalesce("psi", "max_shift")))
    order = F.array(*map(F.lit, ("Normal", "Warning", "Critical")))
    worst = F.max(F.array_position(order, C("severity"))).over(Window.partitionBy())  # one row a feature
    return rows.withColumn("overall", F.element_at(order, worst.cast("int")))


def by_day(base: DataFrame, now: DataFrame, day: str, column: str, bins: int = 10) -> DataFrame:
    """(day, feature, psi, n_now) of each day against the baseline, in one pass over the days.

    A day keeps one count for each bin. A day without values within the edges has a null psi."""
    e = edges(base, column, bins)

    def counted(df: DataFrame, *by: str) -> DataFrame:
        rows = df.withColumn("__e", e.scalar())
        n = F.size(F.filter("__e", lambda x: x <= C(column)))
        inside = (C(column) >= F.element_at("__e", 1)) & (C(column) <= F.element_at("__e", -1))
        rows = rows.groupBy(*by, F.when(inside, F.least(n, F.size("__e") - 1)).alias("bin")).agg(F.count("*").alias("n"))
        return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(C("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))

    rows = counted(now, day).withColumns({"__base": counted(base).scalar(), "__bins": e.select(F.sequence(F.lit(1), F.size("e") - 1)).scalar()})
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    full = lambda m: F.transform("__bins", lambda i: F.coalesce(F.try_element_at(m, i).cast("double"), F.lit(1e-6)))
    rows = rows.withColumns({"x": full(C("__base")), "y": full(C("m"))}).withColumns({"sx": total(C("x")), "sy": total(C("y"))})
    gaps = F.zip_with("x", "y", lambda x, y: (y / C("sy") - x / C("sx")) * F.ln((y / C("sy")) / (x / C("sx"))))
    n = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(day, F.lit(column).alias("feature"), F.when(n > 0, F.abs(total(gaps))).alias("psi"), n.alias("n_now"))
