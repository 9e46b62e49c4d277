"""Profiles, associations, outliers and strategy tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import rnd
from .ranks import quantiles

C = F.col


def long(df: DataFrame, columns, kind: str, *keep: str) -> DataFrame:
    """(name, v, *keep): one row for each row and column."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(c).alias("name"), C(c).cast(kind).alias("v")) for c in columns))))


def modes(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-C("n")).alias("n"), C(column))).alias("x")).select(key, C("x")[column].alias(column))


def top_values(df: DataFrame, columns, k: int) -> DataFrame:
    counts = long(df, columns, "string").groupBy("name", "v").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "v"))).filter(C("r") <= k)


def quintiles(df: DataFrame, column: str, out: str = "q") -> DataFrame:
    """Adds the quintile (1 to 5, right-closed) of a column by exact quantiles.

    If edges collapse, bins of equal width take their place; the lowest edge is widened by a thousandth."""
    edges = quantiles(df, [], column, {f"e{i}": i / 5 for i in range(6)})
    e = edges.select(F.array(*(C(f"e{i}") for i in range(6))).alias("e"))
    e = e.select(F.when(F.size(F.array_distinct("e")) == 6, F.slice("e", 2, 4)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: C("e")[0] + (C("e")[5] - C("e")[0]) / 5 * i)).alias("e"))
    inner = e.scalar()
    rows = df.withColumn("__e", inner)
    return rows.withColumn(out, (F.size(F.filter("__e", lambda x: C(column) > x)) + 1).cast("int")).drop("__e")


def outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    q = quantiles(df, [], column, {"a": 0.25, "b": 0.75})
    low, high = q.select(C("a") - factor * (C("b") - C("a"))), q.select(C("b") + factor * (C("b") - C("a")))
    return df.filter((C(column) < low.scalar()) | (C(column) > high.scalar()))


def far(df: DataFrame, column: str, z: float) -> DataFrame:
    x = C(column).cast("double")
    m, s = df.agg(F.avg(x)), df.agg(F.stddev_pop(x))
    return df.filter(F.abs((x - m.scalar()) / s.scalar()) > z)


def chi2(df: DataFrame, columns, label: str) -> DataFrame:
    """(name, total, least, dof, chi2) of each column against the label; Yates' correction on 2 x 2.

    Pairs of values are counted first, so what is shuffled doesn't grow with the rows."""
    counts = long(df, columns, "string", label).filter("v is not null").groupBy("name", "v", label).agg(F.count("*").alias("n"))
    rows = counts.groupBy("name", "v").agg(F.sum("n").alias("a"))
    cols = counts.groupBy("name", label).agg(F.sum("n").alias("b"))
    cells = rows.join(cols, "name").join(counts, ["name", "v", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = rows.groupBy("name").agg(F.sum("a").alias("total"), F.count("*").alias("r")).join(cols.groupBy("name").agg(F.count("*").alias("c")), "name")
    cells = cells.join(totals, "name").withColumn("e", C("a") * C("b") / C("total").cast("double"))
    gap = F.abs(C("n") - C("e"))
    gap = F.when((C("r") == 2) & (C("c") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return cells.groupBy("name", "total", F.least(C("r") - 1, C("c") - 1).alias("least"), ((C("r") - 1) * (C("c") - 1)).alias("dof")).agg(F.sum(gap * gap / C("e")).alias("chi2"))


def chi2_tail(x, dof):
    """The p-value of a chi-squared statistic: 1 less the series of the incomplete gamma function.

    Far in the tail (below 1e-40) it is 0."""
    a, h = dof / 2.0, x / 2.0
    odd = dof % 2 == 1
    log_gamma = F.aggregate(F.when(dof > 1, F.sequence(F.lit(1), F.floor(a).cast("int"))).otherwise(F.array().cast("array<int>")), F.when(odd, math.log(math.pi) / 2 - math.log(2)).otherwise(0.0), lambda g, i: g + F.ln(i + F.when(odd, 0.5).otherwise(0.0)))
    first = F.exp(a * F.ln(h) - h - log_gamma)
    start = F.struct(first.alias("term"), first.alias("total"))
    step = lambda s, n: F.struct((s["term"] * h / (a + n)).alias("term"), (s["total"] + s["term"] * h / (a + n)).alias("total"))
    below = F.aggregate(F.sequence(F.lit(1), F.lit(2000)), start, step, lambda s: s["total"])
    return F.when(h <= 0, 1.0).when(h > 300 + a + 40 * F.sqrt(a), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - below))


def mutual_information(df: DataFrame, columns, label: str) -> DataFrame:
    counts = long(df, columns, "string", label).groupBy("name", "v", label).agg(F.count("*").alias("n"))
    of = lambda *by: F.sum("n").over(Window.partitionBy(*by)).cast("double")
    rows = counts.withColumns({"a": of("name", "v"), "b": of("name", label), "s": of("name")})
    return rows.groupBy("name").agg(F.sum(C("n") / C("s") * F.ln(C("n") * C("s") / (C("a") * C("b")))).alias("mi"))


def strategies(sub: DataFrame) -> DataFrame:
    """(customer_id, strategy, cost, retention, net, place): the strategies of each subscriber, best net value first."""
    table = F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(s).alias("share"), F.lit(c).alias("fixed"), F.lit(r).alias("cut")) for n, s, c, r in rules.STRATEGIES))
    rows = sub.select("customer_id", "churn_probability", (C("monthly_charges") * 12.0).alias("annual"), F.inline(table))
    keep = 1.0 - C("churn_probability") + C("cut")
    rows = rows.withColumns({"cost": rnd(C("annual") * C("share") + C("fixed"), 2), "retention": rnd(F.when(C("cut") > 0, F.least(F.lit(rules.RETENTION_CAP), keep)).otherwise(keep), 3)})
    rows = rows.withColumn("net", rnd(rnd(C("retention") * C("annual"), 2) - C("cost"), 2))
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("net"), "strategy"))
    return rows.withColumn("place", place).select("customer_id", "strategy", "cost", "retention", "net", "place")
