"""Profiles of all columns from one table of counted values, and measures of whole matrices of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles_of, running_counts
from .store import stored

C = F.col


def numeric(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def value_table(df: DataFrame) -> DataFrame:
    """(name, value, v, n): how often each value of each column occurs; v is the number of a numeric column. One scan.

    Nulls are values, too. Partial counts leave one row a value and task, so a frequent value is no hot key."""
    numbers = set(numeric(df))
    one = lambda c: F.struct(F.lit(c).alias("name"), C(f"`{c}`").cast("string").alias("value"), (C(f"`{c}`").cast("double") if c in numbers else F.lit(None).cast("double")).alias("v"))
    return stored(df.select(F.inline(F.array(*map(one, df.columns)))).groupBy("name", "value", "v").agg(F.count("*").alias("n")), "values")


def _known(c: str) -> Column:
    return F.when(C("value").isNotNull(), C(c))


def describe(values: DataFrame) -> DataFrame:
    """(name, count, unique, top, freq, mean, std, min, q25, q50, q75, max) of every column of a value table.

    unique, top (the smallest of the most frequent values) and freq are of texts, the others but count of numbers."""
    top = F.min(F.when(C("value").isNotNull() & C("v").isNull(), F.struct((-C("n")).alias("n"), "value")))
    rows = values.groupBy("name").agg(
        F.coalesce(F.sum(_known("n")), F.lit(0)).alias("count"), F.count_if(C("v").isNull() & C("value").isNotNull()).alias("texts"), top.alias("top"), (F.sum(C("v") * C("n")) / F.sum(F.when(C("v").isNotNull(), C("n")))).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    numbers = values.filter("v IS NOT NULL")
    gaps = numbers.join(F.broadcast(rows.select("name", "mean")), "name").groupBy("name").agg(F.sum(C("n") * (C("v") - C("mean")) * (C("v") - C("mean"))).alias("gaps"))  # one row a column
    quarters = quantiles_of(running_counts(numbers, ["name"]), ["name"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rows = rows.join(gaps, "name", "left").join(quarters, "name", "left")
    return rows.select(
        "name", "count", F.when(C("texts") > 0, C("texts")).alias("unique"), C("top.value").alias("top"), (-C("top.n")).alias("freq"), "mean", F.when(C("count") > 1, F.sqrt(C("gaps") / (C("count") - 1))).alias("std"), "min", "q25", "q50", "q75", "max"
    )


def missing(values: DataFrame) -> DataFrame:
    """(name, missing, percent) of every column."""
    rows = values.groupBy("name").agg(F.coalesce(F.sum(F.when(C("value").isNull(), C("n"))), F.lit(0)).alias("missing"), F.sum("n").alias("n"))
    return rows.select("name", "missing", (C("missing") * 100.0 / C("n")).alias("percent"))


def shape(values: DataFrame) -> DataFrame:
    """(n_rows, n_columns, cells, missing, share): one row."""
    one = values.groupBy("name").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(C("value").isNull(), C("n"))), F.lit(0)).alias("m"))
    return one.agg(F.max("n").alias("n_rows"), F.count("*").alias("n_columns"), F.sum("n").alias("cells"), F.sum("m").alias("missing"), (F.sum("m") / F.sum("n")).alias("share"))


def repeats(df: DataFrame, key: str) -> DataFrame:
    """(duplicate_rows, duplicate_ids): rows after the first one of equal rows, and of equal keys.

    Rows are grouped by their values, of which a hash decides the place; a null equals a null."""
    once = df.groupBy(*(f"`{c}`" for c in df.columns)).agg(F.count("*").alias("__n"))
    return once.groupBy(key).agg(F.sum("__n").alias("ids"), F.sum(C("__n") - 1).alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(C("ids") - 1), F.lit(0)).alias("duplicate_ids"))


def correlations(df: DataFrame, columns) -> DataFrame:
    """(a, b, r) for all pairs of columns, from one aggregation of the centred Gram matrix; rows with a null take no part."""
    rows = df.select(*(C(c).cast("double").alias(c) for c in columns)).dropna()
    return rows.agg(*(F.corr(a, b).alias(f"{a}\t{b}") for a, b in combinations(columns, 2))).select(
        F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else C(f"`{min(a, b, key=columns.index)}\t{max(a, b, key=columns.index)}`")).alias("r")) for a in columns for b in columns)))
    )


def rank_correlations(df: DataFrame, columns) -> DataFrame:
    """The same of average ranks: values of all columns are counted and ranked together, then joined to each column."""
    columns = tuple(columns)
    rows = df.select(*(C(c).cast("double").alias(c) for c in columns)).dropna()
    values = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), C(c).alias("v")) for c in columns)))).groupBy("name", "v").agg(F.count("*").alias("n"))
    ranks = running_counts(stored(values, "counts"), ["name"])
    ranks = stored(ranks.select("name", "v", (C("before") + (C("n") + 1) / 2.0).alias("r")), "ranks")
    for c in columns:
        one = ranks.filter(C("name") == c).select(C("v").alias(c), C("r").alias(f"__{c}"))
        rows = rows.join(one, c)
    return correlations(rows.select(*(C(f"__{c}").alias(c) for c in columns)), columns)


def cramers(df: DataFrame, columns) -> DataFrame:
    """(a, b, v): Cramer's V of all pairs of columns, from one count of the pairs' values; 0 if one has a single value.

    Pairs of values are counted in one pass over all pairs of columns; the chi-squared sum needs only those that
    occur: sum of n^2 / (row * column), less 1, times the total. Yates' correction on 2 x 2 is made over all four cells."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(a).cast("string").alias("x"), C(b).cast("string").alias("y")) for a, b in combinations(columns, 2)))
    cells = df.select(F.inline(pairs)).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("n"))
    of = lambda *by: Window.partitionBy("a", "b", *by)  # noqa: E731  (one row a pair of values)
    cells = cells.withColumns({"p": F.sum("n").over(of("x")), "q": F.sum("n").over(of("y")), "t": F.sum("n").over(of())})
    whole = cells.groupBy("a", "b", "t").agg((F.sum(C("n") * C("n") / (C("p") * C("q"))) - 1).alias("phi"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"), F.min(F.struct("n", "p", "q")).alias("one"))
    # all four cells of a 2 x 2 table are off by the same number
    off = F.abs(C("one.n") - C("one.p") * C("one.q") / C("t"))
    expected = C("one.p") * C("one.q") * (C("t") - C("one.p")) * (C("t") - C("one.q"))
    yates = F.pow(off - F.least(F.lit(0.5), off), 2) * F.pow("t", 3) / expected
    chi2 = F.when((C("r") == 2) & (C("c") == 2), yates).otherwise(C("t") * C("phi"))
    least = F.least("r", "c") - 1
    both = whole.select("a", "b", F.when(least < 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), chi2) / (C("t") * least))).alias("v"))
    return both.unionByName(both.select(C("b").alias("a"), C("a").alias("b"), "v"))


def density(df: DataFrame, column: str, label: str, points: int = 100, cut: float = 3.0) -> DataFrame:
    """(label, point, x, density): a Gaussian kernel density of each label, normed to itself, on a grid of ``points``.

    Scott's bandwidth: the sample deviation times n^(-1/5). The grid reaches ``cut`` bandwidths beyond the values. Rows are
    dealt to the two grid points beside them, by their distance; then only grid points meet, so
    the work after one scan is ``points`` squared a label. Labels with one value or no spread have no density."""
    rows = df.select(C(label).alias("label"), C(column).cast("double").alias("v")).dropna()
    m = rows.groupBy("label").agg(F.count("*").alias("n"), (F.stddev_samp("v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"), F.min("v").alias("low"), F.max("v").alias("high")).filter("h > 0")
    m = m.select("label", "n", "h", (C("low") - cut * C("h")).alias("start"), ((C("high") - C("low") + 2 * cut * C("h")) / (points - 1)).alias("step"))
    place = (C("v") - C("start")) / C("step")
    left = F.floor(place)
    dealt = rows.join(F.broadcast(m), "label").select("label", F.inline(F.array(F.struct(left.alias("i"), (1 - (place - left)).alias("w")), F.struct((left + 1).alias("i"), (place - left).alias("w")))))  # m: one row a label
    dealt = dealt.groupBy("label", "i").agg(F.sum("w").alias("w")).groupBy("label").agg(F.collect_list(F.struct("i", "w")).alias("grid"))  # at most ``points`` each
    out = dealt.join(m, "label").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = lambda g: (C("point") - g["i"]) * C("step") / C("h")
    total = F.aggregate(F.array_sort("grid"), F.lit(0.0), lambda s, g: s + g["w"] * F.exp(-z(g) * z(g) / 2))
    return out.select(C("label").alias(label), "point", (C("start") + C("point") * C("step")).alias("x"), (total / (C("n") * C("h") * 2.5066282746310002)).alias("density"))
