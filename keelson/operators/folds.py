"""Logistic regression of all folds and settings at once, by sums that one pass an iteration makes."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import SEED, inputs, prepared, spread, typed, weighted
from .ranks import running_counts
from .store import stored

C = F.col


def folded(df: DataFrame, folds: int, key: str = "customer_id", label: str = "churn") -> DataFrame:
    """(x, y, w, fold) of every row, stored: its features, label, class weight, and a fold by a hash of its key."""
    raw = spread(inputs(df, key, label))
    rows = weighted(typed(raw), label)
    rows = Pipeline(stages=prepared()).fit(rows).transform(rows)
    fold = F.pmod(F.xxhash64(F.lit(SEED), F.lit("fold"), key), F.lit(folds)).cast("int")
    out = stored(rows.select(vector_to_array("features").alias("x"), C(label).cast("double").alias("y"), C("weight").alias("w"), fold.alias("fold")), "folds")
    raw.unpersist()
    return out


def summed(rows: DataFrame, product) -> np.ndarray:
    """The sum over all rows of ``product(x, y, w, fold)``, an array; a task sends one array, Spark adds them up."""

    def part(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = product(x, *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    found = rows.mapInArrow(part, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for slot, value in found:
        out[slot] = value
    return out


def spreads(rows: DataFrame, folds: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weights, deviations of each feature) of the rows to fit of each fold: the total less the fold's own sums."""

    def product(x, y, w, fold):
        mine = np.eye(folds)[fold] * w[:, None]
        return np.concatenate([mine.sum(0), (mine * w[:, None]).sum(0), (mine.T @ x).ravel(), (mine.T @ (x * x)).ravel()])

    s = summed(rows, product)
    w, w2, x, x2 = s[:folds], s[folds : 2 * folds], s[2 * folds : 2 * folds + folds * d].reshape(folds, d), s[2 * folds + folds * d :].reshape(folds, d)
    w, w2, x, x2 = (a.sum(0) - a for a in (w, w2, x, x2))
    return w, np.sqrt(np.maximum(0, (x2 - x * x / w[:, None]) / (w - w2 / w)[:, None]))


def fitted(rows: DataFrame, folds: int, settings: list[float], steps: int = 25, near: float = 1e-10) -> np.ndarray:
    """(folds, settings, d + 1) coefficients, the intercept last, each fitted on the rows of all other folds.

    Newton steps on the weighted mean of the logistic loss, and setting / 2 times the squared coefficients of
    standardised features. One pass an iteration sums gradient and Hessian of all folds and settings; the driver gets
    those sums alone. Features without spread have a coefficient of 0."""
    d = rows.select(F.size("x")).first()[0]
    weights, spread = spreads(rows, folds, d)
    m = folds * len(settings)
    beta = np.zeros((folds, len(settings), d + 1))
    triangle = np.tril_indices(d + 1)
    for _ in range(steps):

        def product(x, y, w, fold, beta=beta):
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            out = []
            for f in range(folds):
                some = fold != f
                xf, yf, wf = x[some], y[some], w[some]
                for b in beta[f]:
                    p = 1 / (1 + np.exp(-(xf @ b)))
                    out += [xf.T @ (wf * (p - yf)), (xf.T @ (xf * (wf * p * (1 - p))[:, None]))[triangle]]
            return np.concatenate(out)

        sums = summed(rows, product).reshape(m, -1)
        most = 0.0
        new = beta.copy()
        for i, s in enumerate(sums):
            f, k = divmod(i, len(settings))
            penalty = np.append(settings[k] * spread[f] ** 2, 0.0)
            gradient = s[: d + 1] / weights[f] + penalty * beta[f, k]
            hessian = np.zeros((d + 1, d + 1))
            hessian[triangle] = s[d + 1 :] / weights[f]
            hessian = hessian + np.tril(hessian, -1).T + np.diag(penalty)
            live = np.append(spread[f] > 0, True)
            step = np.linalg.solve(hessian[np.ix_(live, live)], gradient[live])
            new[f, k, live] -= step
            most = max(most, np.abs(step).max())
        beta = new
        if most < near:
            break
    return beta


def scored(rows: DataFrame, beta: np.ndarray) -> DataFrame:
    """(setting, fold, y, p) of every row under the model that wasn't fitted on its fold, for each setting."""
    settings = beta.shape[1]

    def part(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            fold = b.column(3).to_numpy(zero_copy_only=False)
            own = beta[fold]
            p = 1 / (1 + np.exp(-(np.einsum("nd,nsd->ns", x, own[:, :, :-1]) + own[:, :, -1])))
            again = np.repeat(np.arange(b.num_rows), settings)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(settings, dtype=np.int32), b.num_rows)), b.column(3).take(pa.array(again)), b.column(1).take(pa.array(again)), pa.array(p.ravel())], names=["setting", "fold", "y", "p"])

    return rows.mapInArrow(part, "setting int, fold int, y double, p double")


def judged(scores: DataFrame) -> DataFrame:
    """(setting, fold, accuracy, f1, auc): the area by average ranks of the counted scores."""
    counts = stored(scores.groupBy("setting", "fold", C("p").alias("v")).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "scores")
    keys = ["setting", "fold"]
    ranked = running_counts(counts, keys).join(counts.select(*keys, "v", "pos"), [*keys, "v"])
    yes = C("v") >= 0.5
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    rows = ranked.groupBy(*keys).agg(
        n("n").alias("n"), n("pos").alias("p"), n(F.when(yes, C("pos"))).alias("tp"), n(F.when(yes, C("n") - C("pos"))).alias("fp"), n(C("pos") * (C("before") + (C("n") + 1) / 2.0)).alias("ranks")
    )
    fn = C("p") - C("tp")
    auc = F.try_divide(C("ranks") - C("p") * (C("p") + 1) / 2, C("p") * (C("n") - C("p")))
    return rows.select(*keys, ((C("n") - C("fp") - fn) / C("n")).alias("accuracy"), F.coalesce(F.try_divide(2 * C("tp"), 2 * C("tp") + C("fp") + fn), F.lit(0.0)).alias("f1"), auc.alias("auc"))


def cross_validated(df: DataFrame, settings: list[float], folds: int = 5) -> DataFrame:
    """(setting, mean_accuracy, std_accuracy, mean_f1, mean_auc, best) of the logistic model over the folds.

    std: population, as of the folds at hand; best: the setting of the highest area, the first on ties."""
    rows = folded(df, folds)
    out = judged(scored(rows, fitted(rows, folds, settings))).groupBy("setting").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.avg("f1").alias("mean_f1"), F.avg("auc").alias("mean_auc"))
    values = F.array(*(F.lit(float(s)) for s in settings))
    best = F.row_number().over(Window.orderBy(F.desc("mean_auc"), "setting")) == 1  # one row a setting
    return out.withColumn("best", best).withColumn("setting", F.element_at(values, C("setting") + 1))


def draws(n: int, seed: int = SEED) -> list[float]:
    """Seeded draws of the setting between 1e-4 and 1, even in its logarithm."""
    return (10 ** np.random.default_rng(seed).uniform(-4, 0, n)).tolist()


register_pickle_by_value(sys.modules[__name__])
