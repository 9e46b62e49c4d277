"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
SEED = 13
#: Entries of this size or more can't be told apart from their neighbours as scaled whole numbers.
LARGEST = 2.0**40
#: Rows that are multiplied at once.
ROWS = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with x = floor(64 * c) + 1000000 of every entry c, written to the shared folder.

    Left out: vectors that are null, empty or hold a null, NaN or infinite entry, or one of 2^40 or more in size;
    and of vectors of several lengths those that haven't the commonest one (ties: the longest)."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", odd))
    rows = written(rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"), F.size("c").alias("d")), "quantised")
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.col("d") == (common["d"] if common else 0)).drop("d")


def matrix(column, d):
    """The rows of a column of lists of ``d`` numbers, ``ROWS`` at a time."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for a in range(0, len(x), ROWS):
        yield x[a : a + ROWS]


def summed(rows: DataFrame, d: int, product, kind: str = "double"):
    """The sum over all rows of ``product(x)``, an array of numbers; ``x``: some rows, an (m, d) matrix.

    A task adds up its rows and sends one array; Spark adds the arrays of all tasks place by place."""

    def part(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for x in matrix(batch.column(0), d):
                p = product(x)
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    found = rows.select("x").mapInArrow(part, f"slot int, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = [0] * len(found)
    for slot, value in found:
        out[slot] = value
    return out


def moments(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension; halves of 32 bits are added apart, so that no sum overflows."""

    def product(x):
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    found = summed(rows, d, product, "long")
    return (found[0], [(a << 32) + b for a, b in zip(found[1 : d + 1], found[d + 1 :])]) if found else (0, [0] * d)


def centring(n: int, sums: list[int]):
    """x -> x - S / n, with the whole part of the mean taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def bidiagonalised(rows: DataFrame, d: int, n: int, sums: list[int], wanted: int = COMPONENTS, seed: int = SEED):
    """(components (d, k), singular values (k,), squared norm) of the centred rows X, largest values first.

    Step j multiplies X by the right vector v_j, takes off beta * u_(j-1) and all earlier left vectors, and
    multiplies the transpose of X by what is left, u_j; the driver takes all earlier right vectors off that, twice,
    and the rest is v_(j+1). A left vector has a number for each row, so it is never stored: u = X w, and the small
    w is kept, by which every task makes its part of all left vectors anew from its rows. Both products and
    the products with earlier left vectors come from one pass over the rows. The small bidiagonal matrix U'XV is
    decomposed on the driver.

    It goes on until the residual of the wanted triplets is lost in rounding, d steps at most. If a product
    vanishes (equal values, rank below d), it starts again from a new vector orthogonal to all earlier ones."""
    centred, rng, eps = centring(n, sums), np.random.default_rng(seed), np.finfo(float).eps
    right, left, images, entries = [], [], [], {}  # v_j; w_i; X'u_i; {(i, j): u_i'Xv_j}
    norm, beta, values = None, 0.0, None

    def apart(z):
        for _ in range(2):
            for v in right:
                z = z - v * (v @ z)
        return z

    def fresh():
        z = apart(rng.standard_normal(d))
        return z / np.linalg.norm(z)

    v = fresh()
    while True:
        right.append(v)
        w = v - beta * left[-1] if beta else v
        before = np.stack(left, 1) if left else np.zeros((d, 0))

        def product(x, w=w, before=before, first=norm is None):
            x = centred(x)
            u = x @ w
            return np.concatenate([x.T @ u, (x @ before).T @ u, [u @ u, np.einsum("ij,ij->", x, x) if first else 0.0]])

        found = np.array(summed(rows, d, product))
        z, c, square = found[:d], found[d:-2], found[-2]
        norm = float(found[-1]) if norm is None else norm
        if beta:
            entries[len(left) - 1, len(right) - 1] = beta
        tiny = d * eps * norm**0.5
        alpha = max(square - c @ c, 0.0) ** 0.5
        beta, after = 0.0, None
        if alpha > tiny:
            entries[len(left), len(right) - 1] = alpha
            left.append((w - before @ c) / alpha)
            image = (z - np.stack(images, 1) @ c if images else z) / alpha
            images.append(image)
            after = apart(image)
            beta = float(np.linalg.norm(after))
            beta = beta if beta > tiny else 0.0
        small = np.zeros((len(left), len(right)))
        for place, value in entries.items():
            small[place] = value
        if len(left):
            q, values, p = np.linalg.svd(small, full_matrices=False)
        done = len(right) == d or not left and not norm
        if len(left) > wanted and beta:  # the residual of triplet i is beta times the last entry of its left vector
            done = done or bool((beta * np.abs(q[-1, :wanted]) <= eps * values[0]).all())
        if done:
            break
        v = after / beta if beta else fresh()
    if values is None:
        return np.zeros((d, 0)), np.zeros(0), norm
    return np.stack(right, 1) @ p[:wanted].T, values[:wanted], norm


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and leading component.

    Rows that ``quantised`` leaves out take no part; a null id stays null, repeated rows count as often as they
    occur, other columns are ignored. Components without variance to double precision have no whitened
    value and are left out, so equal vectors and the empty table give no rows. ``deviation`` is null where it exceeds a
    long."""
    rows = quantised(vectors)
    first = rows.select(F.size("x").alias("d")).first()
    fields = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], fields)
    d = first["d"]
    n, sums = moments(rows, d)
    axes, values, norm = bidiagonalised(rows, d, n, sums, min(components, d))
    some = values**2 > d * np.finfo(float).eps * (values[0] ** 2 if len(values) else 0)
    axes, values = axes[:, some], values[some]
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], fields)
    centred, onto = centring(n, sums), axes / (values / n**0.5)
    mean = np.array(summed(rows, d, lambda x: (centred(x) @ onto).sum(0))) / n

    def squares(x):
        y = centred(x) @ onto - mean
        return (y.T @ y).ravel()

    error = float(np.abs(np.array(summed(rows, d, squares)).reshape(k, k) / n - np.eye(k)).max())
    explained = values**2 / norm
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def deviations(x):
        """Sums of (n * x - S)^2, exact; None beyond a long. Whole numbers of 64 bits are exact up to multiples of 2^64."""
        y = x - whole
        about = ((n * y.astype(float) - rest) ** 2).sum(1)
        y = n * y - rest
        out = (y * y).sum(1).tolist()
        for i in np.flatnonzero(about > 2.0**63 * (1 - 1e-6)).tolist():
            v = sum((n * a - b) ** 2 for a, b in zip((x[i] - whole).tolist(), rest.tolist()))
            out[i] = v if v < 2**63 else None
        return out

    def projected(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for x in matrix(batch.column(1), d):
                m, y = len(x), centred(x) @ onto
                ids = batch.column(0).slice(at, m)
                at += m
                again = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(again)),
                     pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(projected, fields)


def whitened_embeddings(vectors: DataFrame) -> DataFrame:
    return whitened(vectors)


ship(__name__)
