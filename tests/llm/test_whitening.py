"""Whitening against numpy's eigenvectors of the covariance, and on odd vectors."""

import numpy as np
import pytest

from keelson.llm import whitening

SF = "/root/testdata/sf0.001"


def check(out, rows, most=32, near=1e-9):
    """``rows``: (vec_id, vector) of all that take part, ids distinct."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + whitening.OFFSET
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(most, int((e > x.shape[1] * np.finfo(float).eps * e[0]).sum()))
    assert len(out) == n * k
    got = {(r.vec_id, r.component): r for r in out}
    y = np.array([[got[i, c + 1].whitened for c in range(k)] for i, _ in rows])
    want = centred @ axes[:, :k] / np.sqrt(e[:k])
    assert np.abs(y * np.sign((y * want).sum(0)) - want).max() < near
    explained = np.array([got[rows[0][0], c + 1].explained for c in range(k)])
    assert np.abs(explained / (e[:k] / e.sum()) - 1).max() < 1e-9
    deviation = dict(zip((i for i, _ in rows), ((n * x - sums) ** 2).sum(1).tolist()))
    assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in out)
    error = np.abs(y.T @ y / n - np.eye(k)).max()
    assert {r.identity_error for r in out} == {out[0].identity_error} and abs(out[0].identity_error - error) < 1e-12 and error < 1e-9


def test_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(whitening.whitened_embeddings(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()], near=1e-7)


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.standard_normal(5) * (8, 4, 2, 1, 0.5)]) for i in range(80)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, "x", 3, None) for i, v in good + bad], "vec_id long, embedding array<float>, x string, slot int, value double")
    check(whitening.whitened_embeddings(df).collect(), [(i, np.float32(v).tolist()) for i, v in good])
    assert whitening.whitened_embeddings(df.limit(0)).collect() == []
    assert whitening.whitened_embeddings(df.filter("vec_id >= 100 and vec_id < 105")).collect() == []
    assert whitening.whitened_embeddings(df.filter("vec_id = 3")).collect() == []  # one vector has no variance


def test_ranks_below_the_dimension_and_equal_values(spark):
    rows = [(i, [float(i % 7), float(i % 7), 0.5, float(i % 7) * 2]) for i in range(49)]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 49 and abs(out[0].explained - 1) < 1e-12 and out[0].identity_error < 1e-9
    corners = [(i, [float(2 * (i >> k & 1) - 1) for k in range(4)]) for i in range(16)]  # all values equal
    out = whitening.whitened(spark.createDataFrame(corners, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 64 and out[0].identity_error < 1e-9 and all(abs(r.explained - 0.25) < 1e-12 for r in out)


def test_repeated_rows_and_absent_ids(spark):
    rows = [(None if i % 3 else i, [float(i % 5), float(i * i % 11)]) for i in range(40)] * 2
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert len(out) == 80 and sum(r.vec_id is None for r in out) == 2 * sum(i % 3 > 0 for i in range(40)) and {r.n for r in out} == {80}


@pytest.mark.parametrize("scale", [1.0, 2.0**33])
def test_deviations_are_exact_or_null(spark, scale):
    rows = [(i, [scale * (i % 13 + 1 / 64), scale * (i % 3)]) for i in range(60)]
    x = [[int(64 * v) + whitening.OFFSET for v in vector] for _, vector in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((60 * a - s) ** 2 for a, s in zip(line, sums)) for (i, _), line in zip(rows, x)}
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert {r.vec_id: r.deviation for r in out} == {i: v if v < 2**63 else None for i, v in want.items()}


def test_steps_end_when_the_wanted_triplets_have_converged(spark):
    """A steep spectrum: fewer steps than dimensions, the same leading triplets."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 40)) @ np.diag(4.0 ** -np.arange(40) * 4000)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    rows = whitening.quantised(df)
    n, sums = whitening.moments(rows, 40)
    axes, values, norm = whitening.bidiagonalised(rows, 40, n, sums, wanted=3)
    x = np.floor(64 * v)
    want = np.linalg.svd(x - x.mean(0))
    assert np.abs(values / want[1][:3] - 1).max() < 1e-12 and abs(norm / (want[1] ** 2).sum() - 1) < 1e-12
    assert np.abs(np.abs((axes * want[2][:3].T).sum(0)) - 1).max() < 1e-9
