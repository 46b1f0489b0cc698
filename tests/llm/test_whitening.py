"""Whitening against an eigendecomposition of the plain covariance."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import whitening

DATA = "/root/testdata/sf0.01"


def integers(vectors):
    return [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]


def plain(x):
    """(deviations, components as columns, variances, share of the trace), in exact integers as far as possible."""
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x]
    deviations = [sum(v * v for v in row) for row in away]
    rows = np.array([[v / n for v in row] for row in away])
    values, vectors = np.linalg.eigh(rows.T @ rows / n)
    return deviations, rows, vectors[:, ::-1], values[::-1]


def check(got, ids, vectors, components=8, at_least=None):
    x = integers(vectors)
    deviations, rows, directions, values = plain(x)
    count = min(components, len(values)) if at_least is None else at_least
    table = {}
    for r in got:
        assert r.n == len(x) and r.identity_error <= 1e-9
        table.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(x) * count and sorted(table) == sorted(ids)
    for k in range(count):
        want = rows @ directions[:, k] / np.sqrt(values[k])
        mine = np.array([table[i][k + 1].whitened for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(table[ids[0]][k + 1].explained / (values[k] / values.sum()) - 1) < 1e-9
    assert [table[i][1].deviation for i in ids] == [min(d, whitening.MOST) for d in deviations]


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")
def test_driver_rows(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(whitening.whiten(vectors).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_odd_rows(spark):
    odd = [(100, None), (101, []), (102, [None, 1.0, 2.0]), (103, [float("nan"), 1.0, 2.0]), (104, [float("inf"), 1.0, 2.0]), (105, [1.0, 2.0])]
    rng = np.random.default_rng(4)
    fine = [(i, [float(c) for c in rng.normal(size=3) * (5, 1, 0.1)]) for i in range(40)]
    df = spark.createDataFrame(odd + fine, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "vector", "n", "component", "place", "value")})
    check(whitening.whiten(df).collect(), [i for i, _ in fine], [v for _, v in fine])
    assert whitening.whiten(df.limit(0)).count() == 0
    # Repeated rows count each time; NULL ids stay.
    twice = spark.createDataFrame([(None, v) for _, v in fine] * 2, "vec_id long, embedding array<double>")
    found = whitening.whiten(twice, components=2).collect()
    assert len(found) == 160 and {r.vec_id for r in found} == {None} and {r.n for r in found} == {80}
    # Equal rows have no component, dependent columns no more than they span.
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")).count() == 0
    flat = [(i, [v[0], v[0], 7.0, v[1]]) for i, v in fine]
    check(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), [i for i, _ in flat], [v for _, v in flat], at_least=2)


def test_ill_conditioned_and_large_entries(spark):
    """Columns of very different spread, where the Gram matrix alone has lost the small ones, and sums beyond 64 bits."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 4))
    wide = np.stack([base[:, 0] * 2e9, base[:, 0] * 2e9 + base[:, 1] * 3, base[:, 2] * 100, base[:, 3]], axis=1)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    own = {k: np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == k]) for k in range(1, 5)}
    table = np.stack(list(own.values()), axis=1)
    assert np.abs(table.T @ table / 300 - np.eye(4)).max() < 1e-4 and max(r.identity_error for r in got) < 1e-4
    huge = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 100 and {r.deviation for r in found} == {whitening.MOST}


def test_triangular_solve_and_deviations():
    rng = np.random.default_rng(0)
    factor = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(9, 6))
    assert np.allclose(whitening.solved(rows, factor) @ factor, rows)
    x = np.array([[1 << 52, -(1 << 52)], [5, 7]])
    sums = [sum(int(v) for v in c) for c in x.T]
    for n in (2, 3_000_000_019):
        centre = whitening.Centre(n, sums)
        want = [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x]
        assert [[int(v) for v in row] for row in centre.deviations(x)] == want
        assert centre.squares(x).tolist() == [min(sum(v * v for v in row), whitening.MOST) for row in want]
