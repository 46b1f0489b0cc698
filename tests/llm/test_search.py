"""Exact and approximate search against all distances."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import ann, topk

DATA = "/root/testdata/sf0.01"
ODD = [
    (100, [0.5, 1.0]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, [float("inf"), 1.0]),
    (0, [0.0, 1.0]), (None, [0.0, 1.0]), (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, []),
    *[(i, [float(i % 4), 1.0]) for i in range(1, 40)], (5, [1.0, 1.0]),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("x") for c in ("id", "vector", "rank", "query_id", "score", "part", "bucket")})


def brute(rows, better, k=10):
    """better(query, candidate) sorts ascending."""
    out = {}
    asked = {}
    for i, v in rows:
        if i is not None and i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        found = [(better(v, w), i) for i, w in rows if i is not None and i != q and len(w) == len(v)]
        out[q] = sorted(found)[:k]
    return out


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def test_exact_on_odd_rows(odd):
    rows = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in usable(ODD)]
    want = brute(rows, lambda a, b: -sum(x * y for x, y in zip(a, b, strict=True)))
    got = topk.top_k(odd, F.col("id") % 100 == 0).collect()
    for q, found in want.items():
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == found
    assert {r.query_id for r in got} == {q for q, found in want.items() if found}
    assert topk.top_k(odd.limit(0), F.col("id") % 100 == 0).count() == 0


def test_large_integers_stay_exact():
    big = np.array([[2.0**40, 3.0], [2.0**62, 2.0**62]])
    assert topk.products(big[:1], big[:1]).tolist() == [[min((1 << 80) + 9, topk.MOST)]]
    small = np.array([[float((1 << 26) + 1)] * 4])
    assert topk.products(small, small).tolist() == [[4 * ((1 << 26) + 1) ** 2]]


def test_tree_merge(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN", 2)
    rows = [(q, v, (v * 37 + q) % 50, v % 9) for q in range(3) for v in range(60)]
    lists = spark.createDataFrame(rows, "query_id long, vec_id long, score long, part long")
    got = topk.merged(lists, 4, [F.col("score").desc(), F.col("vec_id")], 9).collect()
    for q in range(3):
        want = sorted((-s, v) for x, v, s, _ in rows if x == q)[:4]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_neighbours_on_odd_rows(odd):
    """So few rows that every query falls back to all of them."""
    rows = [(i, v) for i, v in usable(ODD) if any(v)]
    want = brute(rows, lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())))
    got = ann.neighbours(odd, F.col("id") % 100 == 0).collect()
    for q, found in want.items():
        unique = {}
        for d, i in found:
            unique.setdefault(i, d)
        mine = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert mine[: len(unique)] == [(d, i) for i, d in unique.items()][: len(mine)]
        assert len(mine) >= len(unique)
    assert ann.neighbours(odd.limit(0), F.col("id") % 100 == 0).count() == 0


def test_equally_far_neighbours_and_ids_with_many_vectors(spark):
    """Far more ties than places, and ids whose own vectors fill all places; outliers put the rest into one bucket."""
    hot = [[float(x == y) for y in range(90)] for x in range(90)]
    rows = [((i * 37) % 90 + 300, v) for i, v in enumerate(hot)]
    rows += [(7, [2.0 + i / 64, *v[1:]]) for i, v in enumerate(hot[:40])] + [(500, [1.0, *v[1:]]) for v in hot[40:60]]
    rows += [(8, [1e7] * 90), (9, [-1e7] * 90)]
    want = brute(rows, lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), 10_000)
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), F.col("id") % 100 == 0).collect()
    assert set(want) == {300, 500}
    for q, found in want.items():
        unique = {}
        for d, i in found:
            unique.setdefault(i, d)
        best = sorted((d, i) for i, d in unique.items())[:10]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == best


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")
def test_recall(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = ann.neighbours(df, F.col("id") % 20 == 0).collect()
    hits, asked = 0, ids[ids % 20 == 0]
    for q in asked:
        distance = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, distance))[:10]])
        mine = [r for r in got if r.query_id == q]
        assert sorted(r.rank for r in mine) == list(range(1, 11))
        assert all(np.isclose(r.score, distance[ids == r.vec_id][0], rtol=1e-14) for r in mine)
        hits += len(best & {r.vec_id for r in mine})
    assert hits >= 0.95 * 10 * len(asked)


def test_probes_come_in_order_of_cost():
    places = np.random.default_rng(2).uniform(-4, 4, (5, ann.HASHES))
    visited, own = ann.probes(places), np.floor(places)
    assert (visited[:, 0] == own).all()
    moved = visited - own[:, None]
    below = (places - own)[:, None]
    cost = np.where(moved == -1, below, np.where(moved == 1, 1 - below, 0)) ** 2
    assert (np.diff(cost.sum(axis=2), axis=1) >= -1e-12).all()
    assert all(len({tuple(v) for v in row}) == ann.PROBES for row in visited)
