"""Mixing against a loop over documents; the SQL counterpart on the driver's rows."""

import hashlib
import math

import pytest
from llm_rows import clashing, documents, empty, key, ordered, plan  # noqa: F401
from pyspark.sql import functions as F

from shelfline.llm import mixing


def plain(rows, epochs=3):
    docs = [(r[0], r[3], len((r[1] or "").encode().split())) for r in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in docs if x == s) for s in sources}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(size.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if epochs * size[s] <= share * weight[s] + 1e-9}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s], left = float(epochs * size[s]), left - epochs * size[s]
        free -= over
    out = []
    for s in sources:
        whole = int(target[s] // size[s]) if size[s] else 0
        rest = math.floor(target[s] - whole * size[s] + 0.5)
        digest = lambda d: hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()
        for doc_id, _, n in sorted((d for d in docs if d[1] == s), key=lambda d: (digest(d[0]), d[2])):
            part = max(0, min(n, rest))
            rest -= n
            out.append((doc_id, n, size[s], whole * n + part))
    return sorted(out, key=key), target, size


def test_messy_rows(documents, clashing, empty):
    want, target, size = plain([tuple(r) for r in documents.collect()])
    for df in (documents, clashing):
        found = mixing.mix_sources(df)
        assert ordered(found, "doc_id", "size", "source_size", "taken") == want
        assert "Python" not in plan(found) and "MapIn" not in plan(found)
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1000, 1000], [5, 5, 5, 5, 5, 5, 5], [0, 0], [1], [10**6, 1, 1, 1]])
def test_targets_share_everything_and_stop_at_the_cap(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    found = mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()
    assert math.isclose(sum(r.target for r in found), sum(sizes), abs_tol=1e-6)
    assert all(r.target <= 3 * r.source_size for r in found)


def test_texts_follow_the_mix(documents, clashing):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    want, _, _ = plain([tuple(r) for r in documents.collect()])
    words = out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("n"))
    taken = {}
    for doc_id, _, _, n in want:
        taken[doc_id] = taken.get(doc_id, 0) + n
    assert dict(map(tuple, words.collect())) == {k: v for k, v in taken.items() if v}


def test_groups_of_an_order_join_up(documents, monkeypatch):
    want = ordered(mixing.mix_sources(documents))
    monkeypatch.setattr(mixing, "GROUP_DOCS", 1)
    assert ordered(mixing.mix_sources(documents)) == want
