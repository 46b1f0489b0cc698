"""Ranked search against a plain program, on odd rows and on the driver's tables."""

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from llm_rows import clashing, documents, empty  # noqa: F401
from pyspark.sql import functions as F

from shelfline.llm import ranked

DATA = "/root/testdata/sf0.01"
ITEMS = [
    (1, "same same ünd WÖRTER"), (2, "One two three"), (3, None), (4, ""), (None, "one"), (5, "qqqq-xxxxxx 0x0x"), (6, "zzzz"),
    (6, "two"), (7, "another text under a used number"),
]


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out, asked = {}, {}
    for i, t in items:
        if i is not None:
            asked[i] = min([x for x in (asked.get(i), t) if x is not None], default=None)
    for i, t in asked.items():
        found = []
        for d, c, n in held:
            m = 25 + 75 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in terms(t) if x in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out[i] = sorted(found)[:k]
    return out


def check(got, want):
    rows = {}
    for r in sorted(got, key=lambda r: (r.item_id, r.rank)):
        rows.setdefault(r.item_id, []).append((-r.score, r.doc_id))
        assert r.rank == len(rows[r.item_id])
    assert rows == {i: x for i, x in want.items() if x}


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(ITEMS, "item_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("item", "terms", "block", "group", "shard", "score", "rank", "doc_id")})


def test_messy_rows(clashing, items, empty):
    want = plain([(r.doc_id, r.text) for r in clashing.collect()], ITEMS, 4)
    assert want[1] and want[6] and not want[5]
    check(ranked.ranked(clashing, items, 4).collect(), want)
    assert ranked.ranked(empty, items).count() == ranked.ranked(clashing, items.limit(0)).count() == 0
    assert ranked.ranked(clashing, items.filter("item_id = 5")).count() == 0


def test_many_ties_shards_and_blocks(spark, monkeypatch):
    """Equal documents in many shards and tasks, small blocks and groups: the smallest ids come, and all of them."""
    for name, value in (("BLOCK", 2), ("GROUP", 1), ("STEP", 1)):
        monkeypatch.setattr(ranked, name, value)
    rows = [((i * 37) % 400, f"alpha beta w{i % 7} " + "gamma " * (i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    asked = [(i, f"alpha w{i % 7} gamma w{(i + 1) % 7}") for i in range(9)]
    check(ranked.ranked(docs, spark.createDataFrame(asked, "item_id long, text string"), 10).collect(), plain(rows, asked))


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")
def test_driver_rows(spark):
    docs, asked = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    check(ranked.ranked(docs, asked).collect(), plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in asked.collect()]))


def shard_of(docs):
    import numpy as np

    texts = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])

    class Context:
        partitionId = staticmethod(lambda: 0)

    real, ranked.TaskContext = ranked.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        (batch,) = ranked._index(np.full(1 << 20, 255, np.uint8))(iter([texts]))
    finally:
        ranked.TaskContext = real
    row = batch.to_pylist()[0]
    return ranked.Shard(row, len(docs), row["length"])


def test_stops_early_and_only_strictly_below(monkeypatch):
    """Two lists in opposite order: the search ends before all documents are met, yet not while a tie may come."""
    import numpy as np

    monkeypatch.setattr(ranked, "STEP", 1)
    none = np.zeros(0, np.int64)
    docs = [(i, "rare " * (1 + (200 - i) // 20) + "filler " * (i % 5) + "x " * 30) for i in range(200)]
    shard = shard_of(docs)
    scores, ids, looked = shard.search(["rare", "filler"], [100, 1], 5, none, none)
    every = shard.search(["rare", "filler"], [100, 1], 200, none, none)
    assert looked < 200 and every[0][:5].tolist() == scores.tolist() and every[1][:5].tolist() == ids.tolist()
    same = shard_of([(i, "word") for i in (9, 3, 7, 1, 5)])
    assert same.search(["word"], [7], 2, none, none)[1].tolist() == [1, 3]
