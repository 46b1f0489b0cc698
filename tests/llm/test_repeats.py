"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_rows import clashing, documents, empty, ordered, prose  # noqa: F401
from pyspark.sql import functions as F

from shelfline.llm import repeats


def plain(rows, length):
    first, words = {}, []
    for doc_id, text, *_ in rows:
        own = (text or "").encode().split()
        words.append(own)
        if doc_id is not None:
            for a in range(len(own) - length + 1):
                window = tuple(own[a : a + length])
                first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for (doc_id, *_), own in zip(rows, words, strict=True):
        stay = [True] * len(own)
        for a in range(len(own) - length + 1):
            if doc_id is not None and first[tuple(own[a : a + length])] < doc_id:
                stay[a : a + length] = [False] * length
        kept = [w for w, s in zip(own, stay, strict=True) if s]
        out.append((doc_id, len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("length", [50, 7])
def test_messy_rows(documents, clashing, length):
    rows = [tuple(r) for r in documents.collect()]
    assert ordered(repeats.remove_repeats(documents, length=length)) == plain(rows, length)
    if length == 50:
        assert ordered(repeats.remove_repeats(clashing)) == plain(rows, length)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    """Few distinct words make runs, periods and overlapping repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice("aab bc"[: 2 + seed * 2].split() or ["a"]) for _ in range(rng.randint(0, 60))]
        if rows and rng.random() < 0.6:
            old = rng.choice(rows)[1].split(" ")
            at = rng.randint(0, len(words))
            words[at:at] = old[rng.randint(0, len(old)) :]
        rows.append((i // 2 if seed == 1 else i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(repeats.remove_repeats(df, length=9, rounds=3)) == plain(rows, 9)


def test_equal_windows_are_filed_alike():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 6, 4000).astype(np.uint64)
    codes[3000:3200] = codes[500:700]
    first = np.array([0, 1700, 1700, 4000])
    symbol, place, number, _ = repeats.spans(codes, first, 20, 4)
    of = {int(a): int(s) for s, p, n in zip(symbol, place, number, strict=True) for a in range(p, p + n)}
    seen = {}
    for a, s in of.items():
        assert seen.setdefault(tuple(codes[a : a + 20].tolist()), s) == s
    assert sorted(of) == [*range(0, 1681), *range(1700, 3981)]


def test_texts_keep_rows_and_columns(documents, clashing, empty):
    out = repeats.drop_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    words = {(r.doc_id, " ".join((r.text or "").split())) for r in repeats.drop_repeats(documents).collect()}
    want = {r[3] for r in plain([tuple(r) for r in documents.collect()], 50)}
    assert {hashlib.sha256(t.encode()).hexdigest() for _, t in words} == want
    assert repeats.remove_repeats(empty).count() == 0 and repeats.drop_repeats(empty).count() == 0


def test_equal_rows_of_one_id_stay_linear(spark, monkeypatch):
    """20 000 equal rows of an id that hold another's passages: lists are as long as one text asks for."""
    shared, alike = prose(30, 70), prose(31, 60)
    text = f"{prose(32, 20)} {shared} {prose(33, 30)} {alike}"
    rows = [(1, f"{shared} {prose(34, 40)}"), (2, f"{prose(35, 9)} {alike}"), (0, f"x {shared} y")] + [(5, text)] * 20_000
    rows += [(5, f"{prose(100 + i, 12)}  {alike}") for i in range(200)]
    longest, real = [], repeats.stage

    def staged(df, label):
        out = real(df, label)
        for name in {"spans", "ranges"} & set(out.columns):
            longest.append(out.agg(F.max(F.size(name))).first()[0] or 0)
        if label in ("windows", "ranges"):
            longest.append(out.count() // 25_000)
        return out

    monkeypatch.setattr(repeats, "stage", staged)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter(tuple(r) for r in repeats.remove_repeats(df).collect())
    first = {}
    for doc_id, t in set(rows):
        own = t.split()
        for a in range(len(own) - 49):
            window = tuple(own[a : a + 50])
            first[window] = min(first.get(window, doc_id), doc_id)
    want = Counter()
    for (doc_id, t), times in Counter(rows).items():
        own = t.split()
        stay = [not any(first[tuple(own[b : b + 50])] < doc_id for b in range(max(0, a - 49), min(a, len(own) - 50) + 1)) for a in range(len(own))]
        left = [w for w, s in zip(own, stay, strict=True) if s]
        want[doc_id, len(own), len(own) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()] += times
    assert got == want and max(longest) < 200
    assert repeats.drop_repeats(df).count() == len(rows)
