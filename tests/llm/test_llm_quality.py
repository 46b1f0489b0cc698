"""The classifier against a direct computation, and its accuracy on rows it has not seen."""

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_rows import clashing, documents, empty  # noqa: F401

from shelfline.llm import quality

DATA = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")
def test_held_out_rows(spark):
    described = quality.describe(spark.read.parquet(f"{DATA}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in quality.score(described, quality.fit(described, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    scores, truth = (np.array(c) for c in zip(*held, strict=True))
    assert auc(scores, truth) > 0.98
    assert ((scores >= 0.5) == truth).mean() > 0.95


def test_scores_equal_the_textbook_formula(spark):
    rng = np.random.default_rng(0)
    size = len(quality.STATISTICS)
    rows = np.concatenate((rng.normal(0, 1, (300, size)), rng.normal(0.5, 2, (200, size))))
    labels = np.repeat([1, 0], [300, 200])
    sums = np.stack([np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for x in (rows[labels == 0], rows[labels == 1])])
    got = quality.Model(sums).score(rows)
    parts = [rows[labels == k] for k in (0, 1)]
    cov = [np.cov(x.T, bias=True) for x in parts]
    pooled = (200 * cov[0] + 300 * cov[1]) / 500
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(size)
    logs = []
    for x, c in zip(parts, cov, strict=True):
        s, d = 0.5 * c + 0.5 * pooled, rows - x.mean(0)
        logs.append(np.log(len(x)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(got, 1 / (1 + np.exp((logs[0] - logs[1]) / size)))


def test_messy_rows(spark, documents, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1), (5, None, 0), (None, 1, 0), (9, 7, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    described = quality.describe(clashing)
    found = quality.score(described, quality.fit(described, labels)).collect()
    assert len(found) == clashing.count() and all(0 <= r.score <= 1 for r in found)
    model = quality.fit(described, labels.limit(0))
    assert {r.score for r in quality.score(described, model).collect()} == {0.5}
    assert quality.score(quality.describe(empty), model).count() == 0
    kept = quality.keep_good(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def plain_statistics(text):
    """The 17 statistics of one text, word by word."""
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\v\f\r]+", data) if w]
    lower = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in words]
    pairs, lines = list(zip(lower, lower[1:])), re.findall(rb"[^\n]*\n|[^\n]+", data)  # a line with its break
    n, size = len(words), len(data)
    some_words, some_bytes = n + quality.PLAIN_WORDS, size + 6 * quality.PLAIN_WORDS
    upper = lambda x: sum(65 <= b < 91 for b in x)
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,?;:'\"-()|"
    letters = sum(65 <= b < 91 or 97 <= b < 123 or 128 <= b < 192 for b in data) + 5 * quality.PLAIN_WORDS
    count = lambda chars: sum(b in chars for b in data)
    return [
        np.log1p(n),
        np.log(some_bytes / some_words),
        np.sqrt((n - len(set(lower))) / some_words),
        np.sqrt((len(pairs) - len(set(pairs))) / some_words),
        np.sqrt(max(Counter(lower).values(), default=0) / some_words),
        np.sqrt(upper(data) / letters),
        np.sqrt(sum(upper(w) > 1 and 2 * upper(w) > len(w) for w in words) / some_words),
        np.sqrt(sum(48 <= b < 58 for b in data) / some_bytes),
        np.sqrt(sum(b >= 128 for b in data) / some_bytes),
        np.sqrt(count(b".?") / some_words),
        np.sqrt(count(b",;:") / some_words),
        np.sqrt(sum(map(mark, data)) / some_bytes),
        np.sqrt(sum(any(map(mark, w)) for w in words) / some_words),
        np.sqrt(count(b"|") / some_words),
        np.log1p(n / (1 + count(b"\n"))),
        np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 6)) if len(lines) > 1 else 0.0,
        np.sqrt(sum(len(w) > 12 for w in words) / some_words),
    ]


def test_statistics_equal_a_plain_count():
    texts = [
        "", " ", "one", "One  one\tTWO two two", "line\nline\nother\nline", "a,b;c: d? e. f!", "$$$ %%% ABC AbC || 12 345", "wörter ÜND ümläute " * 9,
        "averyveryverylongword " * 3, "\n\n\n", "x" * 5000, "the same the same the same", "ends with a break\n", "né né né\nné né né",
    ]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = quality.statistics(data, offsets)
    want = np.array([plain_statistics(t) for t in texts])
    assert got.shape == (len(texts), len(quality.STATISTICS))
    assert np.allclose(got, want), [(texts[i], quality.STATISTICS[j], got[i, j], want[i, j]) for i, j in np.argwhere(~np.isclose(got, want))][:5]


def test_learning_reads_rows_that_may_have_a_label(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (11, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    some = quality.labelled(documents, labels)
    assert some.columns == documents.columns
    assert {1, 2, 11} <= {r.doc_id for r in some.collect()} and some.count() < documents.count()
    whole, part = (quality.fit(quality.describe(df), labels) for df in (documents, some))
    assert np.allclose(whole.rows, part.rows) and all(np.allclose(a[0], b[0]) for a, b in zip(whole.parts, part.parts, strict=True))
