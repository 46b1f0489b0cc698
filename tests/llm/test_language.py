"""The string kernel against sets of n-grams, the regression against its closed form, accuracy on unseen rows."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import clashing, documents, empty  # noqa: F401
from pyspark.sql import functions as F

from shelfline.llm import language

DATA = "/root/testdata/sf0.01"


def grams(text):
    flat = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in (text or "").encode())
    return {flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)}


def kernel(a, b):
    return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))


def test_kernels_equal_sets_of_grams(monkeypatch):
    texts = ["Der Hund läuft", "the dog, runs 7 times", "", None, "a", "ab", "ÀÉ", "x" * 50, "le chien à côté " * 40, "THE DOG"]
    marks = language.Landmarks(["the dog runs", "le chien à côté de l'eau", "der Hund und die Katze", "the dog runs"])
    want = [[kernel(grams(t), grams(m)) for m in ("the dog runs", "le chien à côté de l'eau", "der Hund und die Katze", "the dog runs")] for t in texts]
    for rows, chunk in ((256, 1 << 20), (3, 5)):  # also in small batches and with texts in parts
        monkeypatch.setattr(language, "ROWS", rows)
        monkeypatch.setattr(language, "CHUNK", chunk)
        found = list(marks.kernels(pa.array(texts)))
        assert [x for first, last, _ in found for x in range(first, last)] == list(range(len(texts)))
        assert np.allclose(np.concatenate([x for *_, x in found]), want, atol=1e-6)
    own = np.array(want)[[9]]  # features reproduce the kernel between landmarks, repeated ones too
    assert own.shape == (1, 4)
    between = np.concatenate([x for *_, x in marks.kernels(pa.array(["the dog runs", "le chien à côté de l'eau", "der Hund und die Katze", "the dog runs"]))])
    features = between @ marks.turn
    assert np.allclose(features @ features.T, between, atol=1e-5) and marks.turn.shape[1] == 3


def rows_of(texts):
    return [(i, t, lang, "s") for i, (t, lang) in enumerate(texts)]


def test_model_equals_kernel_ridge_in_closed_form(spark):
    rng = np.random.default_rng(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["wörter", "übel", "ämter"], "cc": ["zzyzx", "qwrt", "xkcd"]}
    texts = [(" ".join(rng.choice(words[lang], 6)), lang) for lang in rng.choice(list(words), 90)]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string")
    marks = language.landmarks(docs, count=12)
    described = language.describe(docs, marks).cache()
    model = language.fit(described, marks)
    rows = {r.doc_id: r for r in described.collect()}
    assert all(r.learn == (zlib.crc32(str(i).encode()) % 5 != 0) for i, r in rows.items())
    features = {i: np.append(np.array(r.kernels, float) @ marks.turn, 1.0) for i, r in rows.items()}
    x = np.stack([features[i] for i, r in rows.items() if r.learn])
    y = np.array([[1.0 if r.lang == lang else -1.0 for lang in model.languages] for r in rows.values() if r.learn])
    want = np.linalg.solve(x.T @ x + language.RIDGE * len(x) * np.eye(x.shape[1]), x.T @ y)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(model.weights, want, atol=1e-6)
    for r in language.predict(described, model).collect():
        answers = language.SHARPNESS * features[r.doc_id] @ want
        shares = np.exp(answers) / np.exp(answers).sum()
        assert r.lang_pred == model.languages[shares.argmax()] and abs(r.score - shares.max()) < 1e-6
        assert r.lang_pred == rows[r.doc_id].lang


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")
def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = language.landmarks(docs)
    described = language.describe(docs, marks).cache()
    found = {r.doc_id: r for r in language.predict(described, language.fit(described, marks)).collect()}
    truth = docs.select("doc_id", "text", "lang").collect()
    assert len(found) == len(truth)
    held = [found[r.doc_id].lang_pred == r.lang for r in truth if found[r.doc_id].held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert len(held) > 100 and np.mean(held) > 0.97
    for r in truth:
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (found[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= found[r.doc_id].score <= 1


def test_messy_rows(spark, clashing, empty):
    clashing = clashing.withColumns({c: F.lit("x") for c in ("learn", "letters", "kernels", "mark", "far")})
    marks = language.landmarks(clashing)
    described = language.describe(clashing, marks)
    found = language.predict(described, language.fit(described, marks)).collect()
    texts = sorted((r.doc_id is not None, r.doc_id or 0, any(c.isalpha() for c in r.text or "")) for r in clashing.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.lang_pred != "und") for r in found) == texts
    assert {r.lang_pred for r in found} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.lang_pred == "und"} == {0.0}
    # Nothing to learn from: no language is known. Empty tables give empty results.
    none = clashing.withColumn("lang", F.lit(None).cast("string"))
    marks = language.landmarks(none)
    described = language.describe(none, marks)
    assert {(r.lang_pred, r.score) for r in language.predict(described, language.fit(described, marks)).collect()} == {("und", 0.0)}
    marks = language.landmarks(empty)
    described = language.describe(empty, marks)
    assert language.predict(described, language.fit(described, marks)).count() == 0


def test_landmarks_are_shared_out(spark):
    """A hot language gets no more landmarks than others; copies count once."""
    texts = [(f"word{i % 300} " * 100, "hot") for i in range(2000)] + [("stets gleich " * 60, "rare")] * 50 + [("kurz", "short")] * 5
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string")
    assert language.landmarks(docs, count=30).matrix.shape[1] == 12
