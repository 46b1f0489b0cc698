"""The pipeline's stages, each against a plain version of it on the rows the one before kept."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import test_mixing
import test_neardup
import test_repeats
from llm_rows import documents, prose  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfline.llm import quality, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("corpus"))
    junk = [(100 + i, " ".join(f"{w}$$$ %%%" for w in prose(50 + i, 60 + 30 * i).split()), "en", "a", 1) for i in range(12)]
    plain = [(200 + i, prose(80 + i, 70 + 30 * i), "en", "bc"[i % 2], 1) for i in range(12)]
    passage = prose(7, 60)
    shared = [(300 + i, f"{prose(120 + i, 90)} {passage} {prose(140 + i, 90)}", "en", None, 1) for i in range(3)]
    rows = documents.unionByName(spark.createDataFrame(junk + plain + shared, documents.schema))
    rows.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, 0) for i, *_ in junk] + [(i, 1, 0) for i, *_ in plain]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = [tuple(r) for r in (docs.select(COLUMNS) if name != "packing" else docs).collect()]
        assert name == "packing" or docs.columns == COLUMNS
    names = [n for n, _ in corpus_pipeline.STAGES]


    described = quality.describe(spark.read.parquet(f"{folder}/documents.parquet"))
    scored = quality.score(described, quality.fit(described, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    good = Counter(r.doc_id for r in scored if r.predicted)
    assert Counter(r[0] for r in seen[names[0]]) == good
    assert not any(100 <= (r[0] or 0) < 112 for r in seen[names[0]])
    assert sum(200 <= (r[0] or 0) < 212 for r in seen[names[0]]) >= 11

    assert Counter(r[0] for r in seen[names[1]]) == test_neardup.kept(seen[names[0]], 80)

    want = Counter((r[0], r[3]) for r in test_repeats.plain(seen[names[1]], 50))
    got = Counter((r[0], hashlib.sha256(" ".join((r[1] or "").encode().decode().split()).encode()).hexdigest()) for r in seen[names[2]])
    assert got == want
    assert any(r[2] for r in test_repeats.plain(seen[names[1]], 50))

    taken = defaultdict(int)
    for doc_id, _, _, n in test_mixing.plain(seen[names[2]])[0]:
        taken[doc_id] += n
    words = defaultdict(int)
    for r in seen[names[3]]:
        words[r[0]] += len((r[1] or "").encode().split())
        assert r[4] == len(r[1])
    assert dict(words) == {k: v for k, v in taken.items() if v}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = Counter()
    for r in seen[names[3]]:
        ids[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    pieces, fill = Counter(), Counter()
    for r in docs.collect():
        pieces[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
        assert len(np.frombuffer(r.ids, "<u2")) == r.length
    assert pieces == ids and max(fill.values()) <= 2048



def test_copies_between_80_and_85_go(spark, folder):
    rows = []
    for i in range(6):
        words = prose(400 + i, 300).split()
        rows.append((2 * i, " ".join(words), "en", "a", 1))
        rows.append((2 * i + 1, " ".join(words[: 244 + 2 * i]), "en", "a", 1))  # 81 to 85 % of the shingles
    scattered = prose(500, 300).split()
    rows.append((50, " ".join(scattered), "en", "a", 1))
    rows.append((51, " ".join(w if k % 50 != 25 else f"other{k}" for k, w in enumerate(scattered)), "en", "a", 1))
    gone = {r[0] for r in test_neardup.plain(rows, 80) if r[2] < r[0]}
    assert gone == {1, 3, 5, 7, 9, 11, 51} and len(gone) > sum(r[2] < r[0] for r in test_neardup.plain(rows, 85))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert found == {r[0] for r in rows} - gone


def test_run_and_names(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.build())
    assert numbers == list(range(1, 14))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
