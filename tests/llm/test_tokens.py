"""Token files and the encoder against the tokenizer's own answer."""

import numpy as np
import public_tokenizers
import pytest
from llm_rows import clashing, documents, empty, key, prose  # noqa: F401
from tokenizers import Tokenizer

from shelfline.llm import tokens
from shelfline.llm.encode import Encoder

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_whole_texts(path):
    odd = ["a  b", "a \n b", "\na", "a\n", "a\n\nb", " ", "a\n\n\nb c", "", "it's don't 'll", "\ta b\t c", "a\rb c", "é é ́x", "ΑΣ ΟΣ x"]
    odd += ["<|endoftext|> a<|endoftext|>", "İ I", "\0a b", "a\x1cb \x1c c", "a　 b", "a  b", "<a> <b", prose(1, 900), "x" * 3000]
    encoder, want = Encoder(path), whole(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(odd)] == [want(t) for t in odd]


def test_cache_keeps_two_generations(monkeypatch):
    monkeypatch.setattr("shelfline.llm.encode.CACHED_WORDS", 40)
    encoder, want = Encoder(BYTES), whole(BYTES)
    texts = [prose(i % 7, 60) for i in range(30)]
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == want(text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_known_words_are_looked_up_once(path, monkeypatch):
    class Word(str):
        asked = 0

        def __hash__(self):
            Word.asked += 1
            return str.__hash__(self)

    encoder, text = Encoder(path), prose(3, 60)
    encoder.encode([text])
    pieces = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda t: [Word(p) for p in pieces(t)])
    got = encoder.encode([f"{text} unheardof 12345"])
    assert np.frombuffer(got[0], "<u2").tolist() == whole(path)(f"{text} unheardof 12345")
    assert Word.asked < 1.5 * len(pieces(text))


def test_cache_of_its_own_size():
    small, large = Encoder(BYTES, 40), Encoder(BYTES, 4000)
    for encoder in (small, large):
        for i in range(30):
            encoder.encode([prose(i % 7, 60)])
    assert len(small.words) < len(large.words)


def test_round_trip(spark, documents, clashing, empty, tmp_path, monkeypatch):
    want, start = [], 0
    rows = sorted(documents.collect(), key=lambda r: key((r.doc_id,)))
    for df, folder in ((documents, "a"), (clashing, "b")):
        tokens.write(df, str(tmp_path / folder), BYTES, 2)
        found = tokens.read(spark, str(tmp_path / folder)).orderBy("start").collect()
        assert [r.doc_id for r in found] == [r.doc_id for r in rows]
        assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
        encode = whole(BYTES)
        want = sorted(((r.doc_id, encode(r.text) + [2]) for r in rows), key=lambda r: (key((r[0],)), r[1]))
        got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=lambda r: (key((r[0],)), r[1]))
        assert got == want
    asked = spark.createDataFrame([(2,), (9,), (99,), (None,), (10,), (2,)], "k long")
    hit = tokens.lookup(spark, str(tmp_path / "a"), asked, "k").collect()
    assert sorted(r.doc_id for r in hit) == [2, 2, 9, 10, 10]
    by_start = {r.start: r.ids for r in found}
    assert all(by_start[r.start] == r.ids for r in hit)
    tokens.write(empty, str(tmp_path / "c"), BYTES, 2)
    assert tokens.read(spark, str(tmp_path / "c")).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    index = tokens.PerfectHash.load(tokens.PerfectHash.build(keys).dump())
    assert sorted(index.of(keys)) == list(range(len(np.unique(keys))))
    assert len(tokens.PerfectHash.build(keys[:0]).of(keys)) == 5000


def test_foreign_keys_are_not_found():
    """A block answers for its own keys only, whatever the hash gives for others; nothing is searched."""
    keys = np.arange(0, 3000, 3, dtype="<i8")
    index = tokens.PerfectHash.build(keys.view(np.uint64))
    at = index.of(keys.view(np.uint64))
    placed = {n: np.zeros(len(keys), k) for n, k in (("prints", "<u4"), ("keys", "<i8"), ("slots", "<u4"), ("counts", "<i8"))}
    for name, values in (("prints", tokens._prints(keys)), ("keys", keys), ("slots", np.arange(len(keys))), ("counts", keys % 4 + 1)):
        placed[name][at] = values
    row = {n: v.tobytes() for n, v in placed.items()} | {"payload": b"", "ends": b"", "index": index.dump(), "n_null": 0}
    block = tokens.Block(row)
    asked = np.arange(-5, 3100, dtype="<i8")
    hit, first, counts = block.find(asked)
    assert asked[hit].tolist() == keys.tolist() and first.tolist() == list(range(len(keys))) and counts.tolist() == (keys % 4 + 1).tolist()
    assert block.in_order().tolist() == keys.tolist()
