"""Substring dedup by recompression: repeated passages found through names of token runs and pairs.

Every text is rewritten in rounds. Runs of one word get a name, then neighbours
whose names fall on opposite sides of a hash bit are paired, and pairs get a
name. A name is a hash of what it stands for, so all tasks give equal substrings
equal names with no dictionary to share, and what happens inside a substring
does not depend on where it stands: each symbol carries the range of words that
decided it.

A window of ``length`` words is filed under the longest of the symbols decided
wholly inside it (or, where there is none, under its own hash), so equal windows
are filed alike. Neighbouring windows filed under one symbol form a span. Spark
then works on spans, one for some twenty words:

1. a symbol met in one document only ends there;
2. a symbol whose spans are all equal is settled at once by the smallest doc_id;
3. else the spans are compared, equal ones settled, and only one span of each
   kind gives its windows, which are grouped by their own hash.

All steps that group are sums, minima and maxima, combined before the shuffle;
copies by the thousand meet as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import (
    Powers,
    Rolling,
    column,
    cut,
    docs_in,
    hash_words,
    likely_in,
    mix,
    ship,
    stage,
    tidy,
    word_spans,
)

#: Words of a window.
LENGTH = 50
#: Rounds of pairing; a symbol stands for (4/3)**rounds words on average.
ROUNDS = 6

_U = np.uint64
_WORDS = Powers(0xA0761D6478BD642F)
_OWN = Powers(0xE7037ED1A0B428DB)


def rewrite(codes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, words of each, first word that decided it, word after the last that did) of texts in a row.

    ``codes`` are the words' hashes, ``first`` the place of each text's first word and
    the end. A text's edge decides like a word outside it.
    """
    count = len(codes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names, low, high = codes, np.arange(count), np.arange(1, count + 1)
    if not count:
        return names, low, low, high
    joined = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
    begins = np.flatnonzero(np.concatenate(([True], ~joined)))
    size = np.diff(np.append(begins, count))
    names = np.where(size > 1, mix(names[begins] + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), names[begins])
    # A run, as a single word, ends where a neighbour differs.
    low, high, text = begins - 1, begins + size + 1, text[begins]
    for step in range(rounds):
        side = (mix(names + _U(step + 1)) & _U(1)).astype(bool)
        near = text[1:] == text[:-1]
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~side[:-1] & side[1:] & near
        second = np.zeros(len(names), bool)
        second[1:] = pair[:-1]
        after, before = high.copy(), low.copy()
        after[:-1] = np.where(near, high[1:], high[:-1] + 1)
        after[-1] = high[-1] + 1
        before[1:] = np.where(near, low[:-1], low[1:] - 1)
        before[0] = low[0] - 1
        # Who stays single does so because of the neighbour it could have paired with.
        new_high = np.where(pair | ~side, after, high)
        new_low = np.where(side, before, low)
        following = np.empty_like(names)
        following[:-1] = names[1:]
        following[-1] = 0
        new = np.where(pair, mix(names * _U(0xC2B2AE3D27D4EB4F) + following * _U(0x165667B19E3779F9) + _U(step)), names)
        words = size.copy()
        words[:-1] += np.where(pair[:-1], size[1:], 0)
        kept = ~second
        names, size, low, high, text = new[kept], words[kept], new_low[kept], new_high[kept], text[kept]
    return names, size, low, high


def spans(
    codes: np.ndarray, first: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first window, windows, hash of the words) of all spans of texts in a row."""
    count, long = len(codes), np.diff(first) >= length
    begins_at = np.zeros(count + 1, np.int64)
    np.add.at(begins_at, first[:-1][long], 1)
    np.add.at(begins_at, first[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(begins_at)[:-1] > 0)  # words at which a window starts
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    names, words, low, high = rewrite(codes, first, rounds)
    # Both bounds rise along the text, so the symbols decided inside a window lie in a row.
    before = np.cumsum(np.bincount(np.clip(low, -1, count) + 1, minlength=count + 2))
    within = np.cumsum(np.bincount(np.clip(high, 0, count + 1), minlength=count + 2))
    left, right = before[at], within[at + length]
    found = right > left
    # The longest symbol goes first: short ones stand for words that occur everywhere.
    rank = mix(names ^ _U(0x2545F4914F6CDD1D)) >> _U(6) | (_U(63) - np.minimum(words, 63).astype(np.uint64)) << _U(58)
    reach = int((right - left).max(initial=1))
    table = [np.arange(len(names))]
    while 1 << len(table) <= reach:
        half = 1 << (len(table) - 1)
        a = table[-1]
        b = np.concatenate((a[half:], a[-1:].repeat(min(half, len(a)))))[: len(a)]
        table.append(np.where(rank[b] < rank[a], b, a))
    table = np.stack(table)
    size = np.where(found, right - left, 1)
    level = (np.frexp(size.astype(np.float64))[1] - 1).astype(np.int64)
    left, right = np.where(found, left, 0), np.where(found, right, 1)
    a, b = table[level, left], table[level, np.maximum(right - (1 << level), left)]
    chosen = np.where(rank[b] < rank[a], b, a)
    chosen[~found] = -1
    changes = np.ones(len(at), bool)
    changes[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(changes)
    number = np.diff(np.append(begins, len(at)))
    place, chosen = at[begins], chosen[begins]
    symbol = names[np.maximum(chosen, 0)]
    alone = chosen < 0
    if alone.any():
        symbol = symbol.copy()
        symbol[alone] = Rolling(mix(codes + _U(1)), _OWN).of(place[alone], place[alone] + length)
    content = Rolling(codes, _WORDS).of(place, place + number - 1 + length)
    return symbol, place, number, content


def _coded(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last + 1, word codes, first word of each text, key of each whole text) per slice."""
    for start, stop, data, offsets in docs_in(texts):
        begins, ends, first = word_spans(data, offsets)
        codes = hash_words(data, begins, ends)
        yield start, stop, codes, first, Rolling(codes, _OWN).of(first[:-1], first[1:]).view(np.int64)


SPANS = "doc_id long, mark long, text_key long, n_words long, kept_sha256 string, spans array<struct<symbol: long, at: int, n: int, content: long>>"


def _find_spans(length: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("symbol", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("content", pa.int64())])
        for batch in batches:
            texts, ids = column(batch, "text"), column(batch, "doc_id")
            for start, stop, codes, first, keys in _coded(texts):
                symbol, place, number, content = spans(codes, first, length, rounds)
                owner = np.searchsorted(first, place, "right") - 1
                # An id of NULL is smaller than none and has none smaller: such a text takes no part.
                known = np.asarray(ids[start:stop].is_valid())[owner]
                symbol, place, number, content, owner = (x[known] for x in (symbol, place, number, content, owner))
                values = pa.StructArray.from_arrays(
                    [
                        pa.array(symbol.view(np.int64)),
                        pa.array((place - first[owner]).astype(np.int32)),
                        pa.array(number.astype(np.int32)),
                        pa.array(content.view(np.int64)),
                    ],
                    fields=list(kind),
                )
                at = pa.array(np.searchsorted(owner, np.arange(stop - start + 1)).astype(np.int32))
                shas = [_digest((t or "").encode().split()) for t in texts[start:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[start:stop],
                        column(batch, "mark")[start:stop],
                        pa.array(keys),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(shas),
                        pa.ListArray.from_arrays(at, values),
                    ],
                    names=["doc_id", "mark", "text_key", "n_words", "kept_sha256", "spans"],
                )

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _windows(length: int):
    """The windows of the spans named with each text, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted, spans_of = (column(batch, c) for c in ("doc_id", "text_key", "spans"))
            for start, stop, codes, first, keys in _coded(column(batch, "text")):
                rolling, out = Rolling(codes, _WORDS), []
                for i in range(start, stop):
                    if keys[i - start] != wanted[i].as_py():
                        continue
                    symbol, at, number = (np.asarray(x) for x in spans_of[i].values.flatten())
                    place = np.repeat(at - np.cumsum(number) + number, number) + np.arange(number.sum())
                    begin = first[i - start] + place
                    content = rolling.of(begin, begin + length)
                    out.append((np.repeat(symbol, number), content.view(np.int64), np.full(len(place), ids[i].as_py()), np.full(len(place), keys[i - start]), place.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                        names=["symbol", "content", "doc_id", "text_key", "at"],
                    )

    return run


def _kept(text: str | None, at: np.ndarray, number: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode().split()
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + number - 1 + length, -1)
    return words, np.cumsum(depth)[:-1] == 0


def _digests(length: int):
    """Counts and digest of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted, ranges, texts = (column(batch, c) for c in ("doc_id", "text_key", "ranges", "text"))
            out = []
            for start, stop, _, _, keys in _coded(texts):
                for i in range(start, stop):
                    if keys[i - start] == wanted[i].as_py():
                        at, number = (np.asarray(x) for x in ranges[i].values.flatten())
                        words, stay = _kept(texts[i].as_py(), at, number, length)
                        kept = list(compress(words, stay.tolist()))
                        out.append((ids[i].as_py(), len(words), len(words) - len(kept), _digest(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def _texts(length: int):
    """Each text without its ranges; separators between kept words stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ranges, texts = (column(batch, c) for c in ("text_key", "ranges", "text"))
            out: list[str | None] = texts.to_pylist()
            for start, stop, data, offsets in docs_in(texts):
                begins, ends, first = word_spans(data, offsets)
                keys = Rolling(hash_words(data, begins, ends), _OWN).of(first[:-1], first[1:]).view(np.int64)
                for i in range(start, stop):
                    if wanted[i].as_py() != keys[i - start]:  # none, or another text under the id
                        continue
                    at, number = (np.asarray(x) for x in ranges[i].values.flatten())
                    _, stay = _kept(out[i], at, number, length)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], stay.astype(np.int8), [0]))))
                    k, whole = first[i - start], data.tobytes()
                    out[i] = b" ".join(
                        whole[begins[k + a] : ends[k + z - 1]] for a, z in zip(edges[::2], edges[1::2], strict=True)
                    ).decode()
            yield pa.RecordBatch.from_arrays([column(batch, "rest"), pa.array(out, pa.string())], names=["rest", "text"])

    return run


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """What is left of each text without the words of any window that a smaller id holds too.

    A row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one blank). A window is ``length`` words in a row; windows are judged on the input. A NULL
    text has no words; a text shorter than a window keeps all; a NULL id is neither smaller nor
    larger than another, so its text stays whole; rows of one id do not count against each
    other. An empty table gives an empty result; other columns are not looked at.
    """
    docs = _docs(documents, id_col, text_col)
    parsed, ranges = _repeated(docs, length, rounds)
    changed = likely_in(docs, "doc_id", ranges).join(_marked(parsed, ranges), ["doc_id", "mark"])
    changed = changed.mapInArrow(tidy(_digests(length)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    same = parsed.join(ranges.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_anti")
    return same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(changed)


def drop_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with the same words gone from the texts; all rows and columns stay.

    Separators between kept words stay, one blank stands for what is gone. Rules as in
    ``remove_repeats``.
    """
    parsed, ranges = _repeated(_docs(documents, id_col, text_col), length, rounds)
    packed = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("rest"),
    )
    touched = likely_in(packed, "doc_id", ranges).join(_marked(parsed, ranges), ["doc_id", "mark"], "left")
    touched = touched.mapInArrow(tidy(_texts(length)), packed.select("rest", "text").schema)
    out = likely_in(packed, "doc_id", ranges, negate=True).select("rest", "text").unionByName(touched)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in documents.columns])


def _docs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a mark of the text, so that the rows of one id are told apart in joins."""
    return cut(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))


def _marked(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, of (doc_id, text_key), with the mark of each text that has the key."""
    marks = likely_in(parsed.select("doc_id", "text_key", "mark"), "doc_id", wanted).distinct()
    return wanted.join(marks, ["doc_id", "text_key"])


def _repeated(docs: DataFrame, length: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(a row per text, the ranges of windows to remove per text), both staged."""
    ship(docs.sparkSession)
    parsed = stage(docs.mapInArrow(tidy(_find_spans(length, rounds)), SPANS), "spans")
    found = parsed.filter(F.size("spans") > 0).select("doc_id", "text_key", F.inline("spans"))
    symbols = (
        found.groupBy("symbol")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("first < last")
        .select("symbol", "first", (F.col("low") == F.col("high")).alias("alike"))
    )
    # Written tables come to the joins through a shuffle of their own, so that a hot symbol's rows can be split there.
    symbols = stage(symbols, "symbols")
    shared = stage(found.join(symbols, "symbol"), "shared")

    mixed = shared.filter("not alike").drop("first")
    kinds = stage(mixed.groupBy("symbol", "content").agg(F.min("doc_id").alias("first")), "kinds")
    mixed = mixed.join(kinds, ["symbol", "content"])
    # Equal rows of one id have equal spans: a list holds those of one text, however many rows have it.
    heads = mixed.filter("doc_id = first").groupBy("doc_id", "text_key", "symbol", "at").agg(F.max("n").alias("n"))
    heads = stage(heads.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("symbol", "at", "n")).alias("spans")), "heads")
    windows = likely_in(docs, "doc_id", heads).join(_marked(parsed, heads), ["doc_id", "mark"])
    windows = stage(windows.mapInArrow(tidy(_windows(length)), "symbol long, content long, doc_id long, text_key long, at int"), "windows")
    firsts = stage(windows.groupBy("symbol", "content").agg(F.min("doc_id").alias("first")), "firsts")
    later = windows.join(firsts, ["symbol", "content"]).filter("doc_id > first")

    place = ["doc_id", "text_key", "at", "n"]
    gone = shared.filter("alike and doc_id > first").select(place)
    gone = gone.unionByName(mixed.filter("doc_id > first").select(place))
    gone = gone.unionByName(later.select("doc_id", "text_key", "at", F.lit(1).alias("n")))
    gone = gone.groupBy("doc_id", "text_key", "at").agg(F.max("n").alias("n"))
    ranges = gone.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    return parsed, stage(ranges, "ranges")
