"""Token files with keyed access.

``write`` encodes texts and stores a Parquet table of blocks, ordered by document id. A block is

* ``payload``: the ids of its documents in a row, raw, 2 bytes each, little-endian;
* ``ends``: where each document ends in it (8 bytes each, in ids);
* ``index``: a minimal perfect hash over its distinct document ids; at the place of a key's hash value
  lie its 4-byte fingerprint in ``prints``, itself in ``keys``, the number of its first document in the
  block in ``slots`` and how many documents it has in ``counts``;
* ``shard``, ``block``, ``start``: its file, its place there, and the ids before it in that file.

A lookup hashes the key, compares fingerprint and key at that place and cuts the payload: a fixed
number of steps, no search. The hash follows the layered scheme: keys alone in their place of a bit array take the
bit, the others go to the next array; the value is the rank of the bit, from the stored number of
bits before its word of 64 and the bits of that word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import column, cut, docs_in, mix, ship, tidy
from shelfline.llm.encode import ENCODING, encoder

#: A block is closed at so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 15
#: Words that a worker keeps while it writes; about 200 MB.
CACHED_WORDS = 1_000_000

_U = np.uint64
BLOCK = (
    "shard long, block long, start long, first_key long, last_key long, n_docs long, n_null long, n_ids long, "
    "payload binary, ends binary, keys binary, counts binary, index binary, prints binary, slots binary"
)


class PerfectHash:
    """0..n-1 for n distinct 64-bit keys, without repeats.

    A level is its number of places, its bits in words of 64, and the bits set before each word, all levels below included.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, before = [], keys.astype(np.uint64), 0
        while len(left):
            size = 2 * len(left) + 1
            place = cls._place(left, len(levels), size)
            alone = np.bincount(place, minlength=-(-size // 64) * 64) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = before + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            levels.append((size, words, ranks.astype("<u4")))
            before += int(alone.sum())
            left = left[~alone[place]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; of a key that was not built in, any value or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            place = self._place(keys[left], level, size)
            word, bit = words[place >> 6], _U(1) << (place & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = ranks[place[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - _U(1)))
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack(f"<{1 + len(self.levels)}Q", len(self.levels), *(size for size, *_ in self.levels))
        return head + b"".join(words.tobytes() + ranks.tobytes() for _, words, ranks in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        (count,) = struct.unpack_from("<Q", data)
        sizes, at, levels = struct.unpack_from(f"<{count}Q", data, 8), 8 + 8 * count, []
        for size in sizes:
            n = -(-size // 64)
            levels.append((size, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)))
            at += 12 * n
        return cls(levels)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype("<u4")


class Block:
    """A block read back."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["payload"], "<u2")
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.keys, self.counts = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<i8")
        self.hash = PerfectHash.load(row["index"])
        self.prints, self.slots = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["slots"], "<u4")
        self.n_null = row["n_null"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the keys the block has, number of the first document of each, how many it has)."""
        at = self.hash.of(keys)
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.prints[at[hit]] == _prints(keys[hit])]
        # A print of 4 bytes lets one foreign key in four billion through; the key itself decides.
        hit = hit[self.keys[at[hit]] == keys[hit]]
        return hit, self.slots[at[hit]].astype(np.int64), self.counts[at[hit]]

    def in_order(self) -> np.ndarray:
        """The keys as their documents lie in the block."""
        return self.keys[np.argsort(self.slots)]

    def cut(self, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.where(document > 0, self.ends[np.maximum(document - 1, 0)], 0)
        return begins, self.ends[document]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens, end = TaskContext.get().partitionId(), encoder(path, CACHED_WORDS), np.array([end_id], "<u2").tobytes()
        keys, data, sizes, held, number, start = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, data, sizes, held, number, start
            known = np.array([k for k in keys if k is not None], "<i8")
            distinct, first, counts = np.unique(known, return_index=True, return_counts=True)
            index = PerfectHash.build(distinct.view(np.uint64))
            at, n_null = index.of(distinct.view(np.uint64)), len(keys) - len(known)
            prints, slots, placed, times = (np.zeros(len(distinct), kind) for kind in ("<u4", "<u4", "<i8", "<i8"))
            prints[at], slots[at], placed[at], times[at] = _prints(distinct), first + n_null, distinct, counts
            row = {
                "shard": shard, "block": number, "start": start,
                "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
                "n_docs": len(keys), "n_null": n_null, "n_ids": held,
                "payload": b"".join(data), "ends": np.cumsum(sizes).astype("<i8").tobytes(),
                "keys": placed.tobytes(), "counts": times.tobytes(),
                "index": index.dump(), "prints": prints.tobytes(), "slots": slots.tobytes(),
            }
            number, start = number + 1, start + held
            keys, data, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
            for first, last, _, _ in docs_in(texts):
                found = tokens.encode([t or "" for t in texts[first:last].to_pylist()])
                for key, encoded in zip(ids[first:last], found, strict=True):
                    keys.append(key)
                    data += (encoded, end)
                    sizes.append(len(encoded) // 2 + 1)
                    held += sizes[-1]
                    if held >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                        yield flush()
        if keys:
            yield flush()

    return run


_SCHEMA = pa.schema(
    [
        (name, pa.binary() if kind == "binary" else pa.int64())
        for name, kind in (field.split(" ") for field in BLOCK.split(", "))
    ]
)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``documents`` as token blocks in ascending id order to the new folder ``path``.

    NULL text counts as empty: its ids are the end id alone. Rows with a NULL id come first and
    have no key; rows that share an id follow each other, ordered by their text's hash, and may
    run over several blocks and files, so no task has to hold all of them. Other columns are not
    looked at. An empty table makes an empty folder of blocks.
    """
    ship(documents.sparkSession)
    docs = cut(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    # The input position splits rows equal in id and text, of which one key may have any number.
    docs = docs.withColumns({"_print": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    order = ["doc_id", "_print", "_place"]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(tidy(_blocks(tokenizer, end_id), ENCODING), BLOCK).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ids in all files before it): a row per file."""
    sums = blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            keys = block.in_order()
            _, first, counts = block.find(keys)
            own = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            document = np.concatenate((np.arange(block.n_null), own)).astype(np.int64)
            begins, ends = block.cut(document)
            ids = pa.array([None] * block.n_null + np.repeat(keys, counts).tolist(), pa.int64())
            yield _documents(ids, begins + row["start"] + row["shard_start"], block, begins, ends)


def _documents(ids: pa.Array, starts: np.ndarray, block: Block, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    data = block.ids.astype("<u4").tobytes()
    found = [data[4 * a : 4 * z] for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(starts), pa.array(ends - begins), pa.array(found, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
    )


DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents through each block's index: doc_id, start, n_tokens, ids (4 bytes each)."""
    ship(spark)
    return blocks(spark, path).join(F.broadcast(shard_starts(spark, path)), "shard").mapInArrow(tidy(_read), DOCUMENTS)


def _route(bounds: list[tuple[int, int, int]]):
    """Files that may hold a key; ``bounds`` has the first and last key of each."""
    shards, low, high = (np.array(x, np.int64) for x in zip(*bounds, strict=True)) if bounds else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(column(batch, "key"))
            first, last = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
            count = np.maximum(last - first, 0)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, count)), pa.array(shards[at])], names=["key", "shard"])

    return run


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            keys = np.array(row["wanted"], np.int64)
            hit, first, count = block.find(keys)
            keys = keys[hit]
            document = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            begins, ends = block.cut(document)
            yield _documents(pa.array(np.repeat(keys, count)), begins + row["start"] + row["shard_start"], block, begins, ends)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str) -> DataFrame:
    """The documents with the keys asked for, as ``read`` gives them; unknown and NULL keys give no row.

    The driver learns the first and last key of each file, no more than it keeps of any file
    listing; blocks without a wanted key are not moved.
    """
    ship(spark)
    table = blocks(spark, path)
    per_shard = table.filter("first_key is not null").groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    bounds = [tuple(r) for r in per_shard.orderBy("shard").collect()]
    wanted = keys.select(F.col(f"`{key_col}`").cast("long").alias("key")).filter("key is not null").distinct()
    asked = wanted.mapInArrow(tidy(_route(bounds)), "key long, shard long")
    directory = table.select("shard", "block", "first_key", "last_key")
    asked = asked.join(directory, "shard").filter("key between first_key and last_key")
    asked = asked.groupBy("shard", "block").agg(F.collect_list("key").alias("wanted"))
    return table.join(asked, ["shard", "block"]).join(F.broadcast(shard_starts(spark, path)), "shard").mapInArrow(tidy(_lookup), DOCUMENTS)
