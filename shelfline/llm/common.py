"""Helpers the training-data operators share: shipping code, staging, words and their hashes in bulk."""

from __future__ import annotations

import ctypes
import gc
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.session import scratch_path, stage

__all__ = ["column", "cut", "docs_in", "exact_words", "mix", "placed", "row_counter", "ship", "stage", "tidy", "word_spans", "hash_words"]

#: Text bytes worked on at once in a task; a longer text is taken alone.
SLICE_BYTES = 1 << 19

#: Bytes of a batch between Spark and a Python worker; both sides hold a few of them per task.
BATCH_BYTES = 4 << 20

#: The separators between words: blank, tab, line feed, vertical tab, form feed, return.
SEPARATORS = b" \t\n\v\f\r"
#: The same as a pattern for Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as `--py-files` would; bound batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    # The shared folder takes it, like everything else that executors read.
    path = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark)}/{package.name}_llm.zip")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    stream = files.create(path)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    context.addPyFile(files.makeQualified(path).toString())
    _shipped.add(context.applicationId)


#: What tasks of one kind leave in a worker for the next of that kind, and how to drop it.
LEFT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = ""):
    """``run``, giving memory it no longer uses back at its end, for workers live on between tasks.

    What tasks have LEFT goes before the start and at the end, unless it is what the task ``keeps``:
    an executor has more workers than cores, and those that wait would hold it.
    """

    def forget() -> None:
        for kind, drop in LEFT.items():
            if kind != keeps:
                drop()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        forget()
        gc.collect()
        for powers in Powers.known:
            powers.forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def cut(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as new=old, so that any others cannot clash with ours."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def exact_words(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_counter(df: DataFrame, name: str) -> DataFrame:
    """Adds a unique number per row; stable only once the result is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


# ---- texts of an Arrow batch as bytes ----------------------------------------------------------


def docs_in(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) per slice of a text column; NULL is an empty text.

    A slice holds about SLICE_BYTES, or one longer text; offsets has one entry more
    than there are texts.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    count = len(texts)
    if not count:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, count + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, number of words before each text and at the end); ``separators`` flags bytes."""
    gap = separators[data]
    opens = np.empty(len(data), bool)
    if len(data):
        opens[0] = True
        opens[1:] = gap[:-1]
        opens[offsets[:-1][offsets[:-1] < len(data)]] = True
        opens &= ~gap
        closes = np.empty(len(data), bool)
        closes[-1] = True
        closes[:-1] = gap[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        closes[ends] = True
        closes &= ~gap
    else:
        closes = opens
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---- hashes ------------------------------------------------------------------------------------

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER_CODES = _BYTE_CODES.copy()
_LOWER_CODES[65:91] = _BYTE_CODES[97:123]


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    known: list[Powers] = []

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.forget()
        self.known.append(self)

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.back, size)
        return self.up[:count], self.down[:count]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:  # doubles what is known
        more = min(done, count - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


class Rolling:
    """Hashes of any run of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_BYTES = Powers(0xD6E8FEB86659FD93)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word; with ``lower``, A-Z count as a-z."""
    return Rolling((_LOWER_CODES if lower else _BYTE_CODES)[data], _BYTES).of(starts, ends)


# ---- a fixed-size filter ahead of a join ----------------------------------------------------------

_PART_BITS = 1 << 15
_PARTS = 256


def likely_in(df: DataFrame, key: str, wanted: DataFrame, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted[key]``; a join afterwards decides. ``negate``: the others.

    Key hashes set bits in a map of 1 MB, whatever the input, and only that map is
    broadcast. It spares the shuffle of long texts that no key asks for; with very many
    keys it lets everything pass and the join still gives the same rows.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(_PARTS * _PART_BITS))
    part, bit = (slot / _PART_BITS).cast("int"), F.pmod(slot, F.lit(_PART_BITS))
    bits = wanted.select(part.alias("_part"), bit.alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("_byte >> _shift & 1") == 1
    return (
        df.withColumn("_part", part)
        .join(F.broadcast(bits), "_part", "left")
        .withColumns({"_byte": byte, "_shift": F.pmod(bit, F.lit(8)).cast("int")})
        .filter(~F.coalesce(is_set, F.lit(False)) if negate else is_set)
        .drop("_part", "_bits", "_byte", "_shift")
    )


# ---- places in an order ---------------------------------------------------------------------------


def placed(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df``, staged, with each row's place from 0 in the given order.

    Rows are dealt out in ranges and numbered within; only the ranges' sizes, a row per
    partition, are added up in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.expr("_at & 8589934591")).drop("_part", "_start", "_at")
