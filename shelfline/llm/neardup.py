"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. A task turns each text into its set of word shingles, a 128-bit print of the set and a
   signature of MinHash values. Texts with equal sets become one node.
2. Bands of the signature file the nodes into buckets. Nodes that buckets connect are a family;
   whatever pair shares a bucket is in one family. Buckets only hand on their smallest node, so
   a bucket of any size gives one row per member.
3. Families are cut into groups of sizes that can be similar at all, and these into blocks of
   bounded rows and bytes. Every pair of blocks of a group is a unit, worked on in one go as matrices.
4. In a unit the signatures of all pairs are compared batch by batch. As soon as the posterior
   probability that the similarity reaches the threshold falls below ``miss``, the pair goes.
5. Survivors are confirmed on their full shingle sets, the likeliest first; nodes that links of
   the unit already connect need no further check. A unit writes links only, never its pairs.
6. Links are merged to components.

A pair exactly at the threshold shares no band with probability (1 - 0.85**6)**40 = 6e-9;
at the pipeline's 0.8 it is 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Powers, Rolling, column, cut, docs_in, hash_words, likely_in, mix, row_counter, ship, stage, word_spans, tidy
from shelfline.llm.components import components

SHINGLE = 5
BANDS, BAND_ROWS = 40, 6
VALUES = BANDS * BAND_ROWS
#: Least share of common shingles, in hundredths.
PERCENT = 85
#: MinHash values compared at once.
BATCH = 40
#: Posterior probability of a wanted pair below which comparing stops.
MISS = 1e-7
#: Rows and bytes of a block; a unit holds two.
UNIT_ROWS, UNIT_BYTES = 1500, 4 << 20

_U = np.uint64
_WORDS = Powers(0x8CB92BA72F3D8DD7)
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
_XOR, _TIMES = _SEEDS[:VALUES].astype(np.uint32), _SEEDS[VALUES:].astype(np.uint32) | np.uint32(1)


def shingle_sets(codes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, where each text's begin)."""
    rolling, sets = Rolling(codes, _WORDS), []
    every = rolling.of(np.arange(max(len(codes) - size + 1, 0)), np.arange(size, max(len(codes) + 1, size)))
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin > size:
            part = np.sort(every[begin : end - size + 1])
            sets.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
        elif end > begin:
            sets.append(rolling.of(np.array([begin]), np.array([end])))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of MinHash values per non-empty set."""
    short = mix(values).astype(np.uint32)
    out = np.empty((len(at), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat((short ^ _XOR[k]) * _TIMES[k], at)
    return out


def _sets_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for start, stop, data, offsets in docs_in(texts):
        begins, ends, first = word_spans(data, offsets)
        values, at = shingle_sets(hash_words(data, begins, ends, lower=True), first)
        full = np.diff(at) > 0
        one, two = np.zeros(stop - start, np.uint64), np.zeros(stop - start, np.uint64)
        if full.any():
            one[full] = np.add.reduceat(mix(values), at[:-1][full])
            two[full] = np.add.reduceat(mix(values ^ _U(0x5851F42D4C957F2D)), at[:-1][full])
        yield start, stop, values, at, one.view(np.int64), two.view(np.int64)


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for start, stop, values, at, one, two in _sets_of(column(batch, "text")):
            full = np.diff(at) > 0
            found = np.full(stop - start, None, object)
            if full.any():
                rows = signatures(values, at[:-1][full])
                found[full] = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [ids[start:stop], column(batch, "mark")[start:stop], pa.array(np.diff(at)), pa.array(one), pa.array(two), pa.array(found, pa.binary())],
                names=["doc_id", "mark", "n_shingles", "one", "two", "signature"],
            )


def _values(signature: pa.Array) -> np.ndarray:
    data = signature.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    return np.frombuffer(data.buffers()[2], np.uint32)[offsets[0] // 4 : offsets[-1] // 4].reshape(len(data), VALUES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _values(column(batch, "signature")).reshape(batch.num_rows, BANDS, BAND_ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (batch.num_rows, BANDS))
        for k in range(BAND_ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + values[:, :, k])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.ravel().view(np.int64)),
                pa.array(np.repeat(np.asarray(column(batch, "node")), BANDS)),
            ],
            names=["bucket", "node"],
        )


def least_matches(percent: int, miss: float, values: int = VALUES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, matches a pair must have by then) after each batch.

    With a uniform prior and m matches of n the posterior probability that the similarity
    reaches t is P(Binomial(n + 1, t) <= m); fewer matches than listed put it below ``miss``.
    """
    t, out = percent / 100, []
    for n in range(batch, values + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures and full sets of the texts that stand for nodes, once each."""
    done: set[int] = set()
    for batch in batches:
        nodes, units = column(batch, "node"), column(batch, "units")
        one_of, two_of = np.asarray(column(batch, "one")), np.asarray(column(batch, "two"))
        for start, stop, values, at, one, two in _sets_of(column(batch, "text")):
            own = np.flatnonzero((one == one_of[start:stop]) & (two == two_of[start:stop]) & (np.diff(at) > 0))
            own = [i for i in own if (n := nodes[start + int(i)].as_py()) not in done and not done.add(n)]
            if not own:
                continue
            sets = [values[at[i] : at[i + 1]] for i in own]
            begins = np.cumsum([0] + [len(x) for x in sets])[:-1]
            rows = signatures(np.concatenate(sets), begins)
            take = pa.array([start + int(i) for i in own])
            yield pa.RecordBatch.from_arrays(
                [
                    nodes.take(take),
                    units.take(take),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                names=["node", "units", "signature", "shingles"],
            )


class _Unit:
    """The links of one unit."""

    def __init__(self, percent: int, steps: list[tuple[int, int]]):
        self.percent, self.steps = percent, steps

    def links(self, nodes: list[int], blocks: list[int], signatures_of: list[bytes], sets_of: list[bytes]) -> list[tuple[int, int]]:
        keep = {n: k for k, n in enumerate(nodes)}.values()
        nodes, blocks = [nodes[k] for k in keep], np.array([blocks[k] for k in keep])
        rows = np.frombuffer(b"".join(signatures_of[k] for k in keep), np.uint32).reshape(len(nodes), VALUES)
        sets = [np.frombuffer(sets_of[k], np.uint64) for k in keep]
        sizes = np.array([len(x) for x in sets])
        across = len(set(blocks.tolist())) > 1
        first, second, score = [], [], []
        for i in range(len(nodes)):
            fits = np.minimum(sizes[i], sizes[i + 1 :]) * 100 >= np.maximum(sizes[i], sizes[i + 1 :]) * self.percent
            if across:
                fits &= blocks[i + 1 :] != blocks[i]
            alive, same, done = np.flatnonzero(fits) + i + 1, 0, 0
            for n, least in self.steps:
                if not len(alive):
                    break
                same = same + (rows[alive, done:n] == rows[i, done:n]).sum(axis=1)
                stay = same >= least
                alive, same, done = alive[stay], same[stay], n
            if len(alive):
                first.append(np.full(len(alive), i, np.int32))
                second.append(alive.astype(np.int32))
                score.append(same.astype(np.int32))
        return self._confirmed(nodes, sets, first, second, score) if first else []

    def _confirmed(self, nodes, sets, first, second, score) -> list[tuple[int, int]]:
        order = np.argsort(-np.concatenate(score), kind="stable")
        root, out = list(range(len(nodes))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(np.concatenate(first)[order].tolist(), np.concatenate(second)[order].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                both = np.sort(np.concatenate((sets[i], sets[j])))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= self.percent * (len(both) - common):
                    root[a] = b
                    out.append((nodes[i], nodes[j]))
        return out


def _links(percent: int, miss: float):
    steps = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, key = _Unit(percent, steps), [], None

        def flush() -> pa.RecordBatch:
            found = unit.links(*map(list, zip(*held, strict=True))) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(column(batch, c).to_pylist() for c in ("family", "sizes", "low", "high")), strict=True)
            rows = zip(*(column(batch, c).to_pylist() for c in ("node", "block", "signature", "shingles")), strict=True)
            for here, row in zip(keys, rows, strict=True):
                if here != key:
                    if held:
                        yield flush()
                    held, key = [], here
                held.append(row)
        if held:
            yield flush()

    return run


def _units(nodes: DataFrame, percent: int) -> DataFrame:
    """node and units, the list of units each node takes part in, of (node, family, n_shingles).

    Sizes are grouped by powers of four, with a group of their own for those near enough to
    a border to match across it.
    """
    place = F.floor(F.log("n_shingles") / F.log(F.lit(4.0)) + 1e-9)
    above, below = F.pow(F.lit(4.0), place + 1), F.pow(F.lit(4.0), place)
    groups = F.array(
        2 * place,
        F.when(F.col("n_shingles") * 100 >= above * percent, 2 * place + 1),
        F.when(F.col("n_shingles") * percent <= below * 100, 2 * place - 1),
    )
    grouped = nodes.withColumn("sizes", F.explode(groups)).filter("sizes is not null")
    blocks = F.ceil(F.greatest(F.col("rows") / UNIT_ROWS, F.col("bytes") / UNIT_BYTES)).cast("int")
    sizes = grouped.groupBy("family", "sizes").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("n_shingles") * 8 + VALUES * 4).alias("bytes")
    )
    sizes = sizes.filter("rows > 1").select("family", "sizes", blocks.alias("blocks"))
    placed = grouped.join(sizes, ["family", "sizes"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.struct("family", "sizes", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    return placed.groupBy("node").agg(F.collect_list(unit).alias("units"))


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents``.

    Words are runs of other bytes than blank and \\t-\\r, with A-Z lower-cased. A text's set are its
    distinct shingles of five words; a shorter text has one, all of it; without words it has
    none and is linked with nothing. Texts are linked if 100 * common >= ``percent`` * united.
    component_id is the smallest id that links reach, ``kept`` whether it is the row's own.
    A NULL text counts as empty. A row with a NULL id may link others; its component_id is the
    smallest id there, or NULL, and then it counts as kept. Rows with one id and different texts
    are separate texts. Other columns are not looked at; an empty table gives an empty result.
    """
    sets, rooted = _rooted(documents, id_col, text_col, percent, miss)
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = rooted.join(smallest, "root").select("one", "two", "n_shingles", "component_id")
    out = sets.select("doc_id", "one", "two", "n_shingles").join(of_set, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _first() -> Column:
    """The first row of a group: the smallest id, NULL after all others, then the smallest mark of the text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")


def _rooted(documents: DataFrame, id_col: str, text_col: str, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its set, a row per distinct set with the smallest set that links reach)."""
    ship(documents.sparkSession)
    docs = cut(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    sets = stage(docs.mapInArrow(tidy(_print), "doc_id long, mark long, n_shingles long, one long, two long, signature binary"), "sets")
    classes = sets.filter("n_shingles > 0").groupBy("one", "two", "n_shingles")
    classes = classes.agg(_first(), F.max("signature").alias("signature"))
    classes = stage(row_counter(classes.select("one", "two", "n_shingles", "first.doc_id", "first.mark", "signature"), "node"), "classes")

    bands = stage(classes.select("node", "signature").mapInArrow(tidy(_bands), "bucket long, node long"), "bands")
    heads = bands.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last")
    heads = stage(heads.select("bucket", "head"), "heads")
    star = bands.join(heads, "bucket").filter("node > head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    families = components(star).withColumnRenamed("root", "family")

    plain = classes.select("node", "doc_id", "mark", "one", "two", "n_shingles")
    members = stage(families.join(plain, "node"), "members")
    units = _units(members.select("node", "family", "n_shingles"), percent)
    asked = members.join(units, "node").select("node", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "one", "two", "units")
    asked = stage(asked, "asked")
    # A text is asked for by its id and its mark, or the rows of one id, or of none, would all meet.
    texts = likely_in(docs, "mark", asked.select(F.col("_mark").alias("mark")))
    texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    unit = "struct<family: long, sizes: long, low: int, high: int, block: int>"
    payload = texts.mapInArrow(tidy(_payload), f"node long, units array<{unit}>, signature binary, shingles binary")
    payload = payload.withColumn("unit", F.explode("units")).select("unit.*", "node", "signature", "shingles")
    key = ["family", "sizes", "low", "high"]
    worked = payload.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_links(percent, miss)), "a long, b long")
    rooted = classes.select("node", "one", "two", "n_shingles", "doc_id").join(components(worked), "node", "left")
    return sets, rooted.withColumn("root", F.coalesce("root", "node"))


def keep_one(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """``documents`` with one row of each component; all columns stay.

    The row with the smallest id stays, one without an id only where none has one; of several texts under that id one
    stays, and of several rows with one id and text any one. Rows without words all stay.
    """
    sets, rooted = _rooted(documents, id_col, text_col, percent, miss)
    of_set = rooted.select("one", "two", "n_shingles", "root")
    rows = sets.select("doc_id", "mark", "one", "two", "n_shingles").join(of_set, ["one", "two", "n_shingles"])
    rows = stage(rows.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies")), "rows")
    first = rows.groupBy("root").agg(_first())
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    told = rows.join(first, "root").select("doc_id", "mark", other.alias("goes"), "copies").filter("goes or copies > 1")
    told = stage(told.select(F.xxhash64("doc_id", "mark").alias("which"), F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "goes"), "told")
    own = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
    ).withColumn("which", F.xxhash64("doc_id", "mark"))
    # Only rows that may go, or are there several times, are moved.
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    asked = likely_in(own, "which", told).join(told.drop("which"), met, "left")
    single = asked.filter("goes is null").select("row")
    several = asked.filter("not goes").groupBy("doc_id", "mark").agg(F.any_value("row").alias("row")).select("row")
    kept = likely_in(own, "which", told, negate=True).select("row").unionByName(single).unionByName(several)
    return kept.select(*[F.col(f"row.`{c}`") for c in documents.columns])
