"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has HASHES functions floor((a.x + b) / w) with normal ``a``; their values name a bucket.
Every vector lies in one bucket of each of TABLES tables. A query visits its own bucket and those
that differ by one step in up to three values, in the order of estimated success: the smaller
the squared distances to the crossed bounds, the likelier a neighbour lies behind them. The
candidates of all tables are ranked again by exact distance.

Of equal vectors only as many take part as an answer can hold, those with the smallest ids, so a
vector that a third of the rows share is a few candidates. All lists on the way hold the nearest
ids, each with its nearest vector, and are cut by distance, then id. Buckets are sorted in ranges and cut into matrices, so a bucket of any
size is spread over tasks and every row of it is compared. A query that finds fewer
than it asks for is compared with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import Powers, Rolling, column, ship, stage, tidy
from shelfline.llm.topk import usable

TABLES, HASHES, PROBES = 8, 8, 60
#: Bucket width as a multiple of the vectors' root mean squared distance from their mean.
WIDTH = 2.5
STEPS = 3
#: Rows of a matrix; queries a task merges before it writes.
ROWS, HELD = 512, 20_000
SEED = 7

_CODES = Powers(0xB492B66FBE98F273)
_BUCKETED = "table int, bucket long, id long, vector array<double>"
_PACKED = "table int, bucket long, ids binary, vectors binary"


class Hashes:
    def __init__(self, width: int, scale: float):
        rng = np.random.default_rng([SEED, width])
        self.size = WIDTH * scale or 1.0
        self.turn = rng.standard_normal((TABLES, width, HASHES))
        self.shift = rng.uniform(0, 1, (TABLES, HASHES))

    def places(self, rows: np.ndarray, table: int) -> np.ndarray:
        return rows @ self.turn[table] / self.size + self.shift[table]

    @staticmethod
    def buckets(values: np.ndarray, width: int) -> np.ndarray:
        """A 64-bit name per row of hash values."""
        flat = np.concatenate((values, np.full((*values.shape[:-1], 1), width)), axis=-1).astype(np.int64).view(np.uint64).ravel()
        starts = np.arange(0, len(flat), HASHES + 1)
        return Rolling(flat + np.uint64(1 << 32), _CODES).of(starts, starts + HASHES + 1).view(np.int64)


def steps() -> np.ndarray:
    """All ways to move up to STEPS of the values by one."""
    out = [np.zeros(HASHES, np.int64)]
    for count in range(1, STEPS + 1):
        for places in combinations(range(HASHES), count):
            for signs in product((-1, 1), repeat=count):
                row = np.zeros(HASHES, np.int64)
                row[list(places)] = signs
                out.append(row)
    return np.array(out)


def probes(places: np.ndarray) -> np.ndarray:
    """(rows, PROBES, HASHES): the hash values each row visits, likeliest first."""
    ways, own = steps(), np.floor(places)
    below = places - own
    cost = (below**2) @ (ways == -1).T + ((1 - below) ** 2) @ (ways == 1).T
    order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
    return own[:, None, :].astype(np.int64) + ways[order]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) per width met in a batch."""
    vectors = column(batch, "vector")
    sizes, ids = vectors.value_lengths().to_numpy(), np.asarray(column(batch, "id"))
    flat = np.asarray(vectors.flatten(), np.float64)
    begins = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield ids[at], flat[begins[at][:, None] + np.arange(width)]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and squares per component of a task's vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, rows in _rows(batch):
            for place, values in enumerate(rows.T):
                total.setdefault(place, np.zeros(3))[:] += (len(values), values.sum(), (values * values).sum())
    found = np.array(list(total.values())).reshape(-1, 3)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *[pa.array(found[:, k]) for k in range(3)]], names=["place", "n", "sum", "squares"])


def _bucketed(scale: float, probing: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        for batch in batches:
            for ids, rows in _rows(batch):
                width = rows.shape[1]
                own = hashes.setdefault(width, Hashes(width, scale))
                for table in range(TABLES):
                    places = own.places(rows, table)
                    values = probes(places) if probing else np.floor(places).astype(np.int64)[:, None, :]
                    names = own.buckets(values, width)
                    yield _vectors(table, names, np.repeat(ids, values.shape[1]), np.repeat(rows, values.shape[1], axis=0))

    return run


def _vectors(table: int, names: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), table, np.int32)), pa.array(names), pa.array(ids), pa.ListArray.from_arrays(at, pa.array(rows.ravel()))],
        names=["table", "bucket", "id", "vector"],
    )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket as matrices of one bucket and one width each."""
    held, key = [], None

    def flush() -> tuple:
        ids, rows = zip(*held, strict=True)
        return (*key, np.array(ids, "<i8").tobytes(), np.concatenate(rows).astype("<f8").tobytes())

    for batch in batches:
        out = []
        tables, buckets, ids = (column(batch, c).to_pylist() for c in ("table", "bucket", "id"))
        vectors = column(batch, "vector")
        flat, ends = np.asarray(vectors.flatten(), np.float64), np.cumsum(vectors.value_lengths().to_numpy())
        for i, here in enumerate(zip(tables, buckets, strict=True)):
            width = ends[i] - (ends[i - 1] if i else 0)
            if held and (here != key or len(held) == ROWS or width != len(held[0][1])):
                out.append(flush())
                held = []
            key = here
            held.append((ids[i], flat[ends[i - 1] if i else 0 : ends[i]]))
        yield _matrix_batch(out)
    if held:
        yield _matrix_batch([flush()])


def _matrix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["table", "bucket", "ids", "vectors"])


def nearest(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, squares: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``count`` nearest ids, ties to the smaller; products preselect, differences decide.

    ``ids`` are sorted; one in several rows counts once, with its nearest. ``squares`` are the rows' squared lengths.
    """
    near = squares - 2 * (rows @ query)
    begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    if len(begins) > count:
        best = near if len(begins) == len(ids) else np.minimum.reduceat(near, begins)
        # Rows as near as the last place, and those that products cannot tell from it.
        error = 16 * (len(query) + 4) * np.finfo(float).eps * (squares.max() + query @ query)
        places = np.flatnonzero(~(near > np.partition(best, count - 1)[count - 1] + error))
        ids, rows = ids[places], rows[places]
    distance = np.sqrt(((rows - query) ** 2).sum(axis=1))
    begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    if len(begins) < len(ids):
        ids, distance = ids[begins], np.minimum.reduceat(distance, begins)
    order = np.lexsort((ids, distance))[:count]
    return ids[order], distance[order]


def _compare(count: int):
    """The nearest ids each query met in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, float]] = {}

        def flush() -> pa.RecordBatch:
            out = [(q, i, d) for q, found in held.items() for i, d in sorted(found.items(), key=lambda x: (x[1], x[0]))[:count]]
            columns = zip(*out, strict=True) if out else ([],) * 3
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                asked, ids = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                queries = np.frombuffer(row["query_vectors"], "<f8").reshape(len(asked), -1)
                rows = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                if queries.shape[1] != rows.shape[1]:
                    continue
                order = np.argsort(ids, kind="stable")
                ids, rows = ids[order], rows[order]
                squares = (rows * rows).sum(axis=1)
                for key, query in zip(asked.tolist(), queries, strict=True):
                    found = held.setdefault(key, {})
                    for i, d in zip(*(x.tolist() for x in nearest(query, ids, rows, squares, count)), strict=True):
                        if i not in found or d < found[i]:
                            found[i] = d
                    if len(found) > 8 * count:
                        held[key] = dict(sorted(found.items(), key=lambda x: (x[1], x[0]))[:count])
            if len(held) > HELD:
                yield flush()
                held = {}
        yield flush()

    return run


def _met(candidates: DataFrame, asked: DataFrame, count: int) -> DataFrame:
    """(query_id, id, score): the nearest of each query among the buckets it visits."""

    def cut(rows: DataFrame, label: str) -> DataFrame:
        order = ["table", "bucket", "id", F.xxhash64("vector")]  # an id may have many vectors
        return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_matrices), _PACKED), label)

    asked = cut(asked, "probes").select("table", "bucket", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    pairs = asked.join(cut(candidates, "buckets"), ["table", "bucket"])
    met = pairs.mapInArrow(tidy(_compare(count)), "query_id long, id long, score double")
    return met.groupBy("query_id", "id").agg(F.min("score").alias("score"))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for each query.

    Queries are the rows that ``is_query`` (over column ``id``) picks, candidates all rows with
    another id. Score is the Euclidean distance in doubles, nearest first, ties to the smaller
    id. Vectors that are NULL, all zero, hold NULL or a non-finite component, or have a NULL id take no
    part; only vectors of equal width are compared. Of several rows with a query's id the
    smallest vector asks; a candidate id in several rows counts once, with its nearest. An empty table
    gives an empty result; other columns are not looked at.
    """
    ship(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`")
    fine = usable(vector) & F.exists(vector, lambda x: x != 0)
    rows = vectors.filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("vector"))
    rows = stage(rows.filter("id is not null"), "vectors")

    # The smallest ids of each distinct vector: k besides the query's own are enough.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    firsts = stage(rows.distinct().withColumn("place", place).filter(F.col("place") <= k + 1), "firsts")
    asked = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = stage(asked, "queries")

    moments = firsts.filter("place = 1").select("id", "vector").mapInArrow(tidy(_moments), "place long, n double, sum double, squares double")
    moments = moments.groupBy("place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    spread = moments.agg(F.sum(F.expr("squares / n - sum / n * sum / n"))).first()[0]
    scale = float(max(spread or 0.0, 0.0)) ** 0.5
    plain = firsts.select("id", "vector")
    found = _met(plain.mapInArrow(tidy(_bucketed(scale, False)), _BUCKETED), asked.mapInArrow(tidy(_bucketed(scale, True)), _BUCKETED), k + 1)
    found = stage(found, "found")
    enough = stage(_ranked(found, k), "ranked")

    # Whoever found too few visits everything, dealt into buckets of a table of their own.
    few = asked.join(enough.filter(F.col("rank") == k), F.col("id") == F.col("query_id"), "left_anti")
    parts = max(1, -(-firsts.count() // (4 * ROWS)))
    dealt = plain.select(F.lit(TABLES).alias("table"), F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).alias("bucket"), "id", "vector")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("bucket")
    again = _met(dealt, few.select(F.lit(TABLES).alias("table"), everywhere, "id", "vector"), k + 1)
    rest = _ranked(again, k)
    return enough.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rows = found.filter("id != query_id").select("query_id", F.col("id").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
