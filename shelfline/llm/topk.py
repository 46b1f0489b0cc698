"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(scale * x), and scores are inner products. Tasks pack the
candidates into tiles and the queries into blocks, each a matrix in one row. Tiles and blocks are
dealt into groups, and every group of tiles meets every group of blocks in a cell of its own. In
a cell each tile is multiplied with each block, the best of a tile are selected and merged with
those of the tiles before; the lists of the cells are merged in a tree, FAN at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import column, ship, stage, tidy

SCALE = 1024
#: Queries of a block, candidates of a tile, blocks or tiles of a group, lists merged at once.
BLOCK, TILE, GROUP, FAN = 1024, 2048, 4, 16
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)
#: Score range of the result.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_PACKED = "number long, width int, ids binary, values binary"
_KINDS = pa.schema([("number", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def packed(rows: int):
    """Vectors (id, vector) of one width as matrices of at most ``rows`` rows, numbered per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, {}

        def flush(width: int) -> pa.RecordBatch:
            nonlocal number
            ids, values = zip(*held.pop(width), strict=True)
            number += 1
            row = [(number, width, np.array(ids, "<i8").tobytes(), np.array(values, "<f8").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*row, strict=True), _KINDS, strict=True)], schema=_KINDS)

        for batch in batches:
            ids, vectors = column(batch, "id").to_pylist(), column(batch, "vector")
            flat, offsets = np.asarray(vectors.flatten(), np.float64), np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy())))
            for i, key in enumerate(ids):
                row = flat[offsets[i] : offsets[i + 1]]
                mine = held.setdefault(len(row), [])
                mine.append((key, row))
                if len(mine) == rows:
                    yield flush(len(row))
        for width in list(held):
            yield flush(width)

    return run


def matrix(ids: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(values, "<f8").reshape(len(found), width)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every partial sum is exact, else in Python integers."""
    reach = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(tile).max(initial=0)
    if reach < EXACT:
        return (queries @ tile.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in queries], object), np.array([[int(x) for x in r] for r in tile], object)
    return np.clip(whole[0].dot(whole[1].T), LEAST, MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], np.invert(scores[places])))[:k]]


def _cells(k: int):
    """Per cell the best of its tiles for each query of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = {}, None

        def flush() -> pa.RecordBatch:
            out = [(q, int(i), int(s), cell[0]) for q, (ids, scores) in held.items() for i, s in zip(ids, scores, strict=True)]
            columns = zip(*out, strict=True) if out else ([],) * 4
            names = ["query_id", "vec_id", "score", "part"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["part"], row["block_part"], row["width"])
                if cell != here:
                    if cell:
                        yield flush()
                    held, cell = {}, here
                queries, q = matrix(row["query_ids"], row["query_values"], row["width"])
                ids, tile = matrix(row["ids"], row["values"], row["width"])
                scores = products(q, tile)
                for i, key in enumerate(queries.tolist()):
                    own = ids != key
                    s, c = scores[i][own], ids[own]
                    top = best(s, c, k)
                    s, c = s[top], c[top]
                    if key in held:
                        s, c = np.concatenate((held[key][1], s)), np.concatenate((held[key][0], c))
                        top = best(s, c, k)
                        s, c = s[top], c[top]
                    held[key] = (c, s)
        if cell:
            yield flush()

    return run


def cells(blocks: DataFrame, tiles: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(every pair of a block and a tile of one width, the number of tile groups).

    Both are staged matrices; a group has GROUP of them on average, so a cell stays small
    whatever the tables hold.
    """
    groups, block_groups = (max(1, -(-df.count() // GROUP)) for df in (tiles, blocks))
    every = [F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) for n in (groups, block_groups)]
    mine = [F.pmod(F.xxhash64("number"), F.lit(n)) for n in (groups, block_groups)]
    blocks = blocks.withColumns({"block_part": mine[1], "part": F.explode(every[0])})
    blocks = blocks.select("part", "block_part", "width", F.col("ids").alias("query_ids"), F.col("values").alias("query_values"))
    tiles = tiles.withColumns({"part": mine[0], "block_part": F.explode(every[1])}).drop("number")
    return blocks.join(tiles, ["part", "block_part", "width"]).select(*columns), groups


def merged(lists: DataFrame, k: int, order: list[Column], parts: int) -> DataFrame:
    """The first k of each query over all its lists; lists carry ``part``, a number below ``parts``."""
    while parts > FAN:
        parts = -(-parts // FAN)
        window = Window.partitionBy("query_id", "part").orderBy(*order)
        lists = lists.withColumn("part", F.pmod("part", F.lit(parts))).withColumn("rank", F.row_number().over(window))
        lists = lists.filter(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest scores of each query.

    Queries are the rows that ``is_query`` (over column ``id``) picks, candidates all rows with
    another id. Ties go to the smaller id; with fewer candidates all come. Vectors that are NULL,
    hold NULL or a non-finite component, or have a NULL id take no part; only vectors of equal
    width are compared. Repeated rows are candidates each; of several rows with a query's id the
    smallest vector asks, and none of them is its candidate. A score beyond 64 bits stays at the limit. An empty
    table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("vector"))
    rows = rows.filter("id is not null")
    tiles = stage(rows.mapInArrow(tidy(packed(TILE)), _PACKED), "tiles")
    asked = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = stage(asked.mapInArrow(tidy(packed(BLOCK)), _PACKED), "blocks")
    pairs, groups = cells(blocks, tiles, ["part", "block_part", "width", "query_ids", "query_values", "ids", "values"])
    lists = pairs.mapInArrow(tidy(_cells(k)), "query_id long, vec_id long, score long, part long")
    order = [F.col("score").desc(), F.col("vec_id")]
    return merged(lists, k, order, groups).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
