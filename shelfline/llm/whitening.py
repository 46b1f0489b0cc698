"""Whitening of embeddings by shifted Cholesky QR.

Vectors become integers x; their number n and sums S are exact, so a centred row is n * x - S in integers,
divided by n only then. A Gram pass takes every task's rows through the triangular factors found so far and
lets Spark add the tasks' products up; the driver gets one matrix as wide as a vector and its Cholesky factor is
the next factor. The first pass shifts the Gram matrix, so that its factor exists however ill
conditioned the rows are; passes go on until the rows come out orthonormal. The product R of the factors
has the singular values and right vectors of the centred table, without its square's loss of digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import column, cut, ship, tidy
from shelfline.llm.topk import usable

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Gram passes at most, and how far from orthonormal they may end.
PASSES, ORTHONORMAL = 6, 1e-13
#: Share of the largest variance below which a component has none.
NOTHING = 1e-24
#: Entries are kept within this size, exact as doubles; rows worked on at once.
LARGEST, ROWS = 1 << 52, 4096
MOST = (1 << 63) - 1

Run = Callable[[np.ndarray], np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int, offset: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = np.asarray(column(part, "vector").flatten(), np.float64).reshape(-1, width)
            yield column(part, "id"), np.clip(np.floor(scale * flat) + offset, -LARGEST, LARGEST).astype(np.int64)


class Centre:
    """Number of rows and their exact sums."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers, or Python's where those might not do."""
        rough = np.abs(float(self.n) * x - np.array(self.sums, float))
        if rough.max(initial=0) < 1 << 62:  # sums that wrap around on the way still end right
            wrapped = np.array([s & 0xFFFFFFFFFFFFFFFF for s in self.sums], np.uint64)
            return (x.astype(np.uint64) * np.uint64(self.n) - wrapped).view(np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Sum of squared deviations per row; beyond 64 bits the largest number they hold."""
        deviations = self.deviations(x)
        with np.errstate(over="ignore"):
            out = (deviations.astype(np.int64) ** 2).sum(axis=1) if deviations.dtype != object else np.zeros(len(x), np.int64)
        for i in np.flatnonzero((deviations.astype(float) ** 2).sum(axis=1) > float(MOST) / 2):
            out[i] = min(sum(int(v) ** 2 for v in deviations[i]), MOST)
        return out


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows * inverse(factor), for an upper triangular factor, column by column."""
    out = np.empty_like(rows, order="F")
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _summed(df: DataFrame, width: int, scale: int, offset: int, size: int, of: Run) -> np.ndarray:
    """The sum over all rows' blocks of ``of``, which gives ``size`` numbers; one row per number and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, width, scale, offset):
            more = of(x).ravel()
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    kind = "bigint" if size == 2 * width + 1 else "double"
    found = np.zeros(size, np.int64 if kind == "bigint" else float)
    for place, value in df.mapInArrow(tidy(run), f"place long, value {kind}").groupBy("place").agg(F.sum("value")).collect():
        found[place] = value
    return found


def _halves(x: np.ndarray) -> np.ndarray:
    """Number of rows, then sums of the upper and of the lower 32 bits: none can overflow."""
    return np.concatenate(([len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))


class Whitening:
    """Components of a table of vectors: unit vectors, their variances and shares, and how far from the identity it all ends."""

    def __init__(self, centre: Centre, directions: np.ndarray, variances: np.ndarray, explained: np.ndarray):
        self.centre, self.directions, self.variances, self.explained = centre, directions, variances, explained
        self.identity_error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.directions / np.sqrt(self.variances)


def _factor(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted if asked to, or if there is none without."""
    width = len(gram)
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    unit = np.finfo(float).eps / 2
    push = 11 * (rows * width + width * (width + 1)) * unit * max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + push * np.eye(width)).T
        except np.linalg.LinAlgError:
            push *= 10


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(usable rows (id, vector) of the commonest width, that width; 0 without rows)."""
    rows = cut(vectors, id=id_col, vector=vector_col).select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).filter(usable(F.col("vector")))
    widths = rows.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    width = widths[0].width if widths else 0
    return rows.filter(F.size("vector") == width), width


def _fit(rows: DataFrame, width: int, components: int, scale: int, offset: int) -> Whitening | None:
    halves = _summed(rows, width, scale, offset, 2 * width + 1, _halves)
    n = int(halves[0])
    centre = Centre(n, [(int(high) << 32) + int(low) for high, low in zip(halves[1 : 1 + width], halves[1 + width :], strict=True)])
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        out = centre.rows(x)
        for factor in factors:
            out = solved(out, factor)
        return out.T @ out

    for turn in range(PASSES):
        found = _summed(rows, width, scale, offset, width * width, gram).reshape(width, width)
        if turn == 0 and not found.any():
            return None  # all rows are equal
        if turn and np.abs(found - np.eye(width)).max() <= ORTHONORMAL * width:
            break
        factors.append(_factor(found, n, shift=turn == 0))
    whole = np.eye(width)
    for factor in factors:
        whole = factor @ whole
    _, spread, directions = np.linalg.svd(whole)
    variances = spread**2 / n
    kept = np.flatnonzero(variances > NOTHING * variances[0])[:components]
    directions = directions[kept].T
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(kept))])
    model = Whitening(centre, directions, variances[kept], variances[kept] / variances.sum())
    size = len(kept)

    def products(x: np.ndarray) -> np.ndarray:
        own = model.apply(x)
        return np.concatenate((own.sum(axis=0), (own.T @ own).ravel()))

    sums = _summed(rows, width, scale, offset, size + size * size, products) / n
    covariance = sums[size:].reshape(size, size) - np.outer(sums[:size], sums[:size])
    model.identity_error = float(np.abs(covariance - np.eye(size)).max())
    return model


def fit(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE, offset: int = OFFSET
) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none, or all are equal."""
    ship(vectors.sparkSession)
    rows, width = _vectors(vectors, id_col, vector_col)
    return _fit(rows, width, components, scale, offset) if width else None


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Entries are floor(scale * c) + offset, kept within 2 ** 52 in size. Vectors that are NULL or empty or hold NULL or
    a non-finite entry take no part, nor those of another width than the commonest (the smaller of two equally common).
    Repeated rows count each time; a NULL id stays NULL. Components without variance are left out, so equal rows
    give none. A deviation beyond 64 bits is the largest such number. An empty table gives an empty result; other
    columns are not looked at. The table is read once per pass, some seven times; what reaches the driver is
    a matrix as wide as a vector.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, width = _vectors(vectors, id_col, vector_col)
    model = _fit(rows, width, components, scale, offset) if width else None
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.variances)
        for ids, x in _blocks(batches, width, scale, offset):
            count = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(count), size))),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, model.centre.n)),
                    pa.array(np.repeat(model.centre.squares(x), size)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * size, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidy(run), schema)
