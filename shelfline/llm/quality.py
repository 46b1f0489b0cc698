"""Quality scores by a regularised quadratic discriminant over statistics of whole texts.

A task turns each text into a fixed number of transformed statistics. Spark sums, per label, the
rows, the statistics and their products; the driver gets those sums only (three small arrays a
label) and forms means and covariances, each shrunk towards the pooled covariance and its
diagonal. A score is the logistic of the difference of the two log densities, whose Mahalanobis
parts come from Cholesky factors computed once, plus the log odds of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Powers, Rolling, column, cut, docs_in, hash_words, likely_in, ship, word_spans, tidy

#: Statistics of a text, in this order.
STATISTICS = (
    "words", "bytes_per_word", "repeated_words", "repeated_pairs", "commonest_word", "capitals", "all_capital_words",
    "digits", "wide_bytes", "stops", "commas", "marks", "marked_words", "bars", "lines", "repeated_lines", "long_words",
)
#: Words of plain text that rates count besides the text's own.
PLAIN_WORDS = 20
#: Share of the pooled covariance in each label's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.5, 0.1
#: Rows whose crc32 of the id, modulo FOLDS, is HELD are never learnt from.
FOLDS, HELD = 3, 1

_U = np.uint64
_PAIRS, _LINES = Powers(0xE9846AF9B1A615D), Powers(0x9FB21C651E98DF25)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123))) + _class(bytes(range(128, 192)))
_CAPITALS, _DIGITS, _WIDE = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(bytes(range(128, 256)))
_STOPS, _COMMAS, _BARS, _NEWLINES = _class(b".?"), _class(b",;:"), _class(b"|"), _class(b"\n")
_MARKS = _class(bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,?;:'\"-()|")))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS per text of a slice."""
    starts, ends, first = word_spans(data, offsets)
    count = len(offsets) - 1
    words, size = np.diff(first).astype(float), np.diff(offsets).astype(float)
    # Rates count some plain text more than there is, so that a few words decide little.
    some_words, some_bytes = words + PLAIN_WORDS, size + 6 * PLAIN_WORDS

    def per_text(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def of_words(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return sums[ends] - sums[starts]

    def share_of_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[first[1:]] - sums[first[:-1]]) / some_words

    codes = hash_words(data, starts, ends, lower=True)
    pairs = Rolling(codes, _PAIRS).of(np.arange(max(len(codes) - 1, 0)), np.arange(2, max(len(codes) + 1, 2)))
    repeated_words, repeated_pairs, commonest, repeated = (np.zeros(count) for _ in range(4))
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1], breaks + 1, [len(data)])))
    line_code = Rolling(hash_bytes(data), _LINES).of(line_start[:-1], line_start[1:])
    line_of = np.searchsorted(line_start, offsets)
    for i in range(count):
        own = np.sort(codes[first[i] : first[i + 1]])
        n = len(own)
        if n:
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            repeated_words[i], commonest[i] = (n - len(edges) + 1) / (n + PLAIN_WORDS), np.diff(edges).max() / (n + PLAIN_WORDS)
        if n > 1:
            two = np.sort(pairs[first[i] : first[i + 1] - 1])
            repeated_pairs[i] = np.count_nonzero(two[1:] == two[:-1]) / (n + PLAIN_WORDS)
        lines = np.sort(line_code[line_of[i] : line_of[i + 1]])
        if len(lines) > 1:
            repeated[i] = np.count_nonzero(lines[1:] == lines[:-1]) / (len(lines) + 6)
    length = ends - starts
    marks, capitals = of_words(_MARKS), of_words(_CAPITALS)
    letters = per_text(_LETTERS) + 5 * PLAIN_WORDS
    return np.stack(
        [
            np.log1p(words),
            np.log((size + 6 * PLAIN_WORDS) / some_words),
            np.sqrt(repeated_words),
            np.sqrt(repeated_pairs),
            np.sqrt(commonest),
            np.sqrt(per_text(_CAPITALS) / letters),
            np.sqrt(share_of_words((capitals > 1) & (2 * capitals > length))),
            np.sqrt(per_text(_DIGITS) / some_bytes),
            np.sqrt(per_text(_WIDE) / some_bytes),
            np.sqrt(per_text(_STOPS) / some_words),
            np.sqrt(per_text(_COMMAS) / some_words),
            np.sqrt(per_text(_MARKS) / some_bytes),
            np.sqrt(share_of_words(marks > 0)),
            np.sqrt(per_text(_BARS) / some_words),
            np.log1p(words / (1 + per_text(_NEWLINES))),
            np.sqrt(repeated),
            np.sqrt(share_of_words(length > 12)),
        ],
        axis=1,
    )


def hash_bytes(data: np.ndarray) -> np.ndarray:
    return (data.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for start, stop, data, offsets in docs_in(column(batch, "text")):
            rows = statistics(data, offsets)
            at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [ids[start:stop], pa.ListArray.from_arrays(at, pa.array(rows.ravel()))], names=["doc_id", "statistics"]
            )


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), len(STATISTICS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label: number, sums and products of the statistics, as (label, place, value)."""
    size = len(STATISTICS)
    total = np.zeros((2, 1 + size + size * size))
    for batch in batches:
        rows, labels = _matrix(column(batch, "statistics")), np.asarray(column(batch, "quality"))
        for label in (0, 1):
            own = rows[labels == label]
            total[label] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    count = total.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], count)), pa.array(np.tile(np.arange(count), 2)), pa.array(total.ravel())], names=["label", "place", "value"]
    )


class Model:
    """Class means, Cholesky factors of the shrunk covariances, and log odds."""

    def __init__(self, sums: np.ndarray):
        size = len(STATISTICS)
        self.rows = sums[:, 0]
        self.parts = None
        if not self.rows.all():
            return
        means = sums[:, 1 : 1 + size] / self.rows[:, None]
        spread = [sums[k, 1 + size :].reshape(size, size) - self.rows[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = sum(spread) / self.rows.sum()
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(size)
        self.parts = []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - TO_POOLED) * spread[k] / self.rows[k] + TO_POOLED * pooled)
            # The inverse factor turns a distance into one product.
            self.parts.append((means[k], np.linalg.inv(factor).T, np.log(self.rows[k]) - np.log(np.diag(factor)).sum()))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the log density difference counts per statistic, for they are not independent."""
        if self.parts is None:
            return np.full(len(rows), (self.rows[1] + 1) / (self.rows.sum() + 2))
        logs = [constant - 0.5 * (((rows - mean) @ turn) ** 2).sum(axis=1) for mean, turn, constant in self.parts]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / len(STATISTICS), -700, 700)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def describe(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text, NULL as an empty one."""
    ship(documents.sparkSession)
    docs = cut(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(tidy(_describe), "doc_id long, statistics array<double>")


def labelled(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that may have a label, by a filter of fixed size; ``fit`` takes those that have one."""
    ids = cut(labels, _labelled=label_id).select(F.col("_labelled").cast("long"))
    return likely_in(documents.withColumn("_labelled", F.col(f"`{id_col}`").cast("long")), "_labelled", ids).drop("_labelled")


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from the labels 0 and 1 of rows that are not held out.

    A repeated label counts each time, any other label not at all. Without rows of both labels
    every text gets the same score, the smoothed share of label 1.
    """
    labels = cut(labels, doc_id=id_col, quality=label_col).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    labels = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sums = described.join(labels, "doc_id").select("quality", "statistics").mapInArrow(tidy(_sums), "label long, place long, value double")
    total = np.zeros((2, 1 + len(STATISTICS) + len(STATISTICS) ** 2))
    for label, place, value in sums.groupBy("label", "place").agg(F.sum("value")).collect():
        total[label, place] = value
    return Model(total)


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) for every row of ``describe``.

    Every text gets a score, an empty one too. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(column(batch, "statistics")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = described.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text is predicted to have label 1, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in docs_in(column(batch, "text")):
                good = pa.array(model.score(statistics(data, offsets)) >= 0.5)
                yield pa.RecordBatch.from_arrays([column(batch, "row")[start:stop].filter(good)], names=["row"])

    rows = documents.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.mapInArrow(tidy(run), rows.select("row").schema).select(*[F.col(f"row.`{c}`") for c in documents.columns])
