"""Language of whole texts by a string kernel: n-grams present, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams of 1 to 3 that both hold, divided by the geometric mean of
the numbers each holds (A-Z as a-z, other ASCII as blanks). A bounded number of training texts are the landmarks,
the same share for each language. A task turns every text into its kernels with the landmarks, a product of two
presence matrices per batch of texts. The inverse root of the landmarks' own kernel makes features of
them; Spark adds up the features' products over all training rows, and the driver solves one ridge
regression per language against the rest from matrices as wide as there are landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import column, cut, docs_in, ship, tidy

#: Landmarks in all, at least LEAST of each language; texts of SHORT to LONG bytes are taken first, then the nearest above.
LANDMARKS, LEAST, SHORT, LONG = 128, 4, 400, 4096
#: Ridge on the mean product of features; eigenvalues of the landmarks' kernel below this share of the largest are left out.
RIDGE, NOTHING = 1e-4, 1e-6
#: How far apart the regressions' answers count in the score.
SHARPNESS = 4.0
#: Rows of a batch's presence matrix, and its entries at most.
ROWS, ENTRIES = 256, 1 << 23
#: Bytes of a text worked on at once.
CHUNK = 1 << 20
#: Rows whose crc32 of the id, modulo FOLDS, is HELD are never learnt from.
FOLDS, HELD = 5, 0
UNDETERMINED = "und"

#: A-Z as a-z, other ASCII as blanks, the rest as it is; numbered from 1, for 0 means that an n-gram is shorter.
_SYMBOL = np.ones(256, np.int32)
_SYMBOL[97:123] = np.arange(2, 28)
_SYMBOL[65:91] = np.arange(2, 28)
_SYMBOL[128:] = np.arange(28, 156)
_BASE = 156
GRAMS = _BASE**3


class Presence:
    """Distinct n-grams of one text after the other; two tables of GRAMS numbers instead of a sort."""

    def __init__(self):
        self.text, self.last = np.zeros(GRAMS, np.int32), np.zeros(GRAMS, np.int32)
        self.number = 0

    def of(self, data: np.ndarray) -> np.ndarray:
        self.number += 1
        found = [np.zeros(0, np.int32)]
        for at in range(0, len(data), CHUNK):
            symbols = _SYMBOL[data[max(at - 2, 0) : at + CHUNK]]
            one = symbols * (_BASE * _BASE)
            two = one[:-1] + symbols[1:] * _BASE
            for codes in (one, two, two[:-1] + symbols[2:]):
                codes = codes[self.text[codes] != self.number]
                places = np.arange(len(codes), dtype=np.int32)
                self.last[codes] = places  # of equal codes one place stays
                codes = codes[self.last[codes] == places]
                self.text[codes] = self.number
                found.append(codes)
        return np.concatenate(found)


class Landmarks:
    """Landmark texts as a presence matrix over the n-grams that any of them holds."""

    def __init__(self, texts: list[str]):
        presence = Presence()
        held = [presence.of(np.frombuffer(t.encode(), np.uint8)) for t in texts]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int32), *held]))
        self.sizes = np.array([max(len(h), 1) for h in held], np.float32)
        self.matrix = np.zeros((len(self.grams), len(texts)), np.uint8)
        for i, own in enumerate(held):
            self.matrix[np.searchsorted(self.grams, own), i] = 1
        values, vectors = np.linalg.eigh(self._between())
        kept = values > NOTHING * max(values.max(initial=0), 1e-300)
        #: Turns kernels with the landmarks into features whose products are the kernel, as far as landmarks can tell.
        self.turn = vectors[:, kept] / np.sqrt(values[kept])

    def _between(self) -> np.ndarray:
        own = self.matrix.astype(np.float32)
        return (own.T @ own / np.sqrt(np.outer(self.sizes, self.sizes))).astype(float)

    def kernels(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last + 1, a row of kernels per text) for all texts, whole; NULL is an empty one."""
        column_of = np.full(GRAMS, -1, np.int32)
        column_of[self.grams] = np.arange(len(self.grams))
        matrix, presence = self.matrix.astype(np.float32), Presence()
        rows = max(1, min(ROWS, ENTRIES // max(len(self.grams), 1)))
        table = np.zeros((rows, len(self.grams)), np.float32)
        for first, last, data, offsets in docs_in(texts):
            for at in range(first, last, rows):
                count = min(rows, last - at)
                table[:count] = 0
                sizes = np.ones(count, np.float32)
                for i in range(count):
                    k = at - first + i
                    grams = presence.of(data[offsets[k] : offsets[k + 1]])
                    sizes[i] = max(len(grams), 1)
                    known = column_of[grams]
                    table[i, known[known >= 0]] = 1
                yield at, at + count, table[:count] @ matrix / np.sqrt(sizes[:, None] * self.sizes)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _rows(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    docs = cut(documents, doc_id=id_col, text=text_col, lang=lang_col)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), has_letter(F.col("text")).alias("letters"))
    return docs.withColumn("learn", F.col("letters") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def landmarks(documents: DataFrame, count: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Landmarks:
    """About ``count`` different texts to learn from, the same number for each language, in the order of their hashes.

    Only ids of texts are ranked; the chosen texts themselves, and one number per language, reach the driver.
    """
    rows = _rows(documents, id_col, text_col, lang_col).filter("learn")
    size = F.octet_length("text")
    marks = rows.select("lang", F.xxhash64("text").alias("mark"), F.when(size.between(SHORT, LONG), 0).when(size > LONG, size).otherwise(2**31 - size).alias("far"))
    each = max(LEAST, -(-count // max(marks.select("lang").distinct().count(), 1)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("far", "mark"))
    chosen = marks.groupBy("lang", "mark", "far").agg(F.lit(1)).withColumn("place", place).filter(F.col("place") <= each)
    texts = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(chosen.select("lang", "mark")), ["lang", "mark"]).select("lang", "mark", "text")
    return Landmarks([r.text for r in texts.dropDuplicates(["lang", "mark"]).orderBy("lang", "mark").collect()])


def describe(documents: DataFrame, marks: Landmarks, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, letters (is there one), learn (is it a training row) and the kernels with the landmarks of every text."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "lang", "letters", "learn"]
            for first, last, rows in shared.value.kernels(column(batch, "text")):
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                lists = pa.ListArray.from_arrays(at, pa.array(rows.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*(column(batch, n)[first:last] for n in names), lists], names=[*names, "kernels"])

    docs = _rows(documents, id_col, text_col, lang_col)
    return docs.mapInArrow(tidy(run), "doc_id long, lang string, letters boolean, learn boolean, kernels array<float>")


def _features(batch: pa.RecordBatch, turn: np.ndarray) -> np.ndarray:
    """Features of a batch of ``describe``, and a constant one."""
    rows = np.asarray(column(batch, "kernels").flatten(), np.float64).reshape(batch.num_rows, len(turn))
    return np.concatenate((rows @ turn, np.ones((batch.num_rows, 1))), axis=1)


class Model:
    """Weights per language, learnt from the features' products and their sums per language."""

    def __init__(self, products: np.ndarray, sums: dict[str, np.ndarray], turn: np.ndarray):
        self.turn, self.languages = turn, sorted(sums)
        self.weights = None
        if self.languages:
            rows = sum(s[-1] for s in sums.values())
            every = sum(sums.values())
            answers = np.stack([2 * sums[lang] - every for lang in self.languages], axis=1)  # 1 for the language, -1 for the rest
            self.weights = np.linalg.solve(products / rows + RIDGE * np.eye(len(products)), answers / rows)

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language, score) per row."""
        answers = SHARPNESS * (features @ self.weights)
        shares = np.exp(answers - answers.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        found = shares.argmax(axis=1)
        return found, shares[np.arange(len(found)), found]


def fit(described: DataFrame, marks: Landmarks) -> Model:
    """Learn from all training rows of ``describe``."""
    turn = marks.turn
    size = turn.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), {}
        for batch in batches:
            features, codes = _features(batch, turn), column(batch, "lang").dictionary_encode()
            products += features.T @ features
            which = codes.indices.to_numpy()
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                sums[lang] = sums.get(lang, 0) + features[which == i].sum(axis=0)
        if sums:
            langs = [None] * size**2 + [lang for lang in sums for _ in range(size)]
            places = np.concatenate((np.arange(size**2), np.tile(np.arange(size), len(sums))))
            values = np.concatenate((products.ravel(), *sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places), pa.array(values)], names=["lang", "place", "value"])

    found = described.filter("learn").select("lang", "kernels").mapInArrow(tidy(run), "lang string, place long, value double")
    products, sums = np.zeros(size**2), {}
    for lang, place, value in found.groupBy("lang", "place").agg(F.sum("value")).collect():
        (products if lang is None else sums.setdefault(lang, np.zeros(size)))[place] = value
    return Model(products.reshape(size, size), sums, turn)


def predict(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of ``describe``.

    A NULL text or one without a letter is UNDETERMINED with score 0, and so is every text if there was nothing
    to learn from; ties go to the first language in order of code points. With one language the score is 1. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            sure = column(batch, "letters").to_numpy(zero_copy_only=False).astype(bool)
            places, scores = np.full(len(sure), len(model.languages)), np.zeros(len(sure))
            if model.weights is not None:
                found, values = model.predict(_features(batch, model.turn))
                places, scores = np.where(sure, found, places), np.where(sure, values, 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names[places], pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    told = described.select("doc_id", "letters", "kernels").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
