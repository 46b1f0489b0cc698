"""Exact ranked search over impact lists, stopped by the best positions seen.

Tasks turn their documents into shards: per term that some item asks for, the documents that hold it
and how often. Over all shards Spark sums the number of documents, of terms and of documents per
term. Then each shard sorts a term's documents by impact and every item runs the Best Position
Algorithm over its terms' lists: it reads on in all lists at once, fetches a new document's impacts
from the other lists directly, marks the places at which they stand there, and knows, per list, up
to which place all have been seen. No document still unseen can score more than the sum of the
impacts at these best positions; the search ends when that lies strictly below the kth score, so ties
are complete. An item's lists of the shards are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import column, cut, docs_in, hash_words, ship, stage, tidy, word_spans
from shelfline.llm.topk import best, merged

#: A shard ends at so many documents or postings; a document is never divided.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Items of a block; shards of a group on average; positions read of each list at first.
BLOCK, GROUP, STEP = 256, 8, 32
#: Items whose best documents a task holds before it hands them on.
HELD = 1 << 16
#: Bits of the filter of asked terms: 1 MB whatever the items hold. Terms it lets through needlessly are never looked up.
_PART_BITS, _PARTS = 1 << 15, 256

_GAPS = np.ones(256, bool)
_GAPS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
_GAPS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SHARDS = "shard long, length long, ids binary, named binary, lengths binary, terms array<string>, sizes array<long>, docs binary, times binary"
_FOUND = "query_id long, vec_id long, score long, part long"


def terms_in(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first, last + 1, distinct terms, which of them each term is, number of terms per text) per slice of texts."""
    for first, last, data, offsets in docs_in(texts):
        data = _LOWER[data]
        starts, ends, words = word_spans(data, offsets, _GAPS)
        at = np.concatenate(([0], np.cumsum(ends - starts)))
        flat = np.ascontiguousarray(data[~_GAPS[data]])
        array = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
        yield first, last, array.dictionary, array.indices.to_numpy(), np.diff(words)


def _slots(terms: pa.Array) -> np.ndarray:
    """A place in the filter per term."""
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(terms) + 1, terms.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (hash_words(data, offsets[:-1], offsets[1:]) % np.uint64(_PART_BITS * _PARTS)).astype(np.int64)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, how often, place in the filter)."""
    for batch in batches:
        items = column(batch, "item")
        for first, last, terms, codes, counts in terms_in(column(batch, "text")):
            of = np.repeat(np.arange(last - first), counts)
            keys, times = np.unique(of * len(terms) + codes, return_counts=True) if len(codes) else (np.zeros(0, np.int64),) * 2
            which = keys % max(len(terms), 1)
            columns = [items[first:last].take(pa.array(keys // max(len(terms), 1))), terms.take(pa.array(which)).cast(pa.string())]
            slots = _slots(terms)[which] if len(terms) else which
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times), pa.array(slots)], names=["item", "term", "times", "slot"])


def _filter(asked: DataFrame) -> np.ndarray:
    part, bit = (F.col("slot") / _PART_BITS).cast("int"), F.pmod("slot", F.lit(_PART_BITS))
    rows = asked.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    bits = np.zeros((_PARTS, _PART_BITS // 8), np.uint8)
    for row in rows:  # at most _PARTS rows of 4 KB
        bits[row.part] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def _index(bits: np.ndarray):
    """Shards of the documents (doc_id, text) of a task; documents without a term count nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        known, ids, named, lengths, held = {}, [], [], [], []
        count = postings = 0

        def flush() -> pa.RecordBatch:
            term, doc, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, term))
            sizes = np.bincount(term, minlength=len(known))
            mine = np.concatenate(lengths)
            row = [
                number, int(mine.sum()), np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(named).astype("u1").tobytes(), mine.astype("<i8").tobytes(),
                list(known), sizes.tolist(), doc[order].astype("<i4").tobytes(), times[order].astype("<i4").tobytes(),
            ]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["shard", "length", "ids", "named", "lengths", "terms", "sizes", "docs", "times"]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            keys = column(batch, "doc_id")
            for first, last, terms, codes, counts in terms_in(column(batch, "text")):
                some = counts > 0
                if not some.any():
                    continue
                slots = _slots(terms)
                asked = (bits[slots >> 3] >> (slots & 7) & 1).astype(bool)
                of = np.repeat(np.arange(int(some.sum())), counts[some])
                keep = asked[codes]
                pairs, times = np.unique(codes[keep].astype(np.int64) * (last - first) + of[keep], return_counts=True)
                which = np.flatnonzero(asked)
                place = np.zeros(len(terms), np.int64)
                place[which] = [known.setdefault(t, len(known)) for t in terms.take(pa.array(which)).to_pylist()]
                held.append((place[pairs // (last - first)], pairs % (last - first) + count, times))
                here = keys[first:last].filter(pa.array(some))
                ids.append(here.fill_null(0).to_numpy())
                named.append(here.is_valid().to_numpy(zero_copy_only=False))
                lengths.append(counts[some])
                count, postings = count + int(some.sum()), postings + len(pairs)
                if count >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield flush()
                    number += 1
                    known, ids, named, lengths, held = {}, [], [], [], []
                    count = postings = 0
        if count:
            yield flush()

    return run


class Shard:
    """The lists of a shard, by document and by impact."""

    def __init__(self, row: dict, documents: int, length: int):
        self.ids, named, n = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], "u1"), np.frombuffer(row["lengths"], "<i8")
        self.docs, times = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
        self.list_of = {term: i for i, term in enumerate(row["terms"])}
        sizes = np.array(row["sizes"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        m = 25 + (75 * n * documents) // length
        impact = (1_000_000_000 * times) // (1000 * times + 8 * m[self.docs])
        impact[named[self.docs] == 0] = 0  # a document without an id counts, but is never found
        self.impact = impact.astype(np.int32)  # a million at most
        order = np.lexsort((-self.impact, np.repeat(np.arange(len(sizes)), sizes)))
        self.ranked_docs, self.ranked = self.docs[order], self.impact[order]
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order)) - np.repeat(self.starts[:-1], sizes)

    def search(self, terms: list[str], weights: list[int], k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids, documents looked at) of the ``k`` best, those given included; ``weights`` hold a term's weight times its repeats."""
        lists = [(self.list_of[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in self.list_of]
        spans = [(int(self.starts[i]), int(self.starts[i + 1]), w) for i, w in lists]
        seen = [np.zeros(end - start, bool) for start, end, _ in spans]
        reached = [0] * len(spans)  # the best positions: all before have been seen
        bound = sum(w * int(self.ranked[start]) for start, _, w in spans)
        met = np.zeros(len(self.ids), bool)
        step, looked = STEP, 0
        while bound > 0 and (len(scores) < k or bound >= scores[-1]):
            new = [self.ranked_docs[start + at : min(start + at + step, end)] for (start, end, _), at in zip(spans, reached, strict=True)]
            new = np.unique(np.concatenate(new))
            new = new[~met[new]]
            met[new] = True
            looked += len(new)
            total = np.zeros(len(new), np.int64)
            bound = 0
            for j, (start, end, w) in enumerate(spans):
                own = self.docs[start:end]
                at = np.searchsorted(own, new)
                at[at == len(own)] = 0
                hit = np.flatnonzero(own[at] == new)
                found = start + at[hit]
                total[hit] += w * self.impact[found].astype(np.int64)
                seen[j][self.place[found]] = True
                rest = seen[j][reached[j] :]
                if len(rest):
                    gap = int(rest.argmin())
                    reached[j] += len(rest) if rest[gap] else gap
                if reached[j] < end - start:
                    bound += w * int(self.ranked[start + max(reached[j], 1) - 1])
            good = total > 0
            if len(scores) >= k:
                good &= total >= scores[-1]
            scores, ids = np.concatenate((scores, total[good])), np.concatenate((ids, self.ids[new[good]]))
            top = best(scores, ids, k)
            scores, ids = scores[top], ids[top]
            step *= 2
        return scores, ids, looked


_NONE = np.zeros(0, np.int64)


def _search(documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, shard = {}, None, None
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            sizes = [len(scores) for scores, _ in held.values()]
            columns = [np.repeat(np.array(list(held), np.int64), sizes), *(np.concatenate([_NONE, *(x[i] for x in held.values())]) for i in (1, 0))]
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(sum(sizes), part))], names=["query_id", "vec_id", "score", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != number:
                    number, shard = row["shard"], Shard(row, documents, length)
                for item in row["items"]:
                    held[item["item"]] = shard.search(item["terms"], item["weights"], k, *held.get(item["item"], (_NONE, _NONE)))[:2]
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return run


def ranked(
    documents: DataFrame, items: DataFrame, k: int = 10, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents with the highest scores above 0 for each item.

    A term is a run of letters, digits and characters beyond ASCII, with A-Z in lower case; the score is the
    integer BM25 of the package's contract, with counts over all documents. Ties go to the smaller id. Each
    row of ``documents`` is a document, repeated ones too; one with a NULL id counts and is not found; NULL
    and empty texts have no terms. An item with a NULL id or without terms finds nothing; of several rows with an
    item's id the smallest text asks. Empty tables give an empty result; other columns are not looked at.
    """
    spark = documents.sparkSession
    ship(spark)
    asking = cut(items, item=item_id, text=item_text).select(F.col("item").cast("long"), "text").filter("item is not null")
    asking = asking.groupBy("item").agg(F.min("text").alias("text"))
    asked = stage(asking.mapInArrow(tidy(_ask), "item long, term string, times long, slot long"), "asked")
    docs = cut(documents, doc_id=doc_id, text=doc_text).select(F.col("doc_id").cast("long"), "text")
    shards = stage(docs.mapInArrow(tidy(_index(_filter(asked))), _SHARDS), "shards")
    total, length, pieces = shards.agg(F.sum(F.length("named")), F.sum("length"), F.count(F.lit(1))).first()
    names = {"query_id": "item_id", "vec_id": "doc_id"}
    if not pieces:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    having = every.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("having"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("having") + 1))).cast("long")
    weighed = asked.join(having, "term").select("item", "term", (F.col("times") * weight).alias("weight"))
    one = F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x")  # the distinct terms of one text
    whole = stage(weighed.groupBy("item").agg(one).select(F.struct("item", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")).alias("one")), "items")
    blocks, groups = -(-whole.count() // BLOCK), -(-pieces // GROUP)
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Every block of items meets every shard: groups of shards and blocks are dealt out, none is a key of many rows.
    block = F.pmod(F.xxhash64("one.item"), F.lit(blocks)).alias("block")
    packed = whole.groupBy(block).agg(F.collect_list("one").alias("items")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    spread = shards.withColumns({"group": F.pmod(F.xxhash64("shard"), F.lit(groups)), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    met = spread.join(packed, ["group", "block"]).drop("group", "block", "length")
    lists = met.mapInArrow(tidy(_search(total, length, k)), _FOUND)
    found = merged(lists, k, [F.col("score").desc(), F.col("vec_id")], pieces)
    return found.withColumnsRenamed(names).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS (SELECT doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL) WHERE len(terms) > 0),
sums AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), sums),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), sums GROUP BY item_id, doc_id),
places AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 10
"""
