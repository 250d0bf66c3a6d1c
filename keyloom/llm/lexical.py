"""Ranked lexical search by sort-based accumulation.

The documents' postings for the items' terms are written once, read back range
by range of document ids, and matched with the items: for a chunk of documents
the matched (item, document, impact) arrays are concatenated, their packed keys
radix sorted and the impacts of one key summed (``reduceat``). A task keeps a
heap of the best of each item and hands on no more than that.

What a task holds doesn't grow with the table: a chunk has ``MATCHES`` matches
at most (or those of one document), and the items come in blocks of ``BLOCK``
terms (or one item's), of which each block's passage over the documents is one
search. A block is all that reaches the driver and is broadcast.

- A document without a term (null and empty texts too) counts nowhere.
- A row is a document: repeated rows rank beside each other.
- A document whose id is null takes no part, nor does an item whose id is null.
- Rows with one item id are one item with the terms of all of them.
- An item without a term, or whose terms no document has, has no rows.
- Empty tables give no rows. Only the named columns are read, so others may
  have any names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from keyloom.llm.common import lower_ascii, materialize

#: A term, in texts of which only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms that a block of items has at most, if it has more than one item.
BLOCK = 1 << 18
#: Matches that are sorted at a time.
MATCHES = 1 << 21
#: Bits of a radix digit, and of a document's number in a packed key.
DIGIT = 16
#: An impact's scale, and the length normalisation in per cent.
WEIGHT, GAIN, SATURATION, LENGTH = 1000, 1_000_000_000, 8, 90


def weight(n: int, df: int) -> int:
    """A term's weight: of n documents df hold it."""
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of that length adds
    to its score; n documents have ``total`` terms. 64-bit integers."""
    m = 100 - LENGTH + (LENGTH * length * n) // total
    return weights * ((GAIN * tf) // (1000 * tf + SATURATION * m))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, stable, by digits from the lowest
    (numpy sorts 16-bit integers by radix). Digits that are in order already, as
    those of the documents are, take no pass."""
    order = np.arange(len(keys))
    for shift in range(0, int(keys.max()).bit_length() if len(keys) else 0, DIGIT):
        digit = ((keys >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.uint16)[order]
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def sums_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's values."""
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(values[order], starts)


class Best:
    """The k best of each item, by heaps: higher scores, and of equal ones
    those that came first."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.floor, self.seen = k, [[] for _ in range(items)], np.zeros(items, np.int64), 0

    def add(self, keys: np.ndarray, scores: np.ndarray, ids) -> None:
        """Packed keys in order; ``ids``: of the documents by number."""
        item = (keys >> np.uint64(DIGIT)).astype(np.int64)
        above = scores > self.floor[item]
        item, scores, place = item[above], scores[above], (keys[above] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
        bounds = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True]))) if len(item) else []
        for a, b in zip(bounds, bounds[1:]):
            heap = self.heaps[own := int(item[a])]
            for i in a + np.argsort(-scores[a:b], kind="stable")[: self.k]:
                entry = (int(scores[i]), -self.seen - int(place[i]), ids[int(place[i])].as_py())
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[own] = heap[0][0]

    def passed(self, documents: int) -> None:
        self.seen += documents


def postings(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with a term: its number of terms, the
    numbers of those in the vocabulary, and how often each occurs. Of one length
    is a text's list of terms only; counting goes on text by text."""
    known, schema = docs.sparkSession.sparkContext.broadcast(vocabulary), StructType([docs.select(F.col(doc_id).alias("doc_id")).schema[0], *StructType.fromDDL("n long, terms array<int>, tf array<int>")])
    pattern, kind = re.compile(TERM), to_arrow_type(schema["doc_id"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, terms, tf, ends = [], [], [], [], [0]
            for i, x in enumerate(batch.column(1)):
                # Bytes lower-case A-Z alone.
                found = pattern.findall(x.as_py().encode().lower().decode())
                if not found:
                    continue
                own = [(known.value[t], c) for t, c in Counter(found).items() if t in known.value]
                rows.append(i)
                lengths.append(len(found))
                terms += [t for t, _ in own]
                tf += [c for _, c in own]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())).cast(kind), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    return whole.mapInArrow(count, schema)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term), each once."""
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(TERM), F.lit(0))
    return items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.explode(words).alias("term")).distinct()


def blocks(pairs: DataFrame, most: int) -> int:
    """Into how many blocks items are dealt by hash, so that none with more
    than one item has more than so many terms. The sizes are counted."""
    total, items = pairs.agg(F.count(F.lit(1)), F.count_distinct("item_id")).first()
    n = max(1, math.ceil(total / most))
    while n > 1 or total > most:
        held = pairs.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"))
        if n >= 64 * items or held.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            break
        n *= 2
    return n


def _search(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame | None:
    """The best of each task for a block of items: (item_id, doc_id, score)."""
    rows = pairs.collect()
    items = list(dict.fromkeys(r.item_id for r in rows))
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
    if not rows:
        return None
    number = {x: i for i, x in enumerate(items)}
    # The items of each term, one after the other.
    term = np.array([vocabulary[r.term] for r in rows])
    of_term = np.array([number[r.item_id] for r in rows])[np.argsort(term, kind="stable")]
    many = np.bincount(term, minlength=len(vocabulary))
    first = np.cumsum(many) - many

    held = materialize(postings(docs, doc_id, text, vocabulary), "postings")
    n, total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[t] = weight(n, df)
    shared = docs.sparkSession.sparkContext.broadcast((items, of_term, many, first, weights))
    schema = StructType([pairs.schema["item_id"], held.schema["doc_id"], *StructType.fromDDL("score long")])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of_term, many, first, weights = shared.value
        best = Best(len(items), k)
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << DIGIT):
                batch = whole.slice(at, 1 << DIGIT)
                ids, terms = batch.column(0), batch.column(2).flatten().to_numpy()
                ends = np.cumsum([0, *pc.list_value_length(batch.column(2)).to_numpy()])
                document = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                gain = impacts(weights[terms], batch.column(3).flatten().to_numpy().astype(np.int64), batch.column(1).to_numpy()[document], n, total)
                matches = np.concatenate(([0], np.cumsum(many[terms])))
                # Chunks of whole documents: a new one where so many matches are full.
                chunk = matches[ends[:-1]] // MATCHES
                cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    own = slice(ends[a], ends[b])
                    times = many[terms[own]]
                    if not times.sum():
                        continue
                    place = np.arange(times.sum()) + np.repeat(first[terms[own]] - (np.cumsum(times) - times), times)
                    keys = (of_term[place].astype(np.uint64) << np.uint64(DIGIT)) | np.repeat(document[own], times).astype(np.uint64)
                    best.add(*sums_by_key(keys, np.repeat(gain[own], times)), ids)
                best.passed(batch.num_rows)
        found = [(items[i], e[2], e[0]) for i, heap in enumerate(best.heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found) if found else ([], [], []), kinds)], names=schema.names)

    return held.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(accumulate, schema)


def ranked(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents
    with a score above 0, equal scores by ascending id."""
    pairs = materialize(item_terms(items, item_id, item_text), "item-terms")
    n = blocks(pairs, block)
    parts = [_search(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b), doc_id, text, k) for b in range(n)]
    found = [p for p in parts if p is not None]
    if not found:
        ids = docs.where("false").select(F.col(doc_id).alias("doc_id"))
        return pairs.where("false").select("item_id", F.lit(0).alias("rank")).crossJoin(ids).withColumn("score", F.lit(0).cast("long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_WORDS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM e),
i AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM e) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term),
x AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS gain FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM i JOIN x USING (term) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
"""
