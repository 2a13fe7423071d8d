"""Ranked lexical search with hashed max-sketches.

A document's impact of a term is its share of the score before the term's weight. The
index holds each document's terms and impacts, and a sketch: two rows of slots, into which
two hashes of each term fold its impact, rounded up to a byte, as the slot's maximum. A
query's term looks up one slot in each row; the smaller one bounds the term's impact from
above, whatever else fell into it. Rows are ``SLOTS`` or more times as wide as the document
has terms, so most foreign slots are empty.

A search takes a stated set of queries in blocks of bounded size against all documents.
All bounds of a step of documents come from one lookup and one matrix product. Then
documents are rescored exactly, from their terms, in descending order of their bounds,
until no bound reaches a query's lowest kept score (it may be equal: ties go by id). The
kept scores go on from step to step of a task; the tasks' kept rows are ranked together.
Results are exact: bounds decide only what is rescored.

Terms are the maximal runs of digits, ASCII letters (A-Z in lower case) and characters
beyond ASCII. All arithmetic is in whole numbers; sums below 2**53 go through doubles,
larger ones do not.

Defined cases: null and empty texts have no term and are not counted; repeated rows are
documents each; equal scores go by ascending id, null ids last; items without a term or
without a match have no row; a repeated item has its own rows; very long texts are read
whole; an empty table gives an empty result; other columns are ignored, whatever their
names. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import steps, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
SLOTS, LEAST_SLOTS = 4, 16
#: An impact is below 10**6, so a byte holds it in these steps.
IMPACT_STEP = 4096
STEP_BYTES = 2 << 20
#: Queries and terms of a block, and slots that are looked up at once.
BLOCK_ITEMS, BLOCK_TERMS, LOOKUPS = 500, 20_000, 1 << 19
#: Documents that a query has rescored at first in a step; twice as many each time.
STRIDE = 4
EXACT = 1 << 53

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _slots(h: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both rows of sketches that have rows of ``width`` slots."""
    mask = width.astype(np.uint64) - np.uint64(1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64) + width


def sketches(h: np.ndarray, impacts: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The sketches of documents with so many terms each; hashes and impacts in a row."""
    width = np.maximum(LEAST_SLOTS, 1 << np.ceil(np.log2(np.maximum(size, 1) * SLOTS)).astype(np.int64))
    begin = np.cumsum(2 * width) - 2 * width
    out = np.zeros(int((2 * width).sum()), np.uint8)
    order = np.argsort(impacts, kind="stable")  # the largest is written last
    h, level, doc = h[order], (-(-impacts // IMPACT_STEP)).astype(np.uint8)[order], np.repeat(np.arange(len(size)), size)[order]
    for place in _slots(h, width[doc]):
        out[begin[doc] + place] = level
    return [out[a : a + 2 * w].tobytes() for a, w in zip(begin.tolist(), width.tolist())]


@dataclass(frozen=True)
class Index:
    """``rows`` (id, terms, impacts, sketch) of all documents that have a term, and their
    number."""

    rows: DataFrame
    documents: int


def _n_terms(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TERM))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = F.col("n")
    total = given.select(_n_terms(F.col("text")).alias("n")).agg(F.count(F.when(n > 0, n)).alias("documents"), F.sum(n).alias("terms")).first()
    documents, all_terms = total["documents"], total["terms"] or 1

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                found = [Counter(terms(t or b"")) for t in part.column("text").cast(pa.binary()).to_pylist()]
                kept = [i for i, c in enumerate(found) if c]
                found = [found[i] for i in kept]
                size = np.fromiter(map(len, found), np.int64, len(found))
                m = np.array([10 + 90 * c.total() * documents // all_terms for c in found], np.int64)
                tf = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, size.sum())
                words = pa.array(chain.from_iterable(found), pa.binary(), size=int(size.sum()))
                impacts = impact(tf, np.repeat(m, size))
                named = words.dictionary_encode()
                h = _hashes(named.dictionary.to_pylist())[named.indices.to_numpy()]
                ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                columns = [
                    part.column("id").take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(ends, words.cast(pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array(impacts.astype(np.int32))), pa.array(sketches(h, impacts, size), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "terms", "impacts", "sketch"])

    rows = given.mapInArrow(indexed, "id long, terms array<string>, impacts array<int>, sketch binary")
    return Index(written(rows, "search_index", "zstd"), documents)


class Block:
    """A block of queries: their distinct terms, and each query's weights of them."""

    def __init__(self, items: list[Row], df: dict[bytes, int], documents: int):
        of_item = [sorted(t for t in set(terms((r["text"] or "").encode("utf-8", "surrogatepass"))) if t in df) for r in items]
        self.words = sorted(set(chain.from_iterable(of_item)))
        place = {t: i for i, t in enumerate(self.words)}
        self.q = np.array([r["q"] for r in items], np.int64)
        self.weights = np.zeros((len(self.words), len(items)), np.int64)
        for k, found in enumerate(of_item):
            for t in found:
                self.weights[place[t], k] = weight(documents, df[t])
        exact = len(items) == 0 or int(self.weights.sum(axis=0).max(initial=0)) < EXACT // 1_000_000
        self.weights = self.weights.astype(np.float64 if exact else np.int64)


def _sums(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (values.astype(weights.dtype) @ weights).astype(np.int64)


class Search:
    """The best rows of each query over the steps of a task."""

    def __init__(self, block: Block, top: int):
        self.block, self.top = block, top
        self.h = _hashes(block.words)
        self.known = pa.array(block.words, pa.binary()).cast(pa.string())
        shape = (len(block.q), top)
        self.score, self.id, self.null = np.zeros(shape, np.int64), np.full(shape, np.iinfo(np.int64).max), np.ones(shape, bool)
        self.rescored = 0

    def bounds(self, part: pa.RecordBatch) -> np.ndarray:
        """An upper bound of each document's score for each query."""
        sketch = part.column("sketch")
        offsets = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + len(sketch) + 1].astype(np.int64)
        slots, width = np.frombuffer(sketch.buffers()[2], np.uint8), (np.diff(offsets) // 2)[:, None]
        first, second = _slots(self.h[None, :], width)
        begin = offsets[:-1, None]
        return _sums(np.minimum(slots[begin + first], slots[begin + second]), self.block.weights) * IMPACT_STEP

    def exact(self, part: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
        """The scores of these documents, from their own terms."""
        chosen = part.take(pa.array(rows))
        held = chosen.column("terms")
        at = pc.index_in(held.flatten(), value_set=self.known)
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(len(rows)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
        impacts = np.zeros((len(rows), len(self.known)), np.int64)
        impacts[doc[hit], at.drop_null().to_numpy()] = chosen.column("impacts").flatten().to_numpy()[hit]
        self.rescored += len(rows)
        return _sums(impacts, self.block.weights)

    def keep(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Merges scored documents (a row each) into the queries' best ones."""
        n = len(self.score)
        scores = np.concatenate([self.score, score.T], axis=1)
        all_ids = np.concatenate([self.id, np.broadcast_to(ids, (n, len(ids)))], axis=1)
        nulls = np.concatenate([self.null, np.broadcast_to(null, (n, len(null)))], axis=1)
        order = np.lexsort((all_ids, nulls, -scores), axis=-1)[:, : self.top]
        self.score, self.id, self.null = (np.take_along_axis(x, order, axis=1) for x in (scores, all_ids, nulls))

    def step(self, part: pa.RecordBatch) -> None:
        ids = part.column("id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        bounds, stride = self.bounds(part), STRIDE
        while True:
            wanted = bounds >= np.maximum(self.score[:, -1], 1)
            if not wanted.any():
                return
            ranked = np.argsort(-np.where(wanted, bounds, -1), axis=0, kind="stable")[:stride]
            rows = np.unique(ranked[np.take_along_axis(wanted, ranked, axis=0)])
            self.keep(self.exact(part, rows), ids[rows], null[rows])
            bounds[rows] = -1
            stride *= 2

    def best(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.score > 0)
        ids = pa.array(self.id[at, place], mask=self.null[at, place])
        return pa.RecordBatch.from_arrays([pa.array(self.block.q[at]), ids, pa.array(self.score[at, place])], ["q", "doc_id", "score"])


def _document_counts(rows: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's terms occurs (those that occur)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(words, pa.binary()).cast(pa.string()), np.zeros(len(words), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=known).drop_null()
            n += np.bincount(at.to_numpy(), minlength=len(words))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], ["t", "n"])

    found = rows.select("terms").mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {words[r["t"]]: r["n"] for r in found.collect()}  # at most a block's terms


def search(found: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item, rank, doc_id, score`` of the ``top`` documents of each row of ``items``."""
    given = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    asked = written(given.withColumn("n", _n_terms(F.col("text"))).filter("n > 0").withColumn("q", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("terms")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-(size["terms"] or 0) // BLOCK_TERMS))

    def of_block(k: int) -> DataFrame:
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).select("q", "text").collect()  # a block's queries
        words = sorted({t for r in rows for t in terms(r["text"].encode("utf-8", "surrogatepass"))})
        block = Block(rows, _document_counts(found.rows, words), found.documents)
        step = max(1, LOOKUPS // max(1, len(block.words)))

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Search(block, top)
            for batch in batches:
                for start in range(0, batch.num_rows if block.words else 0, step):
                    s.step(batch.slice(start, step))
            yield s.best()

        return found.rows.mapInArrow(searched, "q long, doc_id long, score long")

    kept = reduce(DataFrame.unionByName, [of_block(k) for k in range(blocks)])
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", "doc_id", "score")
