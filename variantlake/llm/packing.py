"""Packing token sequences by cutting-stock column generation.

A document longer than a sequence is first cut into whole sequences and one rest.
Rests fall into classes of ``UNIT`` tokens; the histogram of classes (at most
LENGTH / UNIT numbers) goes to the driver, where a linear program over patterns of
classes, its columns priced by knapsack dynamic programming, is solved and rounded.
Documents are ranked within their class and take the slots of the patterns by rank.

Classes round lengths up, so sequences keep some slack. As many sequences as there
is slack, the last ones, are dissolved: their tokens, as one stream, fill the slack
of the others in order (pieces may be cut freely), and what is left forms sequences
whose lengths are powers of two. No token of padding remains.

Ranks and running sums are two-level: sums of a fixed number of buckets, then a
window inside each bucket, so no task holds more than a bucket; their number grows with
the rows.

Defined cases: a null or empty text has the end token only; repeated rows are packed
each; null ids are carried; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import cutting_stock
from .common import steps, written
from .pieces import ragged

LENGTH = 4096
UNIT = 32
END_ID = 2
#: Buckets of the two-level ranks and sums: one per so many rows, within these bounds.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 256, 16_384
#: Bytes of text that a task tokenizes at once.
STEP_BYTES = 8 << 20
CACHE_TOKENS = 500_000

#: Chunks that are cut here: printable ASCII and the accented letters of Latin-1, which
#: normalization leaves as they are, without what may be a special token.
PLAIN, SPECIAL = "^[!-~À-ÖØ-öø-ÿ]*$", "<|"
#: What the vocabulary's pre-tokenizer makes of them in lower case; and the line ends
#: that part chunks here.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words:
    """Ids of chunks between ASCII white space, which ends every token of this
    vocabulary, so a text's ids are its chunks' ids in order. Plain chunks are cut here,
    and each token new to this worker is encoded once; other chunks are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokens: dict[str, list[int]] = {}

    def _whole(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these parts by the whole tokenizer, and how many each has."""
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        found = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(parts))

    def _learn(self, tokens: list[str]) -> None:
        if len(self.tokens) > CACHE_TOKENS:
            self.tokens.clear()
        known, model = self.tokens, self.model
        new = [x for x in tokens if x not in known]
        known.update((x, [t.id for t in model.tokenize(x)]) for x in new if x.isascii())
        accented = [x for x in new if not x.isascii()]
        ids, sizes = self._whole(accented)
        ends = np.cumsum(sizes)
        known.update((x, ids[a:b].tolist()) for x, a, b in zip(accented, (ends - sizes).tolist(), ends.tolist()))

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All the chunks' ids, one chunk after the other, and how many each has."""
        simple = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, SPECIAL))
        joined = "\n".join([*chunks.filter(simple).to_pylist(), ""]).lower()
        cut = pa.array(PRETOKENS.findall(joined), pa.string()).dictionary_encode()
        tokens = cut.dictionary.to_pylist()
        end = tokens.index("\n") if tokens else -1
        if tokens:
            tokens[end] = ""
        self._learn(tokens)
        ids = list(map(self.tokens.__getitem__, tokens))
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, n_ids.sum())
        code = cut.indices.to_numpy(zero_copy_only=False)
        n = n_ids[code]
        of_plain = flat[ragged((np.cumsum(n_ids) - n_ids)[code], n)]
        plain = simple.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(plain), np.int64)
        sizes[plain] = np.diff(np.cumsum(n)[code == end], prepend=0)
        if plain.all():
            return of_plain, sizes
        rest, sizes[~plain] = self._whole(chunks.filter(pc.invert(simple)).to_pylist())
        out = np.empty(sizes.sum(), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine], out[~mine] = of_plain, rest
        return out, sizes

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end token, as little-endian uint32."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = parts.flatten().dictionary_encode()
        ids, n_ids = self.chunks(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        n = n_ids[code]
        flat = ids[ragged((np.cumsum(n_ids) - n_ids)[code], n)].astype("<u4")
        at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])]
        end = END_ID.to_bytes(4, "little")
        return pa.array([flat[a:b].tobytes() + end for a, b in zip(at, at[1:])], pa.binary())


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """``row`` (a key of our own), ``id``, ``ids`` (uint32), ``n``: written once."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("id"), words.encode(part.column("text"))], ["id", "ids"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = given.mapInArrow(encoded, StructType([StructField("id", given.schema["id"].dataType), StructField("ids", BinaryType())]))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "ids", F.expr("octet_length(ids) div 4").cast("long").alias("n"))
    return written(rows, "tokens", "zstd")


def _running(df: DataFrame, bucket: Column, order: list[str], value: str, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in order of bucket and
    then ``order``. The buckets' sums are at most ``MOST_BUCKETS`` rows."""
    spread = df.withColumn("__b", bucket)
    sums = spread.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.withColumn(to, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(starts), "__b")
    return out.withColumn(to, F.col(to) + F.col("__start")).drop("__b", "__start")


def _hashed(col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def _slots(demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(class, first rank, end rank, slots per sequence, first sequence, place) for
    each class of each pattern, and the number of sequences."""
    taken = np.zeros(len(demand), np.int64)
    out, sequences = [], 0
    for pattern, n in cutting_stock.integral(demand, capacity):
        for place, c in enumerate(np.nonzero(pattern)[0][::-1]):
            many = int(pattern[c])
            out.append((int(c) + 1, int(taken[c]), int(taken[c]) + many * n, many, sequences, place))
            taken[c] += many * n
        sequences += n
    return out, sequences


def plan(tokens: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Pieces ``row, start, length, sequence_id, offset`` for a table with ``row, n``."""
    spark = tokens.sparkSession
    capacity = length // unit
    sized = tokens.select("row", "n")
    buckets = min(max(sized.count() // ROWS_PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)
    rests = sized.withColumn("r", F.col("n") % length).filter("r > 0").withColumn("c", F.ceil(F.col("r") / unit).cast("int")).withColumn("b", _hashed("row", buckets))
    counted = written(rests.groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"), F.sum("r").alias("s")), "histogram")
    demand, total = np.zeros(capacity, np.int64), 0
    for r in counted.groupBy("c").agg(F.sum("k").alias("k"), F.sum("s").alias("s")).collect():  # a row per class
        demand[r["c"] - 1] = r["k"]
        total += r["s"]
    slots, sequences = _slots(demand, capacity)
    full, left = divmod(total, length)  # sequences to fill, tokens that remain

    # Ranked documents take the slots of their class.
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("c", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))  # classes * buckets rows
    nth = F.row_number().over(Window.partitionBy("c", "b").orderBy(F.col("r").desc(), "row"))
    ranked = rests.withColumn("nth", nth).join(F.broadcast(starts), ["c", "b"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    table = spark.createDataFrame(slots, "c int, lo long, hi long, many long, base long, place int")  # a few per class
    inside = (ranked["c"] == table["c"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    at = (F.col("rank") - F.col("lo")).cast("long")
    placed = ranked.join(F.broadcast(table), inside).select(
        "row", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"),
        (F.col("base") + F.expr("(rank - lo) div many")).alias("seq"), (F.col("place") * capacity + at % F.col("many")).alias("slot"),
    )
    by_slot = Window.partitionBy("seq").orderBy("slot")
    ordered = placed.withColumn("offset", F.sum("length").over(by_slot) - F.col("length")).withColumn("fill", F.sum("length").over(Window.partitionBy("seq")))
    placed = written(ordered, "placed")

    kept = placed.filter(F.col("seq") < full).select("row", "start", "length", F.col("seq").alias("sequence_id"), "offset")
    # The dissolved sequences' tokens as one stream, and the gaps that it fills.
    wide = lambda first, n: F.least(F.expr(f"((seq - {first}) * {buckets}) div {max(1, n)}"), F.lit(buckets - 1))
    stream = _running(placed.filter(F.col("seq") >= full), wide(full, sequences - full), ["seq", "slot"], "length", "lo")
    stream = stream.select("row", "start", "lo", (F.col("lo") + F.col("length")).alias("hi"))
    gaps = placed.filter((F.col("seq") < full) & (F.col("offset") == 0)).select("seq", "fill", (F.lit(length) - F.col("fill")).alias("gap")).filter("gap > 0")
    gaps = _running(gaps, wide(0, full), ["seq"], "gap", "lo").select("seq", "fill", "lo", (F.col("lo") + F.col("gap")).alias("hi"))
    slack = written(gaps, "gaps")
    end = slack.agg(F.max("hi").alias("x")).first()["x"] or 0
    tail, seq = [], full
    for power in reversed(range(length.bit_length())):
        if left >> power & 1:
            tail.append((seq, 0, end, end + (1 << power)))
            end, seq = end + (1 << power), seq + 1
    slack = slack.unionByName(spark.createDataFrame(tail, "seq long, fill long, lo long, hi long"))
    # Both are cut at cells of the stream, and meet where they overlap.
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {length}"), F.expr(f"(hi - 1) div {length}"))))
    a, b = cells(stream).alias("a"), cells(slack).alias("b")
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    met = a.join(b, F.col("a.cell") == F.col("b.cell")).filter((lo < hi) & (lo >= F.col("a.cell") * length))
    met = met.filter(lo < (F.col("a.cell") + 1) * length)
    fillers = met.select(
        "row", (F.col("a.start") + lo - F.col("a.lo")).alias("start"), (hi - lo).alias("length"),
        F.col("b.seq").alias("sequence_id"), (F.col("b.fill") + lo - F.col("b.lo")).alias("offset"),
    )
    # Whole sequences cut from long documents are numbered after all others.
    longer = _running(sized.withColumn("wholes", F.expr(f"n div {length}")).filter("wholes > 0"), _hashed("row", buckets), ["row"], "wholes", "before")
    wholes = longer.select("row", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wholes") - 1)).alias("k")).select(
        "row", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"),
        (F.lit(seq) + F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return kept.unionByName(fillers).unionByName(wholes)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """All pieces of all sequences: ``id, start, length, doc_tokens, sequence_id,
    offset`` and ``ids``, the piece's ids as little-endian unsigned 32-bit numbers."""
    tokens = tokenized(docs, id_col, text_col, tokenizer or default_tokenizer())
    pieces = plan(tokens, length, unit)
    of_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    cut = lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset"), F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int")).alias("ids"))
    out = tokens.join(of_row, "row").select("id", F.col("n").alias("doc_tokens"), F.explode(F.transform("pieces", cut)).alias("p"))
    return out.select(F.col("id").alias(id_col), "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def packing_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with the CRC-32 of their ids."""
    out = pack(docs, id_col, text_col)
    return out.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
