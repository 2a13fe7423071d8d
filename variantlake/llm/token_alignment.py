"""Alignment of two tokenizers' tokens by diagonal run skipping.

Tokenizer A is a byte-level BPE, B a SentencePiece model that adds a space; both read a
space and the text, and a token's bytes give it a range there. Places where tokens of both
end cut the tokens into groups. At a shift between the index in A and the index in B,
where the arrays of ends agree, tokens stand one to one: exponential probing compares 1,
2, 4, ... ends at the current shift and jumps as long as all agree. Where they differ an
irregular group begins; the side whose token ends first goes on until the ends meet, which
gives the new shift. Many lanes (stretches of a text that begin at a place where both
tokenizers end a token) are stepped through together in arrays; the last few one by one.

Texts are cut into segments before a space or line end that follows a character that is no
white space. No pre-token of A and no piece of B goes over such a place, so a segment's
ids do not depend on its neighbours, and a segment new to a worker is encoded once. A
vocabulary for which that does not hold is refused. Long texts are taken in ranges of
segments, so memory does not follow the length of a text (but for its bytes and distinct
pairs).

An id pair's count is the number of documents that hold it linked. Pairs are counted by
one aggregation; counts meet the documents' pairs in blocks of at most ``BLOCK_PAIRS``
pairs, each broadcast: a pair that a third of all documents hold is dealt to no one task.
The number of pairs is bounded by the vocabularies.

Defined cases: null and empty texts have no tokens, and neither have texts whose pieces
spell other bytes; repeated rows are documents each; null ids are carried; very long
texts are read whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import array
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import steps, written
from .pieces import SPACE, processor, ragged

#: Bytes of text that are taken at once, and that are aligned at once.
STEP_BYTES, RANGE_BYTES = 4 << 20, 1 << 20
#: Segments that a worker keeps encoded.
CACHE_SEGMENTS = 600_000
LANE_SEGMENTS = 48
#: Ends that are compared at once at most, and lanes that are worth stepping together.
MOST_PROBED, FEW_LANES = 4096, 8
#: Pairs whose counts are broadcast at once.
BLOCK_PAIRS = 2_000_000


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level tokenizers write bytes as letters: printable ones as themselves, the
    others, in order, as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the segments that were encoded."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        if model["normalizer"] or model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("tokenizer A must be a plain byte-level BPE")
        letters, special = _byte_alphabet(), {t["id"] for t in model["added_tokens"]}
        spelled = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items() if i not in special}
        merged = [model["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("tokenizer A's ids must follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in spelled.items()}, special_tokens={})
        self.a_size = max(spelled) + 1
        self.b = processor(b_path)
        self.b_size = self.b.get_piece_size()
        piece = self.b.id_to_piece
        names = [piece(i) for i in range(self.b_size)]
        if any(SPACE in n.lstrip(SPACE) or "\n" in n for n in names) or self.a_size * self.b_size > 1 << 31 or max(self.a_size, self.b_size) > 1 << 16:
            raise ValueError("tokenizer B must not go over the beginning of a word, nor be larger than 16 bits")
        self.space = [self.b.piece_to_id(SPACE)]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.a_len = np.array([len(spelled.get(i, b"")) for i in range(self.a_size)], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # Decimal ids with the sign that follows them, in the order that codes() counts them.
        self.signed = [f"{i}{s}".encode() for i in range(self.a_size) for s in ",|"] + [f"{i}{s}".encode() for i in range(self.b_size) for s in ",;"]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def _learn(self, segments: list[str]) -> None:
        if len(self.known) > CACHE_SEGMENTS:
            self.known.clear()
        new = [s for s in segments if s not in self.known]
        if not new:
            return
        spoken = self.b.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1)
        for k, s in enumerate(new):
            if s == " ":
                spoken[k] = self.space
            elif s[0] != " ":
                del spoken[k][0]  # the space that B adds, which joins nothing here
        fits = self._spelled(new, spoken)
        encode, packed = self.a.encode_ordinary, array.array
        self.known.update((s, (packed("H", encode(s)).tobytes(), packed("H", ids).tobytes(), ok)) for s, ids, ok in zip(new, spoken, fits))

    def _spelled(self, segments: list[str], spoken: list[list[int]]) -> list[bool]:
        """Whether B's pieces spell each segment."""
        said = [b"".join(map(self.b_bytes.__getitem__, ids)) for ids in spoken]
        return [x == s.encode() for x, s in zip(said, segments)]

    def encode(self, segments: pa.Array) -> tuple[Ids, Ids, np.ndarray]:
        """The ids of each segment by A and by B, and whether B spells its bytes."""
        listed = segments.to_pylist()
        self._learn(listed)
        found = list(map(self.known.__getitem__, listed))
        return Ids([x[0] for x in found]), Ids([x[1] for x in found]), np.fromiter((x[2] for x in found), bool, len(found))


class Ids:
    """The ids of many segments in one array."""

    def __init__(self, packed: list[bytes]):
        self.size = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(packed), np.uint16)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these segments in order, and how many each has."""
        n = self.size[code]
        return self.flat[ragged(self.start[code], n)].astype(np.int64), n


@lru_cache(1)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


def _one_by_one(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices in ``a`` and ``b`` where groups end; both end at the same place."""
    i = j = 0
    close_a: list[int] = []
    close_b: list[int] = []
    while i < len(a):
        width = 1
        while i < len(a) and a[i : i + width] == b[j : j + width]:
            n = min(width, len(a) - i)
            close_a += range(i, i + n)
            close_b += range(j, j + n)
            i, j, width = i + n, j + n, min(2 * width, MOST_PROBED)
        while i < len(a) and a[i] == b[j]:  # what the last probe holds before it differs
            close_a.append(i)
            close_b.append(j)
            i, j = i + 1, j + 1
        if i < len(a):
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            close_a.append(i)
            close_b.append(j)
            i, j = i + 1, j + 1
    return close_a, close_b


def shared_ends(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B whether its end is one of the other's too. ``i`` and
    ``j`` have the first tokens of the lanes; the arrays end at the same place."""
    close_a, close_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    i_end, j_end = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    i, j = i.copy(), j.copy()
    live = np.flatnonzero(i < i_end)
    while len(live) > FEW_LANES:
        # One to one: probe ever more ends at the lane's shift.
        probing, width = live, 1
        while len(probing):
            span = np.arange(width)
            room = np.minimum(i_end[probing] - i[probing], j_end[probing] - j[probing])
            x = np.minimum(i[probing, None] + span, len(a) - 1)
            y = np.minimum(j[probing, None] + span, len(b) - 1)
            same = (a[x] == b[y]) & (span < room[:, None])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            jumped = span < run[:, None]
            close_a[x[jumped]] = True
            close_b[y[jumped]] = True
            i[probing] += run
            j[probing] += run
            probing = probing[run == width]
            width = min(2 * width, MOST_PROBED)
        live = live[i[live] < i_end[live]]
        # Irregular: the side that is behind goes on until the ends meet.
        p, q, apart = i[live], j[live], np.arange(len(live))
        while len(apart):
            x, y = a[p[apart]], b[q[apart]]
            p[apart] += x < y
            q[apart] += y < x
            apart = apart[x != y]
        close_a[p] = True
        close_b[q] = True
        i[live], j[live] = p + 1, q + 1
        live = live[i[live] < i_end[live]]
    for k in live.tolist():
        at_a, at_b = _one_by_one(a[i[k] : i_end[k]].tolist(), b[j[k] : j_end[k]].tolist())
        close_a[np.array(at_a, np.int64) + i[k]] = True
        close_b[np.array(at_b, np.int64) + j[k]] = True
    return close_a, close_b


def links(a: np.ndarray, b: np.ndarray, close_a: np.ndarray, close_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of tokens whose ranges overlap. Each end of a token, where
    ranges part, closes one such pair; inside groups the other token is looked up."""
    ends_b = np.flatnonzero(close_b)
    of_a = np.empty(len(a), np.int64)
    of_a[close_a] = ends_b
    of_a[~close_a] = np.searchsorted(b, a[~close_a])
    inner = np.flatnonzero(~close_b)
    return np.concatenate([np.arange(len(a)), np.searchsorted(a, b[inner])]), np.concatenate([of_a, inner])


class _Texts:
    """The segments of a batch's texts: ``code`` names each one's distinct segment."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        empty = pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0)
        self.rows = np.flatnonzero(~empty.to_numpy(zero_copy_only=False))
        large = lambda x: pa.scalar(x, pa.large_string())
        spaced = pc.binary_join_element_wise(large(" "), texts.take(pa.array(self.rows)).cast(pa.large_string()), large(""))
        offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(spaced) else np.zeros(0, np.uint8)
        starts = offsets[:-1] - offsets[0]
        cut = np.zeros(len(data) + 2, bool)
        if len(data):
            before = data[:-1]
            # After a character of several bytes that may be white space, nothing is cut.
            odd = np.zeros(len(before), bool)
            odd[1:] = (before[:-1] == 0xC2) & (before[1:] >= 0x80)
            odd[2:] |= (before[:-2] >= 0xE1) & (before[:-2] <= 0xE3) & (before[1:-1] >= 0x80)
            solid = (before > 0x20) & (before != 0x7F) & ~odd
            cut[1 : len(data)] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & solid
            cut[starts] = True
        self.starts = np.flatnonzero(cut)
        bounds = np.append(self.starts, len(data))
        self.bytes = np.diff(bounds)
        segments = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())) if len(data) else pa.array([], pa.large_string())
        named = segments.dictionary_encode()
        self.distinct, self.code = named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = self.rows[np.searchsorted(starts, self.starts, side="right") - 1] if len(data) else np.zeros(0, np.int64)


def _ranges(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = int(np.searchsorted(total, total[start] - sizes[start] + RANGE_BYTES))
        end = max(end, start + 1)
        yield start, end
        start = end


class Alignment:
    """The alignment of a range of segments: tokens, ends, shared ends, documents."""

    def __init__(self, e: Encoders, a: Ids, b: Ids, code: np.ndarray, doc: np.ndarray):
        self.a, n_a = a.of(code)
        self.b, n_b = b.of(code)
        self.doc_a, self.doc_b = np.repeat(doc, n_a), np.repeat(doc, n_b)
        self.a_end, self.b_end = np.cumsum(e.a_len[self.a]), np.cumsum(e.b_len[self.b])
        lanes = np.flatnonzero((np.arange(len(code)) % LANE_SEGMENTS == 0) | np.append(True, doc[1:] != doc[:-1])[: len(code)])
        self.close_a, self.close_b = shared_ends(self.a_end, self.b_end, (np.cumsum(n_a) - n_a)[lanes], (np.cumsum(n_b) - n_b)[lanes])

    def codes(self, e: Encoders) -> tuple[np.ndarray, np.ndarray]:
        """Groups in order, A's tokens then B's, as indices of ``signed``; their documents."""
        first_a = np.append(0, np.flatnonzero(self.close_a) + 1)
        first_b = np.append(0, np.flatnonzero(self.close_b) + 1)
        group_a, group_b = np.cumsum(self.close_a) - self.close_a, np.cumsum(self.close_b) - self.close_b
        out, doc = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.int64)
        at_a, at_b = np.arange(len(self.a)) + first_b[group_a], np.arange(len(self.b)) + first_a[group_b + 1]
        out[at_a], out[at_b] = 2 * self.a + self.close_a, 2 * (e.a_size + self.b) + self.close_b
        doc[at_a], doc[at_b] = self.doc_a, self.doc_b
        return out, doc


def _whole(texts: _Texts, fits: np.ndarray, b: Ids, e: Encoders) -> np.ndarray:
    """Which segments belong to documents that B spells as they are."""
    wrong = np.unique(texts.doc[~fits[texts.code]])
    for doc in wrong.tolist():  # wrong segments may make the right bytes together
        code = texts.code[texts.doc == doc]
        said = b"".join(e.b_bytes[x] for x in b.of(code)[0].tolist())
        if said == "".join(texts.distinct.take(pa.array(code)).to_pylist()).encode():
            wrong = wrong[wrong != doc]
    return ~np.isin(texts.doc, wrong)


def _alignments(texts: _Texts, e: Encoders) -> Iterator[Alignment]:
    a, b, fits = e.encode(texts.distinct)
    used = np.flatnonzero(_whole(texts, fits, b, e))
    for start, end in _ranges(texts.bytes[used]):
        at = used[start:end]
        yield Alignment(e, a, b, texts.code[at], texts.doc[at])


def _digested(part: pa.RecordBatch, e: Encoders) -> pa.RecordBatch:
    """Counts, groups' digest and distinct pairs of each row."""
    n = part.num_rows
    n_a, n_b, n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    said = [None] * n
    keys, many = [], []
    for x in _alignments(_Texts(part.column("text")), e):
        n_a += np.bincount(x.doc_a, minlength=n)
        n_b += np.bincount(x.doc_b, minlength=n)
        n_groups += np.bincount(x.doc_a[x.close_a], minlength=n)
        codes, doc = x.codes(e)
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            d = int(doc[lo])
            text = b"".join(map(e.signed.__getitem__, codes[lo:hi].tolist()))[:-1]
            if said[d] is None:
                said[d] = hashlib.sha256(text)
            else:
                said[d].update(b";" + text)
        i, j = links(x.a_end, x.b_end, x.close_a, x.close_b)
        key, times = np.unique(x.doc_a[i] << 32 | x.a[i] * e.b_size + x.b[j], return_counts=True)
        keys.append(key)
        many.append(times)
    key, times = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*many, np.zeros(0, np.int64)])
    if len(keys) > 1:  # a document may lie in several ranges
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, times = key[first], np.add.reduceat(times, first)
    offsets = np.searchsorted(key, np.arange(n + 1) << 32)
    pairs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((key & 0xFFFFFFFF) << 32 | times, pa.int64()))
    digests = pa.array(["" if s is None else s.hexdigest() for s in said], pa.string())
    return pa.RecordBatch.from_arrays(
        [part.column("id"), *map(pa.array, (n_a, n_b, n_groups, n_a + n_b - n_groups)), digests, pairs],
        ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
    )


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """``id, a_ids, b_ids, a_group, b_group`` of every row: the tokens of both tokenizers and
    for each the number of its group, from 0."""
    given, paths = _given(docs, id_col, text_col), tokenizers or default_tokenizers()
    names = ["a_ids", "b_ids", "a_group", "b_group"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(*paths)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                held: dict[str, list[list[np.ndarray]]] = {c: [[] for _ in range(part.num_rows)] for c in names}
                groups = [0] * part.num_rows
                for x in _alignments(_Texts(part.column("text")), e):
                    for d in np.unique(x.doc_a).tolist():
                        (lo, hi), (p, q) = np.searchsorted(x.doc_a, [d, d + 1]), np.searchsorted(x.doc_b, [d, d + 1])
                        close_a, close_b = x.close_a[lo:hi], x.close_b[p:q]
                        found = (x.a[lo:hi], x.b[p:q], np.cumsum(close_a) - close_a + groups[d], np.cumsum(close_b) - close_b + groups[d])
                        for c, v in zip(names, found):
                            held[c][d].append(v)
                        groups[d] += int(close_a.sum())
                empty = np.zeros(0, np.int64)
                lists = [pa.array([np.concatenate([empty, *v]).astype(np.int32) for v in held[c]], pa.list_(pa.int32())) for c in names]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", *names])

    schema = StructType([StructField("id", given.schema["id"].dataType), *[StructField(c, ArrayType(IntegerType())) for c in names]])
    return given.mapInArrow(aligned, schema).withColumnRenamed("id", id_col)


def alignment_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    given, paths = _given(docs, id_col, text_col), tokenizers or default_tokenizers()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(*paths)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                yield _digested(part, e)

    longs = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType([StructField("id", given.schema["id"].dataType), *[StructField(c, LongType()) for c in longs], StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(LongType()))])
    held = written(given.mapInArrow(digested, schema).withColumn("row", F.monotonically_increasing_id()), "alignments", "zstd")
    # A link of a document: the pair in the upper half, how often in the lower.
    of_rows = held.select("row", F.explode("pairs").alias("x")).select("row", F.shiftright("x", 32).alias("pair"), F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).alias("times"))
    counts = written(of_rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    b_size = encoders(*paths).b_size
    of_a = F.expr(f"pair div {b_size}")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # at most A's vocabulary
    ranked = written(counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "ranked_pairs")
    blocks = -(-ranked.count() // BLOCK_PAIRS) or 1
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    met = [of_rows.join(F.broadcast(ranked.filter(block == k)), "pair") for k in range(blocks)]
    sums = [m.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")) for m in met]
    summed = reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = held.drop("pairs").join(summed, "row", "left")
    return out.select(F.col("id").alias(id_col), *longs, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
