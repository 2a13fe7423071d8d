"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into three blocks of at most 23 bits. The anchors
of a block are the 4,096 words of the binary Golay code: every 23-bit word is
within 3 bits of exactly one. Fingerprints with at most 4 differing bits differ in
at most 1 bit of some block, so the second lies within 3 + 1 bits of the first's
nearest anchor there. Each fingerprint is therefore sent to its nearest anchor (as
home) and to all anchors within 4 bits (as member): about 5.3 a block. Homes are
compared with members per anchor; busy anchors are dealt out as a grid of cells of
bounded size. A cell returns a spanning forest of its links, not its pairs.

Only distinct fingerprints are compared, so copies cost nothing. At most 3 * 4,096
anchor counts reach the driver.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle give one shingle; repeated rows share a class;
null ids never name a class unless it has no other; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (lowest bit, bits) of each block
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Bits that may differ in the best block.
BLOCK_BITS = MAX_BITS // len(BLOCKS)
RADIUS = 3
GENERATOR = 0b101011100011  # of the Golay code of length 23
CELL_HOMES, CELL_MEMBERS = 2_000, 8_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(x + 1 for x in ends)]
    last = ends[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, np.int64), len(last)
    for i in range(0, n, 1 << 15):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], last[i : i + (1 << 15)])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Each 23-bit word's remainder modulo the generator: its syndrome."""
    x = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ np.uint32(GENERATOR << (bit - 11)), x)
    return x


@lru_cache(1)
def _errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of at most RADIUS + BLOCK_BITS bits by syndrome, the lightest
    first, and where each syndrome's begin."""
    found = [sum(1 << b for b in c) for w in range(RADIUS + BLOCK_BITS + 1) for c in combinations(range(23), w)]
    patterns = np.array(found, np.uint32)
    syndromes = _remainder(patterns)
    order = np.argsort(syndromes, kind="stable")
    begins = np.searchsorted(syndromes[order], np.arange(2049))
    return patterns[order], begins[:-1], np.diff(begins)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index into prints, is home) of every replica of these fingerprints."""
    patterns, begins, sizes = _errors()
    keys, rows, homes = [], [], []
    for k, (low, bits) in enumerate(BLOCKS):
        words = ((prints.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        s = _remainder(words)
        n = sizes[s]
        row = np.repeat(np.arange(len(prints)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        anchor = words[row] ^ patterns[begins[s][row] + nth]
        keys.append((k << 12) | (anchor >> 11).astype(np.int32))  # 12 leading bits name a code word
        rows.append(row)
        homes.append(nth == 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, row, home = anchors(prints)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(prints[row]), pa.array(home)], ["key", "fp", "home"])


def forest(homes: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links between homes and members join."""
    nodes = np.unique(np.concatenate([homes, members]))
    label = np.arange(len(nodes))
    at_home, at_member = np.searchsorted(nodes, homes), np.searchsorted(nodes, members)
    h, m = homes.view(np.uint64), members.view(np.uint64)
    for i in range(0, len(h), 64):
        a, b = np.nonzero(np.bitwise_count(h[i : i + 64, None] ^ m[None, :]) <= MAX_BITS)
        x, y = label[at_home[i + a]], label[at_member[b]]
        far = x != y
        if not far.any():
            continue
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while v in parent:
                v = parent[v]
            return v

        for p, q in np.unique(np.stack([x[far], y[far]], 1), axis=0).tolist():
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        to = np.arange(len(nodes))
        for v in parent:
            to[v] = root(v)
        label = to[label]
    own = np.nonzero(label != np.arange(len(nodes)))[0]
    return list(zip(nodes[own].tolist(), nodes[label[own]].tolist()))


def by_cell(batches: Iterator[pd.DataFrame], work, columns: list[str]) -> Iterator[pd.DataFrame]:
    """What ``work`` finds in each cell. Rows come sorted by cell; a cell may go on in the
    next batch."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        cell, home = rows["cell"].to_numpy(), rows["home"].to_numpy()
        cuts = [0, *(np.nonzero(np.diff(cell))[0] + 1), len(cell)]
        found = [x for i, j in zip(cuts, cuts[1:]) if home[i:j].any() and j - i > 1 for x in work(rows.iloc[i:j])]
        return pd.DataFrame(found, columns=columns, dtype="int64")

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        whole = batch["cell"] != batch["cell"].iloc[-1]
        rest = batch[~whole]
        yield done(batch[whole])
    if rest is not None:
        yield done(rest)


def cell_grid(rows: DataFrame, spread: str, homes: int, members: int) -> DataFrame:
    """``rows`` (key, home, ...) in cells of about so many homes and members: a home meets
    every column of its anchor's grid, a member every row. At most a few ten thousand
    anchor counts reach the driver."""
    counts = rows.groupBy("key").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("m")).collect()
    grid = [(r["key"], -(-r["h"] // homes) or 1, -(-r["m"] // members)) for r in counts]
    plan = rows.sparkSession.createDataFrame(grid, "key int, p int, q int")  # a row per anchor
    side = lambda n, salt: F.pmod(F.xxhash64(spread, F.lit(salt)), F.col(n)).cast("int")
    cell = lambda i, j, home: F.struct(F.xxhash64("key", i, j).alias("cell"), F.lit(home).alias("home"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(to("p"), lambda i: cell(i, side("q", 2), False))
    as_home = F.when(F.col("home"), F.transform(to("q"), lambda j: cell(side("p", 1), j, True))).otherwise(F.array().cast("array<struct<cell:bigint,home:boolean>>"))
    placed = rows.join(F.broadcast(plan), "key").withColumn("place", F.explode(F.concat(as_home, as_member)))
    return placed.drop("key", "home").select("place.cell", "place.home", *[c for c in rows.columns if c not in ("key", "home")])


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` between the distinct fingerprints (column fp) that span every
    class of fingerprints linked at ``MAX_BITS`` or fewer bits."""
    rows = written(prints.select("fp").mapInArrow(_replicas, "key int, fp long, home boolean"), "replicas")
    placed = cell_grid(rows, "fp", CELL_HOMES, CELL_MEMBERS)
    work = lambda cell: forest(cell["fp"].to_numpy()[cell["home"].to_numpy()], cell["fp"].to_numpy())
    dealt = placed.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(lambda batches: by_cell(batches, work, ["a", "b"]), "a long, b long").distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``docs``."""
    printed = written(
        docs.select(F.col(id_col).alias("id"), F.pandas_udf(_fingerprints, "long")(F.col(text_col).cast("string")).alias("fp")), "fingerprints"
    )
    distinct = written(printed.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct_prints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return printed.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: the one with the smallest id, all columns."""
    return rows_with_ids(docs, simhash(docs, id_col, text_col), id_col)


def rows_with_ids(docs: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """One row of ``docs`` for each ``component_id`` of ``classes``, all columns."""
    kept = written(classes.select("component_id").distinct(), "kept_ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    joined = rows.join(kept, rows.id.eqNullSafe(kept.component_id)).select("row", "component_id")
    nth = F.row_number().over(Window.partitionBy("component_id").orderBy(F.lit(1)))
    return joined.withColumn("nth", nth).filter("nth = 1").select("row.*")
