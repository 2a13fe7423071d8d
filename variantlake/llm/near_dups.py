"""SimHash near-duplicates at a five-word similarity of 0.8 or more.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
least ``SIMILARITY``. A fingerprint of 64 bits cannot tell 0.8 from less (such texts
differ in about 10 bits of 64), so the fingerprint here has six lanes of 64 bits, and
links are found by exact similarity. Candidates come from anchors, as in ``simhash``: each
lane's three blocks send a fingerprint to the nearest word of the Golay code and to all
within 4 bits, and homes meet members per anchor. Texts at similarity 0.8 share an anchor
of one block with probability 0.44 or more, so all eighteen blocks miss a pair with
probability 0.00003 (0.000001 at 0.85). What meets and differs in at most ``NEAR_BITS`` of
the first 192 bits is a candidate: five standard deviations above texts at 0.8, six below
texts that have nothing in common.

A cell returns a spanning forest of its candidates, so rows grow with texts, not pairs.
Whatever candidates join is a group, whose texts' sets meet in one task: each text is
counted against all others of its group by an inverted index of shingles, whether they
are candidates themselves or not, and a spanning forest of the links is returned. A large
group is cut into blocks of bounded size, and each two blocks meet in a task of their own;
so its work grows with the square of its size, its rows with the number of its blocks.
Classes are the components of the links.

Defined cases: texts with equal sets (null and empty ones too) are one class; fewer
words than a shingle give one shingle; repeated rows share a class, and rows that share
an id but not a text are told apart; very long texts are read whole; null ids never name
a class unless it has no other; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import join_small, written
from .components import components
from .pieces import ragged
from .simhash import SEED, anchors, cell_grid, rows_with_ids

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction
LANES = 6
#: Bits of the first three lanes that a candidate pair may differ in.
NEAR_BITS = 54
CELL_HOMES, CELL_MEMBERS = 4_000, 16_000
#: Texts and shingles of a block of a large group, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 4_000, 2_000_000
STEPS = np.random.default_rng(SEED).integers(0, 1 << 63, LANES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(x + 1 for x in ends)]
    last = ends[SHINGLE - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last)))


def set_hash(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def lanes(found: np.ndarray) -> list[int]:
    """The lanes of a set's fingerprint: each bit is the majority of its members'."""
    out = []
    for step in STEPS:
        x = found ^ step
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 15):
            counts += np.unpackbits(x[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(x)).view("<i8")[0]))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, sizes, prints = [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            sets.append(set_hash(found))
            sizes.append(len(found))
            prints.append(lanes(found))
        columns = [batch.column("id"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "of", "size", "prints"])


def _replicas(batches: Iterator[pa.RecordBatch], of: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The first three lanes at every anchor of the lanes ``of``."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        prints = np.array(batch.column("prints").to_pylist(), np.int64).reshape(-1, LANES)
        for lane in of:
            key, row, home = anchors(np.ascontiguousarray(prints[:, lane]))
            columns = [key + (lane << 14), node[row], *(prints[row, i] for i in range(3)), home]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "fp", "more", "last", "home"])


REPLICA = "key int, node long, fp long, more long, last long, home boolean"


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` (the least place of each place's class) once these places are joined."""
    while True:
        a, b = label[x], label[y]
        far = np.flatnonzero(a != b)
        if not len(far):
            return label
        x, y, a, b = x[far], y[far], a[far], b[far]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while ((on := to[to]) != to).any():
            to = on
        label = to[label]


def _edges(names: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``a, b``: each place's name and that of its class, but for the class's own."""
    own = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([names[own], names[label[own]]], axis=1)


def near_forest(rows: pd.DataFrame) -> np.ndarray:
    """``a, b``: edges that join what the candidates of a cell join. Homes are compared with
    all rows, a few at a time, so a cell of copies holds no list of its pairs."""
    fp, more, last = (rows[c].to_numpy().view(np.uint64) for c in ("fp", "more", "last"))
    names, place = np.unique(rows["node"].to_numpy(), return_inverse=True)
    label = np.arange(len(names))
    homes = np.flatnonzero(rows["home"].to_numpy())
    for i in range(0, len(homes), 64):
        h = homes[i : i + 64]
        far = np.bitwise_count(fp[h, None] ^ fp[None, :]) + np.bitwise_count(more[h, None] ^ more[None, :])
        a, b = np.nonzero(far <= NEAR_BITS)
        near = far[a, b] + np.bitwise_count(last[h[a]] ^ last[b]) <= NEAR_BITS
        label = joined(label, place[h[a[near]]], place[b[near]])
    return _edges(names, label)


def link_forest(rows: pd.DataFrame) -> np.ndarray:
    """``a, b``: edges that join what the links among a group's texts join; in a group of
    two blocks (``cross``) the links between texts of one (``side`` 0) and of the other."""
    rows = rows.drop_duplicates("node")  # repeated rows
    names, side, cross = rows["node"].to_numpy(), rows["side"].to_numpy(), bool(rows["cross"].iloc[0])
    sets = [np.frombuffer(x, np.uint64) for x in rows["found"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    _, sign = np.unique(np.concatenate(sets), return_inverse=True)
    asked, held = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(sets)),) * 2
    label = np.arange(len(sets))
    if not len(asked) or not len(held) or not len(sign):
        return _edges(names, label)
    # The texts that have each shingle, one shingle after the other.
    theirs = sign[ragged(starts[held], sizes[held])]
    many = np.bincount(theirs, minlength=int(sign.max()) + 1)
    first = np.cumsum(many) - many
    holders = np.repeat(held, sizes[held]).astype(np.int32)[np.argsort(theirs, kind="stable")]
    num, den = SIMILARITY
    for i in asked.tolist():
        own = sign[starts[i] : starts[i] + sizes[i]]
        common = np.bincount(holders[ragged(first[own], many[own])], minlength=len(sets))
        to = np.flatnonzero((common > 0) & (common * den >= (sizes[i] + sizes - common) * num))
        label = joined(label, np.full(len(to), i), to)
        if not label.any():  # one class
            break
    return _edges(names, label)


def _forests(rows: DataFrame, key: str, work: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``a, b`` that ``work`` finds among the rows of each ``key``."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for edges in by_key(batches, key, work):
            yield pd.DataFrame(edges, columns=["a", "b"])

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(found, "a long, b long")


def by_key(batches: Iterator[pd.DataFrame], key: str, work: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[np.ndarray]:
    """What ``work`` finds among the rows of each key that has several, by batch. Rows come
    sorted by key; a key may go on in the next batches."""

    def done(parts: list[pd.DataFrame]) -> np.ndarray:
        rows = pd.concat(parts, ignore_index=True)
        at = rows[key].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        return np.concatenate([np.zeros((0, 2), np.int64), *(work(rows.iloc[i:j]) for i, j in zip(cuts, cuts[1:]) if j - i > 1)])

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = batch[key].to_numpy()
        begin = int(np.searchsorted(at, at[-1]))
        if begin or (rest and rest[-1][key].iloc[-1] != at[0]):
            yield done([*rest, batch.iloc[:begin]])
            rest = []
        rest.append(batch.iloc[begin:])
    if rest:
        yield done(rest)


def _grouped(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``node, of, key, root, p``: the nodes that have a candidate, their group and into how
    many blocks it is cut."""
    roots = components(candidates)
    members = written(nodes.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node").select("node", "of", "size", "key", "root"), "members")
    blocks = F.greatest(F.ceil(F.count("node") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    large = written(members.groupBy("root").agg(blocks.alias("p")).filter("p > 1"), "large_groups")
    return join_small(members, large, "root", "left", spread="node").select("node", "of", "key", "root", F.coalesce("p", F.lit(1)).alias("p"))


def _linked(grouped: DataFrame, given: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join what links join. Each node's set is made from a row that
    has it and goes to all tasks in which its block meets another."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column("text").to_pylist()]
            same = [i for i, (x, of) in enumerate(zip(found, batch.column("of").to_pylist())) if set_hash(x) == of]
            kept = [batch.column(c).take(pa.array(same, pa.int64())) for c in ("node", "root", "p")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([found[i].tobytes() for i in same], pa.binary())], ["node", "root", "p", "found"])

    texts = join_small(given.select(F.xxhash64("id").alias("key"), "text"), written(grouped, "owners"), "key", "inner", spread="text")
    rows = texts.select("node", "of", "root", "p", "text").mapInArrow(sets, "node long, root long, p int, found binary")
    own, other = F.pmod(F.xxhash64("node"), F.col("p")).cast("int"), F.col("other")
    met = rows.select("node", "root", "found", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("other"))
    dealt = met.select(
        F.xxhash64("root", F.least("own", other), F.greatest("own", other)).alias("task"),
        "node",
        (F.col("own") > other).cast("int").alias("side"),
        (F.col("own") != other).alias("cross"),
        "found",
    )
    return _forests(dealt, "task", link_forest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id`` for every row of ``docs``."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType(
        [StructField("id", given.schema["id"].dataType), StructField("of", BinaryType()), StructField("size", LongType()), StructField("prints", ArrayType(LongType()))]
    )
    sketched = written(given.mapInArrow(_sketched, schema), "sketches")
    distinct = sketched.groupBy("of").agg(
        F.min("id").alias("least_id"), F.min(F.xxhash64("id")).alias("key"), F.first("size").alias("size"), F.first("prints").alias("prints")
    )
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_sets")
    candidates = None
    for of in (range(i, i + LANES // 2) for i in (0, LANES // 2)):  # in two passes, so that half of the replicas are on disk at once
        replicas = nodes.select("node", "prints").mapInArrow(partial(_replicas, of=of), REPLICA)
        found = written(_forests(cell_grid(replicas, "node", CELL_HOMES, CELL_MEMBERS), "cell", near_forest).distinct(), "candidates")
        candidates = found if candidates is None else candidates.unionByName(found)
    links = written(_linked(_grouped(nodes, candidates), given).distinct(), "links")
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("of", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("of", "component_id"), "classes")
    return sketched.select("id", "of").join(named, "of").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: the one with the smallest id, all columns."""
    return rows_with_ids(docs, near_duplicates(docs, id_col, text_col), id_col)
