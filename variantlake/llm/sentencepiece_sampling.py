"""SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's lattice holds every way to cut it into vocabulary pieces. A piece's weight
falls with its merge rank (``1 / (1 + rank)``), so the public vocabulary alone fixes the
distribution. Every segmentation has a Gumbel-perturbed log weight; the ``k`` largest
are a sample of ``k`` without replacement. They are found by A* search over sets of
segmentations: a set's bound is the exact maximum of its perturbed weights (a Gumbel
variable at the set's log mass), so each set taken from the queue yields its best member
at once and falls apart into disjoint rest sets, one a word. No piece crosses a word, so
the words' lattices are independent.

The inclusion score is ``1 - exp(-exp(log_prob - kappa))``, kappa being the next largest
perturbed log weight: an estimate from the sample divides by it. Long texts' scores are
too small for a double, so the logarithm is returned as well.

A task takes its texts in steps of bounded size. In a step each distinct word's lattice
is built once, and the words' segmentations that the search may need (one a sample and
word) are drawn for all texts together; the search itself goes text by text. All
randomness comes from the row key, the word's place and the sample's number, so results
do not depend on steps or partitions.

Defined cases: a null or empty text has one, empty, segmentation (score 1); where a text
has at most ``k`` segmentations all are returned, each with score 1; characters outside
the vocabulary are spelled by byte pieces; a null row key counts as an empty one;
repeated rows give repeated results; very long texts make a step of their own; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import steps
from .pieces import SPACE, Lattices, default_model, pieces, processor, ragged

SAMPLES = 4
SEED = 7
#: Bytes of text that a task samples at once.
STEP_BYTES = 2 << 20
#: A word is drawn again without some of its segmentations where its draw has more than
#: this share of the mass, so that no difference of near equals is taken.
ALMOST_ALL = 1e-6
#: Words whose lattices are built at once.
BLOCK_WORDS = 2_000
#: Words that are drawn at once.
BLOCK_DRAWS = 16_000
#: Samples whose ids are put together at once.
BLOCK_SAMPLES = 100
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
FIELDS = "sample int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double"


class Weights:
    """Log weights of all pieces by number, and of a byte piece."""

    def __init__(self, model: str):
        sp = processor(model)
        self.pieces = pieces(model)
        kept = self.pieces.kept
        total = np.log(sum(1 / (1 + n) for n in range(len(kept) + 256)))
        self.piece = np.full(self.pieces.size, -np.inf)
        for n, i in enumerate(sorted(kept, key=sp.get_score, reverse=True)):
            self.piece[i] = -np.log1p(n) - total
        self.byte = float(-np.log1p(len(kept)) - total)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint16)


@lru_cache(2)
def weights(model: str) -> Weights:
    return Weights(model)


def utf8(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of code points (a row of four each) and how many there are."""
    n = 1 + (signs >= 0x80) + (signs >= 0x800) + (signs >= 0x10000)
    lead = np.choose(n - 1, [signs, 0xC0 | signs >> 6, 0xE0 | signs >> 12, 0xF0 | signs >> 18])
    out = np.zeros((len(signs), 4), np.int64)
    out[:, 0] = lead
    for j in range(1, 4):
        out[:, j] = 0x80 | (signs >> np.maximum(6 * (n - 1 - j), 0) & 0x3F)
    return out, n


class WordLattices:
    """The lattices of a step's words, built block by block, and the distribution of each
    word's segmentations. Word w begins at node ``start[w]`` and has the log mass
    ``log_z[w]``; node n has ``count[n]`` edges from ``first[n]`` on; an edge leads to node
    ``to``, has the log weight ``lp`` and the share ``cond`` of what its node leads to, and
    takes draws up to ``upto``; ``guide`` tells where to look for a draw."""

    def __init__(self, own: Weights, words: pa.StringArray):
        self.own = own
        made: dict[str, list[np.ndarray]] = {}
        nodes = edges = 0
        for i in range(0, max(1, len(words)), BLOCK_WORDS):
            block = self._block(own, words[i : i + BLOCK_WORDS])
            block["start"] += nodes
            block["to"] += nodes
            block["first"] += edges
            block["guide"] += edges
            nodes += len(block["count"])
            edges += len(block["to"])
            for name, column in block.items():
                made.setdefault(name, []).append(column)
        self.start, self.log_z, self.count, self.first, self.to, self.piece, self.sign, self.lp, self.cond, self.upto, self.guide = (
            np.concatenate(made.pop(x)) for x in ("start", "log_z", "count", "first", "to", "piece", "sign", "lp", "cond", "upto", "guide")
        )

    @staticmethod
    def _block(own: Weights, words: pa.StringArray) -> dict[str, np.ndarray]:
        made = Lattices(own.pieces, words)
        lp = own.piece[made.piece]
        alone = np.flatnonzero(made.piece < 0)
        n = utf8(made.sign[alone])[1]
        lp[alone] = n * own.byte
        made.piece[alone[n == 1]] = own.byte_ids[made.sign[alone[n == 1]]]  # -1 stays where it takes several ids
        beta, cond = made.backward(lp)
        begins = np.arange(len(words), len(made.count))
        count, first = made.count[begins], made.first[begins]
        total = np.concatenate([[0.0], np.cumsum(cond)])
        upto = np.minimum(total[1:] - np.repeat(total[first], count), 1.0)
        upto[first + count - 1] = 1.0
        # The edge at which the search for a draw in [j / count, (j + 1) / count) begins.
        upper = np.ceil(upto * np.repeat(count, count)).astype(np.int64)
        many = np.diff(upper, prepend=0)
        many[first] = upper[first]
        guide = np.repeat(np.arange(len(many), dtype=np.int32), many)
        return {
            "start": made.start, "log_z": beta[made.start], "count": made.count, "first": made.first, "to": made.to,
            "piece": made.piece, "sign": made.sign.astype(np.int32), "lp": lp, "cond": cond, "upto": upto, "guide": guide,
        }

    def left(self, words: np.ndarray, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Share of these words' mass left without each of these segmentations: the sum,
        over their edges, of what lies beside them."""
        begins = np.cumsum(sizes) - sizes
        node = np.empty(len(edges), np.int64)
        node[1:] = self.to[edges[:-1]]
        node[begins] = self.start[words]
        around = ragged(self.first[node], self.count[node])
        cond = np.where(around == np.repeat(edges, self.count[node]), 0.0, self.cond[around])
        beside = np.add.reduceat(cond, np.cumsum(self.count[node]) - self.count[node])
        log_cond = np.log(self.cond[edges])
        before = np.cumsum(log_cond) - log_cond
        return np.add.reduceat(np.exp(before - np.repeat(before[begins], sizes)) * beside, begins)

    def draw(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation for each of ``words``, by its seed: edges in order, and how many
        each has. Words are taken in blocks, neighbours in the lattices together."""
        order = np.argsort(words)  # a draw depends on its word and seed alone
        sizes = np.zeros(len(words), np.int64)
        taken = []
        with np.errstate(over="ignore"):
            for i in range(0, len(words), BLOCK_DRAWS):
                at = order[i : i + BLOCK_DRAWS]
                node, state, nth = self.start[words[at]], seeds[at], 0
                count = self.count[node]
                while len(at):
                    state = state + np.uint64(0x9E3779B97F4A7C15)
                    u = (mixed(state) >> np.uint64(11)) * 2.0**-53
                    e = self.guide[self.first[node] + (u * count).astype(np.int64)]
                    low = np.flatnonzero(self.upto[e] <= u)
                    while len(low):
                        e[low] += 1
                        low = low[self.upto[e[low]] <= u[low]]
                    taken.append((at, nth, e))
                    sizes[at] += 1
                    nth += 1
                    node = self.to[e]
                    count = self.count[node]
                    on = np.flatnonzero(count)
                    at, node, state, count = at[on], node[on], state[on], count[on]
        starts = np.cumsum(sizes) - sizes
        edges = np.empty(int(sizes.sum()), np.int32)
        for at, nth, e in taken:
            edges[starts[at] + nth] = e
        return edges, sizes

    def rest(self, word: int, without: list[tuple[int, ...]]) -> tuple[float, list[dict[int, int]], list[float]]:
        """Share of a word's mass left without some of its segmentations, as a sum (not a
        difference); with the trie of those segmentations and the shares at its nodes."""
        trie: list[dict[int, int]] = [{}]
        nodes = [int(self.start[word])]
        for path in without:
            t = 0
            for e in path:
                if e not in trie[t]:
                    trie[t][e] = len(trie)
                    trie.append({})
                    nodes.append(int(self.to[e]))
                t = trie[t][e]
        share = [0.0] * len(trie)
        for t in range(len(trie) - 1, -1, -1):
            share[t] = math.fsum(self._weights(nodes[t], trie[t], share))
        return share[0], trie, share

    def _weights(self, node: int, without: dict[int, int], share: list[float]) -> list[float]:
        """Shares of a node's edges; those that ``without`` names have a share of their own."""
        a, n = int(self.first[node]), int(self.count[node])
        out = self.cond[a : a + n].tolist()
        for e, t in without.items():
            out[e - a] *= share[t]
        return out

    def draw_rest(self, word: int, without: list[tuple[int, ...]], rng: Random) -> tuple[tuple[int, ...], float]:
        """A segmentation of a word that is none of ``without``, and the share of the
        word's mass left without either."""
        total, trie, share = self.rest(word, without)
        node, t, path, gone = int(self.start[word]), 0, [], 1.0
        while self.count[node]:
            w = self._weights(node, {} if t is None else trie[t], share)
            u, i = rng.random() * math.fsum(w), -1
            for f, x in enumerate(w):
                if x > 0:
                    i, u = f, u - x
                    if u < 0:
                        break
            e = int(self.first[node]) + i
            gone *= float(self.cond[e])
            path.append(e)
            t = None if t is None else trie[t].get(e)
            node = int(self.to[e])
        head = tuple(path)
        left = total - gone
        return head, left if left > ALMOST_ALL * total else self.rest(word, [*without, head])[0]

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The ids of edges, one edge after the other, and how many each has (None: one)."""
        piece = self.piece[edges]
        spelled = np.flatnonzero(piece < 0)
        if not len(spelled):
            return piece.astype("<u2"), None
        sizes = np.ones(len(edges), np.int64)
        signs, n = utf8(self.sign[edges[spelled]])
        sizes[spelled] = n
        out = np.repeat(piece, sizes).astype("<u2")
        at = (np.cumsum(sizes) - sizes)[spelled]
        for j in range(4):
            has = n > j
            out[at[has] + j] = self.own.byte_ids[signs[has, j]]
        return out, sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixture of each number."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Draws:
    """Segmentations drawn for words, in rounds. A draw has a number: from 0 on in the
    order of the rounds; -1, -2, ... are single ones that were drawn by themselves."""

    def __init__(self, lattices: WordLattices):
        self.lattices = lattices
        self.rounds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.made = 0
        self.single: list[tuple[int, ...]] = []

    def add(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A draw for each of ``words``: its log probability, and the logarithm of what is
        left of the word's mass without it."""
        own = self.lattices
        edges, sizes = own.draw(words, seeds)
        starts = np.cumsum(sizes) - sizes
        self.rounds.append((self.made, edges, starts, sizes))
        self.made += len(words)
        if not len(words):
            return np.zeros(0), np.zeros(0)
        lp = np.add.reduceat(own.lp[edges], starts) - own.log_z[words]
        left = -np.expm1(np.minimum(lp, 0.0))
        few = np.flatnonzero(left < ALMOST_ALL)
        if len(few):
            left[few] = own.left(words[few], edges[ragged(starts[few], sizes[few])], sizes[few])
        with np.errstate(divide="ignore"):
            return lp, np.log(left)

    def add_single(self, path: tuple[int, ...]) -> int:
        self.single.append(path)
        return -len(self.single)

    def path(self, draw: int) -> tuple[int, ...]:
        if draw < 0:
            return self.single[-draw - 1]
        first, edges, starts, sizes = next(r for r in reversed(self.rounds) if draw >= r[0])
        at = starts[draw - first]
        return tuple(edges[at : at + sizes[draw - first]].tolist())

    def ids(self, samples: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each sample, given by its draws."""
        edges = np.concatenate([*(r[1] for r in self.rounds), np.fromiter((e for p in self.single for e in p), np.int32)])
        sizes = np.concatenate([*(r[3] for r in self.rounds), np.fromiter(map(len, self.single), np.int64)])
        starts = np.cumsum(sizes) - sizes
        out = []
        for i in range(0, len(samples), BLOCK_SAMPLES):
            block = samples[i : i + BLOCK_SAMPLES]
            draws = np.concatenate(block)
            draws = np.where(draws < 0, self.made - 1 - draws, draws)
            n = sizes[draws]
            ids, each = self.lattices.ids(edges[ragged(starts[draws], n)])
            if each is not None:
                n = np.add.reduceat(each, np.cumsum(n) - n)
            cuts = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, block)])]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


class Search:
    """A text's queue of sets and the segmentations found. An entry of the queue: its
    bound (negative), its number, the word that must differ from the parent's, what it
    must not be, the parent. A found one: its words' draws and log probabilities, its own
    log probability, perturbed log probability."""

    def __init__(self, seed: int, words: np.ndarray):
        self.random = Random(seed)
        self.words = words
        self.queue: list = [(math.log(-math.log(1 - self.random.random())), 0, 0, [], -1)]
        self.found: list[tuple[np.ndarray, np.ndarray, float, float]] = []
        self.made = 1

    def take(self, draws: Draws) -> None:
        """The best set. ``fixed`` words are not free in it; ``again``, if not none, is
        the set where its last fixed word is another one yet, with its log mass."""
        bound, _, w, without, parent = heapq.heappop(self.queue)
        self.bound, self.again = -bound, None
        self.chosen, self.each = np.zeros(0, np.int64), np.zeros(0)
        if parent >= 0:
            own, word = draws.lattices, int(self.words[w])
            old, each, _, _ = self.found[parent]
            without = without or [draws.path(int(old[w]))]
            head, left = own.draw_rest(word, without, self.random)
            lp = math.fsum(own.lp[list(head)]) - own.log_z[word]
            self.chosen, self.each = np.append(old[:w], draws.add_single(head)), np.append(each[:w], lp)
            if left > 0:
                self.again = float(each[:w].sum()) + math.log(left), (w, [*without, head], len(self.found))
        self.fixed, self.start = len(self.each), float(self.each.sum())

    def push(self, g: float, entry: tuple) -> None:
        heapq.heappush(self.queue, (-g, self.made, *entry))
        self.made += 1

    def results(self) -> Iterator[tuple[np.ndarray, float, float, float, float]]:
        """Of each one found: draws, log probability, perturbed, score, its logarithm."""
        kappa = -self.queue[0][0] if self.queue else -math.inf
        for chosen, _, lp, g in self.found:
            x = min(lp - kappa, 700.0)  # infinite where nothing is left: score 1
            score = -math.expm1(-math.exp(x))
            yield chosen, lp, g, score, x if x < -30 else math.log(score)


def truncated(mass: np.ndarray | float, bound: np.ndarray | float, e: np.ndarray | float) -> np.ndarray:
    """Gumbel variables at these log masses that are known to be below their bounds;
    ``e`` are exponential variables."""
    return mass - np.log(np.exp(mass - bound) + e)


def turn(searches: list[Search], draws: Draws, words: np.ndarray, starts: np.ndarray, seeds: np.ndarray, many: int) -> None:
    """One more segmentation for each text. ``words`` and ``seeds`` are those of all the
    texts, a text's from its place in ``starts`` on; ``many`` more sets a text may matter."""
    for x in searches:
        x.take(draws)
    fixed = np.array([x.fixed for x in searches], np.int64)
    sizes = np.array([len(x.words) for x in searches], np.int64) - fixed
    free = ragged(starts + fixed, sizes)
    first = draws.made
    lp, log_left = draws.add(words[free], mixed(seeds[free] + np.uint64(len(searches[0].found))))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # The rest sets: words before j as here, word j otherwise, the words after it free.
    offset = np.array([x.start for x in searches]) - np.concatenate([[0.0], np.cumsum(lp)])[begins]
    mass = np.cumsum(lp) - lp + np.repeat(offset, sizes) + log_left
    noise = -np.log((mixed(seeds[free] - np.uint64(1 + len(searches[0].found))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54)
    g = truncated(mass, np.repeat(np.array([x.bound for x in searches]), sizes), noise)
    g[mass == -np.inf] = -np.inf
    some = np.flatnonzero(sizes)
    for x, a, b in zip(searches, begins.tolist(), ends.tolist()):
        each = np.concatenate([x.each, lp[a:b]])
        x.found.append((np.concatenate([x.chosen, np.arange(first + a, first + b)]), each, float(each.sum()), x.bound))
        if x.again:
            x.push(float(truncated(x.again[0], x.bound, -math.log(1 - x.random.random()))), x.again[1])
    for _ in range(many if len(some) else 0):
        top = np.maximum.reduceat(g, begins[some])
        at = np.flatnonzero((g == np.repeat(top, sizes[some])) & (g > -np.inf))
        of = some[np.searchsorted(ends[some], at, side="right")]
        for i, j in zip(of.tolist(), at.tolist()):
            searches[i].push(float(g[j]), (int(fixed[i] + j - begins[i]), [], len(searches[i].found) - 1))
        g[at] = -np.inf


def key_seed(row_key: str | None, seed: int) -> int:
    return xxhash.xxh64_intdigest((row_key or "").encode("utf-8", "surrogatepass"), seed)


def words_of(text: str | None) -> list[str]:
    """A text's words, each with the space marks before it."""
    return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def sample(own: Weights, texts: list[str | None], seeds: list[int], k: int) -> list[tuple[int, np.ndarray, float, float, float, float]]:
    """For every text its samples: the text's number, ids, log probability, perturbed log
    probability, inclusion score and its logarithm."""
    split = [words_of(x) for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = (np.arange(len(words)) - np.repeat(starts, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        word_seeds = mixed(np.repeat(np.array(seeds, np.uint64), sizes) + place * np.uint64(0xD1342543DE82EF95))
        draws = Draws(WordLattices(own, coded.dictionary))
        searches = [Search(x, words[a:b]) for x, a, b in zip(seeds, starts.tolist(), ends.tolist())]
        for s in range(k):
            live = [i for i, x in enumerate(searches) if x.queue]
            if live:
                turn([searches[i] for i in live], draws, words, starts[live], word_seeds, k - s)
    rows = [(i, *r) for i, x in enumerate(searches) for r in x.results()]
    return [(r[0], ids, *r[2:]) for r, ids in zip(rows, draws.ids([r[1] for r in rows]))]


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, model: str | None = None, decode_too: bool = False
) -> DataFrame:
    """``id, sample, ids, n_pieces, log_prob, perturbed, inclusion, log_inclusion`` for every row's
    samples; ids are little-endian unsigned 16-bit numbers. With ``decode_too`` the ids are
    decoded again in the same task, into ``decoded``."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights(path)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                seeds = [key_seed(x, seed) for x in part.column("row_key").to_pylist()]
                rows = sample(own, part.column("text").to_pylist(), seeds, k)
                of = np.array([r[0] for r in rows], np.int64)
                number = np.arange(len(of)) - np.searchsorted(of, of)
                columns = [pa.array([float(r[c]) for r in rows], pa.float64()) for c in range(2, 6)]
                ids = [r[1].tobytes() for r in rows]
                if decode_too:
                    columns.append(pa.array(decoded(ids, path), pa.binary()).cast(pa.string()))
                lengths = pa.array([len(r[1]) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of)), pa.array(number, pa.int32()), pa.array(ids, pa.binary()), lengths, *columns], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    fields = StructType.fromDDL(FIELDS + (", decoded string" if decode_too else ""))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, text_col: str = "text", to: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts' own (best) segmentation in column ``to``, as
    little-endian unsigned 16-bit numbers; null for a null text."""
    path = model or default_model()

    def encoded(texts: pd.Series) -> pd.Series:
        sp = processor(path)
        return texts.map(lambda x: None if x is None else np.array(sp.encode(x), "<u2").tobytes())

    return docs.withColumn(to, F.pandas_udf(encoded, "binary")(F.col(text_col).cast("string")))


@lru_cache(2)
def _surfaces(model: str) -> tuple[np.ndarray, np.ndarray]:
    """What the ids stand for, one after the other, and how many bytes each has."""
    sp = processor(model)
    out = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
    for i in range(len(out)):
        if sp.is_byte(i):
            out[i] = bytes([int(out[i][3:5], 16)])
        elif sp.is_control(i):
            out[i] = b""
    return np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out])


def decoded(ids: list[bytes], model: str) -> list[bytes]:
    """The texts of ids, in UTF-8: their surfaces without the space mark put before
    every text."""
    surfaces, sizes = _surfaces(model)
    starts = np.cumsum(sizes) - sizes
    out = []
    for x in ids:
        i = np.frombuffer(x, "<u2")
        out.append(surfaces[ragged(starts[i], sizes[i])].tobytes().removeprefix(b" "))
    return out


def decode(rows: DataFrame, ids_col: str = "ids", to: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids in column ``to``."""
    path = model or default_model()

    def texts(ids: pd.Series) -> pd.Series:
        some = ids.notna()
        out = pd.Series([None] * len(ids), dtype=object)
        out[some.to_numpy()] = [x.decode("utf-8", "replace") for x in decoded(ids[some].tolist(), path)]
        return out

    return rows.withColumn(to, F.pandas_udf(texts, "string")(F.col(ids_col)))


def sampling_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The samples of every row with the CRC-32 of their ids and of the decoded text."""
    out = sample_segmentations(docs, id_col, text_col, decode_too=True)
    return out.select(id_col, "sample", F.crc32("ids").alias("ids_crc32"), "n_pieces", "log_prob", "inclusion", "log_inclusion", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
