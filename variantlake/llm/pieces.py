"""Lattices of words over a public SentencePiece vocabulary, many words at once.

A word's lattice has a node for each place in it and an edge for each piece that fits
there. The vocabulary is a trie in arrays, and all words are matched against it together,
a character further at a time, as long as what was read begins some piece.

Defined cases: no words give an empty lattice; a character that is no piece gets an edge
of its own (piece -1); words may be of any length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The pieces of a vocabulary (bytes and control symbols are none), as a trie: the
    child of node n by character c has the key ``n << 21 | c``."""

    def __init__(self, model: str):
        sp = processor(model)
        self.size = sp.get_piece_size()
        self.kept = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        child: dict[int, int] = {}
        piece = [-1]
        for i in self.kept:
            node = 0
            for c in sp.id_to_piece(i):
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = i
        keys = np.fromiter(child, np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        # Keys by hash, in the next free slot; less than a quarter of the slots is taken.
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.slots[slot] < 0)
            taken, nth = np.unique(slot[free], return_index=True)
            own = left[free[nth]]
            self.slots[taken], self.child[taken] = keys[own], to[own]
            on = np.ones(len(left), bool)
            on[free[nth]] = False
            left, slot = left[on], slot[on] + 1 & self.mask
        self.piece = np.array(piece, np.int32)
        self.inner = np.zeros(len(piece), bool)  # is the beginning of a longer one
        self.inner[keys >> 21] = True
        self.inner[0] = False  # stands for characters that begin no piece
        self.first = np.zeros(0x110000, np.int32)  # children of the root by character
        at_root = keys < 1 << 21
        self.first[keys[at_root]] = to[at_root]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The children with these keys; 0 where there is none."""
        slot = self._slot(keys)
        held = self.slots[slot]
        hit = held == keys
        out = np.where(hit, self.child[slot], 0)
        left = np.flatnonzero(~hit & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            held = self.slots[slot]
            hit = held == keys[left]
            out[left[hit]] = self.child[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], slot[on]
        return out


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def code_points(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """How many characters the words have, and all of them, with a zero at the end."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "")[0].as_py()
    return length, np.frombuffer(f"{text}\0".encode("utf-32-le"), "<u4").astype(np.int64)


class Lattices:
    """The lattices of ``words``. Nodes are numbered by their distance from the end of
    their word: first the ends of all words, then what is a character from the end, and so
    on; ``start[w]`` is where word w begins. Node n has ``count[n]`` edges from ``first[n]``
    on, shorter ones first; an edge has a first node (``frm``), a last (``to``), a ``piece``
    and its first character (``sign``)."""

    def __init__(self, vocabulary: Pieces, words: pa.StringArray):
        length, signs = code_points(words)
        order = np.argsort(-length, kind="stable")
        # At a distance there are the longest words only: as many as are that long.
        longest = int(length.max()) if len(words) else 0
        self.many = np.searchsorted(-length[order], -np.arange(longest + 1), side="right")
        self.offset = np.cumsum(self.many) - self.many
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.start = self.offset[length] + rank
        ends = np.cumsum(length)[order]
        away = np.repeat(np.arange(longest + 1), self.many)
        word = np.arange(len(away)) - self.offset[away]
        at = ends[word] - away  # where a node's character is
        begin = np.arange(len(words), len(away))
        away, word, at = away[begin], word[begin], at[begin]
        self.count = np.zeros(len(words) + len(begin), np.int64)
        node = vocabulary.first[signs[at]].astype(np.int64)
        found = []
        depth = 1
        while len(begin):
            fits = vocabulary.piece[node]
            some = slice(None) if depth == 1 else fits >= 0  # a single character is an edge in any case
            frm = begin[some]
            found.append((frm, self.offset[away[some] - depth] + word[some], self.count[frm], fits[some]))
            self.count[frm] += 1
            on = np.flatnonzero((away > depth) & vocabulary.inner[node])
            to = vocabulary.find(node[on] << 21 | signs[at[on] + depth])
            on, node = on[to > 0], to[to > 0]
            begin, away, word, at = begin[on], away[on], word[on], at[on]
            depth += 1
        self.first = np.cumsum(self.count) - self.count
        edges = int(self.count.sum())
        self.to, self.piece = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for frm, to, nth, fits in found:
            slot = self.first[frm] + nth
            self.to[slot], self.piece[slot] = to, fits
        begin = np.arange(len(words), len(self.count))
        self.frm = np.repeat(begin.astype(np.int32), self.count[begin])
        self.sign = signs[ends[begin - np.repeat(self.offset, self.many)[begin]] - np.repeat(np.arange(longest + 1), self.many)[begin]][self.frm - len(words)]

    def backward(self, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the logarithm of the summed weights of all ways to the end of
        its word, and each edge's share of its first node's sum. ``log_weight`` has a row
        per edge, of one or more columns."""
        beta = np.zeros((len(self.count), *log_weight.shape[1:]))
        share = np.empty_like(log_weight)
        for a, m in zip(self.offset[1:].tolist(), self.many[1:].tolist()):
            i, sizes = int(self.first[a]), self.count[a : a + m]
            j = i + int(sizes.sum())
            x = log_weight[i:j] + beta[self.to[i:j]]
            cuts = self.first[a : a + m] - i
            top = np.maximum.reduceat(x, cuts)
            x = np.exp(x - np.repeat(top, sizes, axis=0))
            total = np.add.reduceat(x, cuts)
            beta[a : a + m] = top + np.log(total)
            share[i:j] = x / np.repeat(total, sizes, axis=0)
        return beta, share
