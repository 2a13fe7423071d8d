"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. The
likelihood of a word is the sum over all its segmentations into pieces, by the forward
algorithm (run from the word's end, in logarithms, for words of every length); a text's
is the product over its words (runs of letters), and the language with the largest one is
predicted; the score is its posterior under equal priors. Words recur, so a task
remembers what it has summed, in a cache of bounded size.

The probabilities are fitted to at most ``FIT_ROWS`` labelled rows of each language, the
first by a hash of the id. Pieces are counted on the executors; only the counts, at most
one a language and piece, come to the driver. Every text is then scored whole.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with
score 0; without any labelled row every text is; equal likelihoods go to the first
language by name; repeated rows are scored one by one, and rows that share an id may all
be fitted to; very long texts are scored whole, by themselves; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, join_small, written
from .pieces import SPACE, Lattices, default_model, pieces, processor

#: Labelled rows of each language that the fit takes at most.
FIT_ROWS = 1_000
MOST_LANGUAGES = 200
SMOOTHING = 0.05
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
CACHE_WORDS = 400_000
#: Words whose lattices are built at once.
BLOCK_WORDS = 2_000
#: Probability of a character that the vocabulary lacks.
UNKNOWN = 1e-7
STEP_CHARS = 2_000_000


#: Letters, and the few numbers that are neither digits nor letters.
NEARLY = re.compile(r"[^\W\d_]+")


@lru_cache(1)
def _letters() -> re.Pattern:
    numbers = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
    return re.compile(rf"[^\W\d_{numbers}]+")


def words_of(text: str) -> list[str]:
    """A text's words: its runs of letters, in lower case."""
    low = text.lower()
    words = NEARLY.findall(low)
    return words if "".join(words).isalpha() or not words else _letters().findall(low)


def forward(words: list[str], logp: np.ndarray, vocabulary: str) -> np.ndarray:
    """Log-likelihood of each word (with its space mark) in each language: the sum over
    all segmentations. ``logp`` has a row per piece and a last one for a character that is
    no piece."""
    out = np.empty((len(words), logp.shape[1]))
    for i in range(0, len(words), BLOCK_WORDS):
        block = Lattices(pieces(vocabulary), pa.array([SPACE + w for w in words[i : i + BLOCK_WORDS]], pa.string()))
        beta, _ = block.backward(logp[block.piece])  # piece -1 is the last row
        out[i : i + BLOCK_WORDS] = beta[block.start]
    return out


class Model:
    """Languages by name and their pieces' log-probabilities."""

    def __init__(self, languages: list[str], logp: np.ndarray, vocabulary: str):
        self.languages, self.logp, self.vocabulary = languages, logp, vocabulary
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(languages)))

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index, new, self.table = {}, words, self.table[:0]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.concatenate([self.table, forward(new, self.logp, self.vocabulary)])

    def likelihoods(self, split: list[list[str]]) -> np.ndarray:
        """A row for each list of words, none of them empty."""
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.add.reduceat(self.table[rows], np.cumsum(sizes) - sizes)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        step: list[int] = []
        split: list[list[str]] = []
        chars = 0
        for n, x in enumerate(texts):
            words = words_of(x) if x and self.languages else []
            if words:
                step.append(n)
                split.append(words)
                chars += len(x)
            if step and (chars >= STEP_CHARS or n == len(texts) - 1):
                for k, ll in zip(step, self.likelihoods(split)):
                    best = int(np.argmax(ll))
                    out[k] = self.languages[best], float(1 / np.exp(np.maximum(ll - ll[best], -700)).sum())
                step, split, chars = [], [], 0
        return out


def piece_counts(texts: list[str], vocabulary: str) -> np.ndarray:
    """How often the vocabulary's own encoder uses each piece for the texts' words."""
    sp = processor(vocabulary)
    words = Counter(w for x in texts for w in words_of(x))
    out = np.zeros(sp.get_piece_size(), np.int64)
    for ids, n in zip(sp.encode(list(words), num_threads=1), words.values()):
        for i in ids:
            out[i] += n
    return out


def model_of(counts: dict[str, np.ndarray], vocabulary: str) -> Model:
    """A model from each language's piece counts; a little is added to each."""
    languages = sorted(counts)
    size = processor(vocabulary).get_piece_size()
    table = np.array([counts[x] for x in languages], float).reshape(len(languages), size).T + SMOOTHING
    logp = np.log(table / table.sum(axis=0, keepdims=True)) if languages else table
    return Model(languages, np.vstack([logp, np.full((1, len(languages)), np.log(UNKNOWN))]), vocabulary)


def picked_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """``lang, text`` of at most ``rows`` rows of each language outside the held-out fold, of
    the ``MOST_LANGUAGES`` most frequent languages (a bound on the table of pieces, 256 kB a
    language, that goes through the driver; rarer values of a dirty column are not learned).
    Each language's rows are thinned by their hash to little more than ``rows`` where
    they lie, so that a frequent language is never gathered."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.withColumn("hash", F.xxhash64("id"))
    share = (F.lit(rows) + 6 * F.sqrt(F.lit(float(rows))) + 20) / F.count(F.lit(1))
    n = F.count(F.lit(1)).alias("n")
    shares = written(known.groupBy("lang").agg(share.alias("share"), n).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).drop("n"), "languages")
    unit = F.shiftrightunsigned("hash", 11) * F.lit(2.0**-53)
    thin = join_small(known, shares, "lang", "inner", spread="hash").filter(unit <= F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id", F.xxhash64("text")))
    return thin.withColumn("nth", nth).filter(F.col("nth") <= rows).select("lang", "text")


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, vocabulary: str | None = None) -> Model:
    """Fit on at most ``rows`` rows of each language outside the held-out fold."""
    path = vocabulary or default_model()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                counts = piece_counts(part["text"].tolist(), path)
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "piece": used.astype("int32"), "n": counts[used]})

    partial = picked_rows(docs, id_col, text_col, lang_col, rows).mapInPandas(counted, "lang string, piece int, n long")
    sums = partial.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most languages * pieces rows
    size = processor(path).get_piece_size()
    counts = {x: np.zeros(size) for x in sums["lang"].unique()}
    for lang, part in sums.groupby("lang"):
        counts[lang][part["piece"].to_numpy()] = part["n"].to_numpy()
    return model_of(counts, path)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.vocabulary))
    own: list[Model] = []

    def predicted(texts: pd.Series) -> pd.DataFrame:
        if not own:
            own.append(Model(*sent.value))
        return pd.DataFrame(own[0].predict(texts.tolist()), columns=["lang_pred", "score"])

    udf = F.pandas_udf(predicted, "lang_pred string, score double")
    return docs.select(F.col(id_col), udf(F.col(text_col).cast("string")).alias("p")).select(id_col, "p.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit, then predict: ``id, held_out, lang_pred, score``."""
    model = fit_languages(docs, id_col, text_col, lang_col)
    out = predict_languages(docs, model, id_col, text_col)
    return out.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
