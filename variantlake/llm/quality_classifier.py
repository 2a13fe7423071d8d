"""A quality classifier by compression.

Two zstandard dictionaries of one size are made of labelled texts, one of good and one of
bad ones. A text is compressed with either; the difference of the two sizes over their
sum goes through a logistic curve fitted to other labelled texts, weighed by the true
shares of the labels, so the score is a probability.

The fit takes at most ``FIT_ROWS`` labelled ids of each class, the first by a hash of the
id among those that have a text of 1 to ``FIT_CHARS`` characters, and one such text each: at
most 2 * FIT_ROWS * FIT_CHARS characters come to the driver. Everything is scored, by its
whole text.

Defined cases: null and empty texts have no difference, so they get the curve's value at
zero; with no usable labelled text of one class every score is the share of good labels
(0.5 without labels); an id with both labels counts in both classes; repeated rows are
scored one by one, and of rows that share an id the fit takes one text; very long texts
are scored whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, written

#: Labelled rows per class that the fit takes at most.
FIT_ROWS = 2_000
#: Characters of a text that the fit takes at most; longer ones do not take part in it.
FIT_CHARS = 50_000
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 512 << 10
LEVEL = 12
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SCALE = 20  # puts differences near one, for the fit


class Model:
    """Two dictionaries and the curve's two weights: a megabyte, sent with a task."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, text: str | None) -> float:
        if not self.good or not self.bad:
            return self.weights[0]
        z = self.weights[0] + self.weights[1] * SCALE * difference(self.good, self.bad, text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    made = [zstd.ZstdCompressionDict(x, dict_type=zstd.DICT_TYPE_RAWCONTENT) for x in (good, bad)]
    for d in made:
        d.precompute_compress(level=LEVEL)
    return tuple(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in made)


def difference(good: bytes, bad: bytes, text: str | None) -> float:
    """How much smaller a text gets with the good dictionary than with the bad one, over
    the sum of both sizes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    by_good, by_bad = (len(c.compress(data)) for c in _compressors(good, bad))
    return (by_bad - by_good) / (by_bad + by_good)


def _dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes]:
    """The texts one after the other, as many bytes of either class."""
    joined = [b"".join(x.encode("utf-8", "surrogatepass") for x in texts) for texts in (good, bad)]
    size = min(DICTIONARY_BYTES, *map(len, joined))
    return tuple(x[len(x) - size :] for x in joined)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        a, b, c = bend[0, 0], bend[0, 1], bend[1, 1]
        step = np.array([c * slope[0] - b * slope[1], a * slope[1] - b * slope[0]]) / (a * c - b * b)
        w += np.clip(step, -5.0, 5.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: list[tuple[str, int]], good_share: float | None = None) -> Model:
    """A model from (text, 1 if good else 0); ``good_share`` is the share of good labels,
    by default that of ``labelled``."""
    by = {k: [x for x, y in labelled if y == k and x] for k in (0, 1)}
    if good_share is None:
        good_share = sum(y for _, y in labelled) / len(labelled) if labelled else 0.5
    if not by[0] or not by[1]:
        return Model(b"", b"", [good_share])
    build = {k: v[: max(1, len(v) // 2)] for k, v in by.items()}
    rest = [(x, k) for k, v in by.items() for x in (v[len(v) // 2 :] or v)]
    good, bad = _dictionaries(build[1], build[0])
    y = np.array([k for _, k in rest], float)
    weight = np.where(y > 0, good_share / y.sum(), (1 - good_share) / (1 - y).sum()) * len(y)
    x = np.array([(1.0, SCALE * difference(good, bad, t)) for t, _ in rest])
    return Model(good, bad, _logistic(x, y, weight).tolist())


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled ids of each class, held-out fold excluded.

    The ids are picked among those with a text that can take part. Each class is thinned by
    the ids' hash to little more than ``rows`` where its rows lie, so that none is gathered
    whole. The share of good labels is that of all labels."""
    learn = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col, FOLDS) != HELD_OUT)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text").between(1, FIT_CHARS))
    usable = texts.select("id").distinct().withColumn("usable", F.lit(True))
    learn = written(learn.join(usable, "id", "left").withColumn("hash", F.xxhash64("id")), "labelled")
    counts = {r["y"]: r for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count("usable").alias("m")).collect()}  # two rows
    good, bad = ((counts[y]["n"] if y in counts else 0) for y in (1, 0))
    good_share = good / (good + bad) if good + bad else 0.5
    if len(counts) < 2 or not all(r["m"] for r in counts.values()):
        return fit([], good_share)
    share = {k: (rows + 6 * math.sqrt(rows) + 20) / r["m"] for k, r in counts.items()}
    unit = F.shiftrightunsigned("hash", 11) * F.lit(2.0**-53)
    thin = learn.filter(F.col("usable") & (unit <= F.when(F.col("y") == 1, share[1]).otherwise(share[0])))
    picked = (
        thin.withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("hash", "id")))
        .filter(F.col("nth") <= rows).select("id", "y", "hash")
    )
    found = texts.join(F.broadcast(picked), "id").groupBy("y", "hash", "id").agg(F.min("text").alias("text")).collect()  # at most 2 * rows
    order = sorted(found, key=lambda r: (r["y"], r["hash"], r["id"]))
    return fit([(r["text"], r["y"]) for r in order], good_share)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row of ``docs``."""
    good, bad, weights = model.good, model.bad, model.weights

    def scored(texts: pd.Series) -> pd.Series:
        own = Model(good, bad, weights)
        return pd.Series([own.score(x) for x in texts], dtype="float64")

    out = docs.select(F.col(id_col), F.pandas_udf(scored, "double")(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit, then score: ``id, held_out, score, predicted``."""
    model = fit_quality(docs, labels, id_col, text_col)
    return score_quality(docs, model, id_col, text_col).select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
