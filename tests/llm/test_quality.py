"""The quality classifier: held-out ranking by the dealt difference, reliability, odd fits."""

import numpy as np
import pytest

from variantlake.llm import quality_classifier as q

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = q.quality(docs, labels).filter("held_out").join(labels.select("doc_id", "quality").distinct(), "doc_id")
    return out.filter("quality is not null").toPandas()


def test_difference_ranks_held_out_texts(scored):
    rank, y = scored["score"].rank().to_numpy(), scored["quality"].to_numpy()
    good = y.sum()
    auc = (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))
    print("AUC", auc, "accuracy", (scored["predicted"] == y).mean())
    assert auc > 0.95 and (scored["predicted"] == y).mean() > 0.9


def test_scores_are_probabilities(scored):
    """In bins of scores with enough rows the share of good ones is near the mean score."""
    s, y = scored["score"].to_numpy(), scored["quality"].to_numpy()
    assert abs(s.mean() - y.mean()) < 0.05
    for low in np.arange(0, 1, 0.2):
        at = (s >= low) & (s < low + 0.2 + (low > 0.7))
        print(round(low, 1), at.sum(), s[at].mean() if at.any() else None, y[at].mean() if at.any() else None)
        if at.sum() >= 50:
            assert abs(s[at].mean() - y[at].mean()) < 0.1


def test_odd_fits():
    assert q.fit([]).score("x") == 0.5 and q.fit([("a", 1)]).score(None) == 1.0
    m = q.fit([("good words here " * 9, 1), ("bad bad ### " * 9, 0)] * 6)
    assert m.score("good words here " * 5) > 0.5 > m.score("bad bad ### " * 5)
    assert m.score(None) == m.score("") and 0 <= m.score("\ud800" * 3) <= 1 and 0 <= m.score("y" * 5_000_000) <= 1


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(i % 40, ("fine words " if i % 2 else "### $$$ ") * (5 + i % 7), "x") for i in range(400)] + [(None, None, "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(1, None), (None, 1)], "doc_id long, quality int")
    out = q.quality(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 401
    right = out.join(labels.distinct(), "doc_id").filter("quality is not null and (score > 0.5) = (quality = 1)").count()
    assert right == 400


def test_long_labelled_texts_leave_their_place_to_others(spark, monkeypatch):
    """Nine of ten labelled texts are too long for the fit, or empty; of the others all can be picked."""
    monkeypatch.setattr(q, "FIT_CHARS", 200)
    text = lambda i: ("fine words " if i % 2 else "### $$$ ") * (5 if i % 20 < 2 else 400 * (i % 3))
    docs = spark.createDataFrame([(i, text(i)) for i in range(2_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 and i % 4 == 1)) for i in range(2_000)], "doc_id long, quality int")
    model = q.fit_quality(docs, labels.filter("quality = doc_id % 2"), rows=40)
    assert model.score("fine words " * 9) > 0.5 > model.score("### $$$ " * 9)
    long_only = docs.filter("length(text) > 200")
    assert q.fit_quality(long_only, labels).score("fine words") == pytest.approx(0.25, abs=0.03)
    assert q.fit_quality(docs, labels.filter("quality = 1")).score("x") == 1.0 and q.fit_quality(docs, labels.limit(0)).score("x") == 0.5
