"""Ranked search against scores of all pairs by plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from variantlake.llm import ranked_search as rs

DOCS = "doc_id long, text string, id string, terms string, item_id string"
ITEMS = "item_id long, text string, doc_id string, q string, rank string"


def words(text):
    return re.findall(rs.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    tfs = [Counter(words(t)) for _, t in docs]
    n_docs, terms = sum(bool(c) for c in tfs), sum(c.total() for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, tfs):
            m = 100 - 90 + ((90 * c.total() * n_docs) // terms) if terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) & set(c))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


def rows(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "naïve", "日本", "x1", "№5"]
    pick = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([10, 60, 305])]) for _ in range(n))
    docs = [(i, pick(rng.randrange(1, 120))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[7][1]), (None, "w1"), (2000, None), (2001, ""), (2002, " .,; "), (2003, "W1 w1-W2"), (2004, pick(60_000))]
    items = [(i, pick(rng.randrange(1, 30))) for i in range(50)] + [(7, docs[7][1]), (7, docs[7][1]), (60, None), (61, "..."), (62, "unheard of"), (None, "w5 w6"), (63, "w1 W1 w1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("limits", [(500, 20_000, 1 << 20), (9, 60, 400)])
def test_search_by_brute_force(spark, corpus, limits, monkeypatch):
    for name, value in zip(("BLOCK_ITEMS", "BLOCK_TERMS", "LOOKUPS"), limits):
        monkeypatch.setattr(rs, name, value)
    docs, items = corpus
    found = rs.index(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS).repartition(6))
    got = rows(rs.search(found, spark.createDataFrame([(*i, "a", "b", "c") for i in items], ITEMS)))
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_whole_numbers_beyond_doubles(spark, corpus, monkeypatch):
    monkeypatch.setattr(rs, "EXACT", 0)
    docs, items = corpus[0][:80], corpus[1][:10]
    found = rs.index(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS))
    assert sorted(rows(rs.search(found, spark.createDataFrame([(*i, "a", "b", "c") for i in items], ITEMS), top=3)), key=key) == sorted(brute(docs, items, 3), key=key)


def test_bounds_hold_and_spare_work(spark):
    """Bounds lie above exact scores, and few documents are rescored."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = rs.index(docs)
    asked = [r for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()][:8]
    known = sorted({t.encode() for r in asked for t in words(r.text)})
    block = rs.Block([{"q": r.item_id, "text": r.text} for r in asked], rs._document_counts(found.rows, known), found.documents)
    part = found.rows.toArrow().combine_chunks().to_batches()[0]
    s = rs.Search(block, 10)
    bounds, exact = s.bounds(part), s.exact(part, np.arange(part.num_rows))
    assert (bounds >= exact).all() and (exact.max(axis=0) > 0).all()
    s = rs.Search(block, 10)
    s.step(part)
    assert s.rescored < part.num_rows / 2
    assert (s.score == -np.sort(-exact, axis=0)[:10].T).all()


def test_nothing_to_search(spark, corpus):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1", "a", "b", "c")], ITEMS)
    assert rs.search(rs.index(none), some).count() == 0
    assert rs.search(rs.index(spark.createDataFrame([(1, "w1", "a", "b", "c")], DOCS)), spark.createDataFrame([], ITEMS)).count() == 0
    assert rs.search(rs.index(spark.createDataFrame([(1, None, "a", "b", "c")], DOCS)), some).count() == 0
