"""Language identification against enumeration, odd letters, the bounded fit."""

import math
import random

import numpy as np
import pytest

from variantlake.llm import language_id, pieces

MODEL = pieces.default_model()


def enumerated(word, logp):
    """The summed probability of all segmentations, by recursion."""
    sp = pieces.processor(MODEL)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    memo = {len(word): 1.0}

    def total(i):
        if i not in memo:
            fits = [(j, known[word[i:j]]) for j in range(i + 1, len(word) + 1) if word[i:j] in known]
            if word[i] not in known:
                fits.append((i + 1, -1))
            memo[i] = sum(math.exp(logp[p]) * total(j) for j, p in fits)
        return memo[i]

    return math.log(total(0))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(pieces.processor(MODEL).get_piece_size() + 1), 2).T)
    letters = random.Random(1)
    words = ["a", "the", "straße", "日本語", "ключ", "\U0001d49c"] + ["".join(letters.choice("thereings") for _ in range(n)) for n in range(2, 30)]
    got = language_id.forward(words, logp, MODEL)
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(enumerated(pieces.SPACE + w, logp[:, k]), rel=1e-9)
    long = language_id.forward(["there" * 400, "there" * 800], logp, MODEL)  # far below the smallest double
    assert np.isfinite(long).all() and (long[1] < 1.9 * long[0]).all()


def test_what_has_a_letter(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    odd = [None, "", "²½", "① ②", "12 _", "Ⅷ", "ª", "x²", "the cat", "und die katze", "日本"]
    docs = spark.createDataFrame([*rows, *((100 + i, t, None) for i, t in enumerate(odd)), (None, "the dog", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[100 + i].lang_pred for i in range(6)] == ["und"] * 6 and all(got[100 + i].score == 0 for i in range(6))
    assert all(got[100 + i].lang_pred in ("en", "de") for i in range(6, 11))
    assert (got[108].lang_pred, got[109].lang_pred, got[None].lang_pred) == ("en", "de", "en")
    nobody = language_id.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang is null"))
    assert {r.lang_pred for r in nobody.collect()} == {"und"}


def test_the_fit_takes_at_most_so_many_rows(spark):
    rows = [(i % 700 if i % 2 else 7, f"w{i}", "en" if i % 5 else "de") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (5, None, "en"), (6, "x", None)], "doc_id long, text string, lang string")
    for most in (10, 500, 5000):
        n = {r["lang"]: r["count"] for r in language_id.picked_rows(docs, "doc_id", "text", "lang", most).groupBy("lang").count().collect()}
        all_rows = {r["lang"]: r["count"] for r in language_id.picked_rows(docs, "doc_id", "text", "lang", 10**6).groupBy("lang").count().collect()}
        assert set(n) == {"en", "de"} and all(v <= most for v in n.values())
        assert most < 5000 or n == all_rows
