"""The pipeline's near-duplicate stage against exact five-word similarity."""

import collections
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string"


def sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest_alike(texts):
    """The smallest id of each class of texts alike at 0.8 or more, by brute force."""
    found, root = {i: sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, pairs = collections.defaultdict(list), collections.Counter()
    for i in sorted(texts):
        for s in found[i]:
            pairs.update((j, i) for j in holders[s])
            holders[s].append(i)
    same = collections.defaultdict(list)
    for i in sorted(texts):
        same[found[i]].append(i)
    links = [(v[0], i) for v in same.values() for i in v[1:]]
    links += [(i, j) for (i, j), c in pairs.items() if 5 * c >= 4 * (len(found[i]) + len(found[j]) - c)]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {find(i) for i in texts}, links


def test_near_stage_drops_all_near_copies_and_nothing_else(spark):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    start = max(i for i, _ in rows) + 1
    for k in range(60):  # copies on both sides of the bound: 3 to 8 words of 200 changed
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((start + 2 * k, " ".join(words)))
        for at in rng.sample(range(200), 3 + k % 6):
            words[at] = f"v{k}x{at}"
        rows.append((start + 2 * k + 1, " ".join(words)))
    first = "one two three four five six seven eight nine ten eleven twelve".split()
    rows += [(start + 200 + i, " ".join([*first * 3, *(f"t{i}y{j}" for j in range(30))])) for i in range(20)]  # a shared passage only
    want, links = smallest_alike(dict(rows))
    assert len(links) > 30
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_stage_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A "), (5, "a b c"), (6, "b c"), (6, "b c")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


@pytest.mark.parametrize(("groups", "copies"), [(12, 30), (3, 200), (3, 400)])
def test_near_stage_joins_groups_about_a_text(spark, groups, copies):
    """Copies of one text, each with a few words of its own changed: many pairs of copies
    lie below the bound, each copy and the text above it."""
    rng = random.Random(11)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((1000 * g + 500, " ".join(base)))
        for c in range(copies):
            words = list(base)
            for at in rng.sample(range(200), 4):
                words[at] = f"v{g}x{c}y{at}"
            rows.append((1000 * g + c, " ".join(words)))
    want, links = smallest_alike(dict(rows))
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert len(links) >= groups * copies and kept == sorted(want)


def changed(rng, words, n, mark):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"{mark}y{at}"
    return words


def test_near_stage_two_hubs_chains_and_lost_originals(spark):
    """Two texts too far apart to link, each with copies; a chain of small changes; copies
    of a text that is not there, all just below the bound."""
    rng, rows = random.Random(12), []
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for h, hub in enumerate((base, changed(rng, base, 9, "hub"))):
        rows.append((1000 * h, " ".join(hub)))
        rows += [(1000 * h + 1 + c, " ".join(changed(rng, hub, 4, f"v{h}x{c}"))) for c in range(60)]
    words = [f"c{rng.randrange(5000)}" for _ in range(200)]
    for c in range(60):
        words = changed(rng, words, 3, f"k{c}")
        rows.append((3000 + c, " ".join(words)))
    lost = [f"l{rng.randrange(5000)}" for _ in range(200)]
    rows += [(5000 + c, " ".join(changed(rng, lost, 4, f"o{c}"))) for c in range(50)]
    want, links = smallest_alike(dict(rows))
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert len(links) > 150 and len(want) > 40 and kept == sorted(want)


def lost_copies(rng, n):
    """Copies of a text that is not there, most pairs just below the bound, some above."""
    base = [f"l{rng.randrange(5000)}" for _ in range(200)]
    return [(c, " ".join(changed(rng, base, 3 + c % 2, f"o{c}"))) for c in range(n)]


@pytest.mark.parametrize("block", [4_000, 40])
def test_near_stage_rows_grow_with_texts_not_pairs(spark, monkeypatch, block):
    from variantlake.llm import near_dups

    counts, write = {}, near_dups.written

    def counted(df, label, *more):
        out = write(df, label, *more)
        counts[label] = max(out.count(), counts.get(label, 0))
        return out

    monkeypatch.setattr(near_dups, "written", counted)
    monkeypatch.setattr(near_dups, "BLOCK_TEXTS", block, raising=False)
    rows = lost_copies(random.Random(13), 320)
    want, links = smallest_alike(dict(rows))
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert kept == sorted(want) and len(links) < 0.5 * 320 * 319 / 2
    assert max(counts.values()) < 30 * len(rows), counts
