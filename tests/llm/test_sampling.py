"""Sampled segmentations against enumeration, round trips, and the library's own encoder."""

import collections
import math
import zlib

import numpy as np
import pytest

from variantlake.llm import pieces, sentencepiece_sampling as sps

MODEL = pieces.default_model()
SCHEMA = "doc_id long, text string, ids string"
TEXTS = [None, "", " ", "  a  b ", "a", "same text here", "same text here", "x" * 4000, "日本語 テキスト", "😀 \n\t ⟨é⟩", " ".join(f"word{i % 977}" for i in range(20_000)), "▁ mark", "a.\nWas\nit\n\nhere"]


def segmentations(text):
    """Every segmentation with its weight's logarithm, by recursion over the pieces."""
    sp = pieces.processor(MODEL)
    kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(kept, key=sp.get_score, reverse=True)
    total = math.log(sum(1 / (1 + n) for n in range(len(kept) + 256)))
    known = {sp.id_to_piece(i): (i, -math.log1p(n) - total) for n, i in enumerate(ranked)}
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE)

    def cut(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                i, lp = known[rest[:n]]
                first, more = (i,), lp
            elif n == 1:
                first = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in rest[0].encode())
                more = -len(first) * (math.log1p(len(kept)) + total)
            else:
                continue
            for ids, lp in cut(rest[n:]):
                yield first + ids, more + lp

    return dict(cut(marked))


def drawn(texts, k, first_seed=0):
    out = collections.defaultdict(list)
    for i, ids, *rest in sps.sample(sps.weights(MODEL), texts, list(range(first_seed, first_seed + len(texts))), k):
        out[i].append((tuple(ids.tolist()), *rest))
    return out


@pytest.mark.parametrize("text", ["ab ab", "the", "a😀b", "a.\nWas"])
def test_all_segmentations_are_found_once(text):
    weight = segmentations(text)
    total = np.logaddexp.reduce(list(weight.values()))
    got = drawn([text], 10_000)[0]
    assert len(got) == len(weight) and {r[0]: r[1] for r in got} == pytest.approx({k: v - total for k, v in weight.items()}, abs=1e-9)
    assert all(r[3] == 1 for r in got) and [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)


def test_samples_have_the_distribution_without_replacement():
    weight = segmentations("ab ab")
    total = np.logaddexp.reduce(list(weight.values()))
    prob = {k: math.exp(v - total) for k, v in weight.items()}
    n, first, pairs, estimate = 6000, collections.Counter(), collections.Counter(), collections.Counter()
    for r in drawn(["ab ab"] * n, 3).values():
        a, b = r[0][0], r[1][0]
        first[a] += 1
        pairs[a, b] += 1
        for ids, lp, _, q, _ in r:
            assert lp == pytest.approx(math.log(prob[ids]))
            estimate[ids] += math.exp(lp) / q
    for a in prob:
        assert abs(first[a] / n - prob[a]) < 5 * math.sqrt(prob[a] / n) + 1e-3
        if prob[a] > 0.01:
            assert estimate[a] / n == pytest.approx(prob[a], abs=0.08)
        for b in prob:
            if a != b:
                p = prob[a] * prob[b] / (1 - prob[a])
                assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_results_do_not_depend_on_steps():
    alone = [r for i, t in enumerate(TEXTS) for r in drawn([t], 4, i)[0]]
    together = drawn(TEXTS, 4)
    assert [r[0] for r in alone] == [r[0] for i in range(len(TEXTS)) for r in together[i]]
    assert [r[2] for r in alone] == pytest.approx([r[2] for i in range(len(TEXTS)) for r in together[i]], abs=1e-4)


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, "same text here", "x"), (None, "no id", "x")], SCHEMA)
    out = sps.decode(sps.sample_segmentations(docs, k=3), to="decoded").collect()
    want = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert {r.doc_id for r in out} == set(want)
    assert all(r.decoded == want[r.doc_id].replace("▁", " ") for r in out)
    assert len({(r.doc_id, bytes(r.ids)) for r in out if r.doc_id != 5}) == len([r for r in out if r.doc_id != 5])
    assert sorted(collections.Counter((r.sample, bytes(r.ids)) for r in out if r.doc_id == 5).values()) == [2, 2, 2]
    assert all(0 <= r.inclusion <= 1 and math.isfinite(r.log_inclusion) and r.log_inclusion <= 0 and r.log_prob <= 1e-6 for r in out)
    digest = sps.sampling_digest(docs)
    assert {(r.doc_id, r.decoded_crc32) for r in digest.collect()} == {(i, zlib.crc32(t.replace("▁", " ").encode())) for i, t in want.items()}
    empty = spark.createDataFrame([], SCHEMA)
    assert sps.sampling_digest(empty).count() == sps.encode(empty).count() == 0


def test_encode_and_decode_as_the_library_does(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    sp = pieces.processor(MODEL)
    for r in sps.decode(sps.encode(docs), to="back").collect():
        assert r.ids is None if r.text is None else np.frombuffer(r.ids, "<u2").tolist() == sp.encode(r.text)
        assert r.back == (None if r.text is None else r.text.replace("▁", " "))
    rng = np.random.default_rng(0)
    ids = [rng.choice(np.arange(259, sp.get_piece_size()), n).astype("<u2") for n in range(40)]
    assert [x.decode() for x in sps.decoded([x.tobytes() for x in ids], MODEL)] == [sp.decode(x.tolist()) for x in ids]


def test_children_are_found_by_hash():
    import numpy as np

    from variantlake.llm import pieces as p

    own = p.pieces(p.default_model())
    keys = own.slots[own.slots >= 0]
    assert (own.find(keys) == own.child[own.slots >= 0]).all() and len(np.unique(own.find(keys))) == len(keys)
    strange = np.setdiff1d(np.random.default_rng(5).integers(0, 1 << 40, 100_000), keys)
    assert not own.find(strange).any() and not len(own.find(keys[:0]))
