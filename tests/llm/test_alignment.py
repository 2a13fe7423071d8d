"""Token alignment against brute force: whole tokenizers, byte by byte overlaps."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from variantlake.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, n_a string, row string, pairs string"
ODD = "abcXYZéèßüÆ 0129.,;:!?'\"-()[]{}<>/\\|@#$%^&*_+=~`\n\n\t\r    \x85\xa0　​\x00\x1c\x7f▁日本語한국😀кщяअनुﬁ①²½"


@pytest.fixture(scope="module")
def whole():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(whole, texts):
    """Every column but the sums' order, by the whole tokenizers and by overlaps of ranges."""
    a, b = whole
    letters = ta._byte_alphabet()
    docs = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        said_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(said_a) != want or b"".join(said_b) != want:
            docs.append(([], [], [], []))
            continue
        ends = lambda said: np.cumsum([len(x) for x in said]).tolist()
        docs.append((ids_a, ids_b, ends(said_a), ends(said_b)))
    counts, found = collections.Counter(), []
    for ids_a, ids_b, ends_a, ends_b in docs:
        shared = sorted(set(ends_a) & set(ends_b))
        groups, linked = [], []
        for lo, hi in zip([0, *shared], shared):
            x = [k for k, e in enumerate(ends_a) if lo < e <= hi]
            y = [k for k, e in enumerate(ends_b) if lo < e <= hi]
            groups.append(",".join(str(ids_a[k]) for k in x) + "|" + ",".join(str(ids_b[k]) for k in y))
            span = lambda ends, k: (ends[k - 1] if k else 0, ends[k])
            linked += [(ids_a[i], ids_b[j]) for i in x for j in y if max(span(ends_a, i)[0], span(ends_b, j)[0]) < min(ends_a[i], ends_b[j])]
        counts.update(set(linked))
        found.append((ids_a, ids_b, groups, linked))
    most = collections.Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [
        (len(x), len(y), len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for x, y, g, links in found
    ]


def rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_digests_by_brute_force(spark, whole, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_PAIRS", 700)  # counts come in several blocks
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "  ", "\n", " \n", "a ", "▁", "a▁b", "<|endoftext|> <s></s><unk> <0x41>", "same", "same", "x" * 3000, " ".join(f"wörd{i}" for i in range(3000))]
    df = spark.createDataFrame([(i, t, "c", "r", "p") for i, t in enumerate(texts)], SCHEMA)
    got = rows(ta.alignment_digest(df))
    want = brute(whole, texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[0] > 0 for w in want) > 300


def test_ranges_and_repeated_rows(spark, whole, monkeypatch):
    monkeypatch.setattr(ta, "RANGE_BYTES", 50)  # a text lies in many ranges
    text = "Straßen und Häuser, naïve façade; the quick brown fox. " * 40
    e = ta.encoders(*ta.default_tokenizers())
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"id": [1, None, 1], "text": [text, "b c", text]})
    out = ta._digested(part, e).to_pydict()
    want = brute(whole, [text, "b c", text])
    assert list(zip(*(out[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")))) == [(*w[:4], w[6]) for w in want]
    assert [len(p) == len({x >> 32 for x in p}) and sum(x & 0xFFFFFFFF for x in p) for p in out["pairs"]] == [w[3] for w in want]


def test_runs_by_plain_search():
    """Random ends: the lanes and the single steps find what sets find."""
    rng = np.random.default_rng(7)
    for n in range(300):
        size = int(rng.integers(2, 4000))
        ends = [np.unique(np.append(rng.choice(size, int(rng.integers(1, size)), replace=False) + 1, [size // 2 + 1, size + 1])) for _ in range(2)]
        if n % 3 == 0:  # long stretches one to one
            ends[1] = np.unique(np.append(ends[0][rng.random(len(ends[0])) < 0.97], [size // 2 + 1, size + 1]))
        a, b = ends
        shared = np.intersect1d(a, b)
        at = [np.append(0, np.searchsorted(x, shared[:-1]) + 1) for x in ends]  # a lane a group, then few lanes
        for take in (slice(None), slice(0, 1)):
            close_a, close_b = ta.shared_ends(a, b, at[0][take], at[1][take])
            assert a[close_a].tolist() == b[close_b].tolist() == shared.tolist()


def test_aligned_tokens(spark, whole):
    df = spark.createDataFrame([(1, "Ein schöner Tag\n  x", "", "", ""), (2, None, "", "", "")], SCHEMA)
    got = {r.doc_id: r for r in ta.align(df).collect()}
    assert got[1].a_ids == whole[0].encode(" Ein schöner Tag\n  x").ids and got[1].b_ids == whole[1].encode("Ein schöner Tag\n  x")
    assert max(got[1].a_group) == max(got[1].b_group) == brute(whole, ["Ein schöner Tag\n  x"])[0][2] - 1
    assert got[2].a_ids == got[2].b_ids == got[2].a_group == []


def test_empty_table_and_other_vocabularies(spark):
    assert ta.alignment_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="plain byte-level"):
        ta.Encoders(public_tokenizers.path("word_bpe_49k.json"), ta.default_tokenizers()[1])
