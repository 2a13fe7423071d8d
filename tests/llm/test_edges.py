"""Empty tables, null ids, repeated rows and very long texts for the older operators."""

import pytest

from variantlake.llm import exact_dedup, packing, quality_rules, secret_scan, simhash, url_filter

SCHEMA = "doc_id long, text string, source string, row string, fp string, id string"
PAGES = "page_id long, url string, host string, rule string"
LONG = "lorem ipsum dolor sit amet consectetur " * 130_000  # 5 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, "some words here", "s"), (None, "some words here", "s"), (None, None, None), (4, "some words here", None), (5, LONG, "s"), (5, LONG, "s"), (6, "password = abcdefgh1", "s")]
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for found in (simhash.simhash(none), simhash.keep_one(none), secret_scan.secret_digest(none), quality_rules.quality_rules(none), packing.packing_digest(none), exact_dedup.exact_dedup(none)):
        assert found.count() == 0
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def ids(df):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select(df.columns[0]).collect())


def test_null_ids_repeated_rows_and_long_texts(docs):
    given = ids(docs)
    prints = simhash.simhash(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in prints) == given
    assert {r.component_id for r in prints if r.doc_id == 4} == {4} and {r.component_id for r in prints if r.doc_id == 5} == {5}
    for found in (quality_rules.quality_rules(docs), secret_scan.secret_digest(docs), exact_dedup.exact_dedup(docs)):
        assert ids(found) == given
    spans = {r.doc_id: r.n_assign for r in secret_scan.secret_digest(docs).collect()}
    assert spans[6] == 1 and spans[5] == 0
    words = {r.doc_id: r.n_words for r in quality_rules.quality_rules(docs).collect()}
    assert words[5] == 6 * 130_000 and words[4] == 3
    kept = [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()]
    assert kept.count((5, 5, 2)) == 2 and (4, 4, 3) in kept and kept.count((None, 4, 3)) == 2


def test_pieces_of_null_ids_and_long_texts(docs):
    pieces = packing.packing_digest(docs).collect()
    tokens = {r.doc_id: r.doc_tokens for r in pieces if r.doc_id is not None}
    held = lambda of: sum(r.length for r in pieces if r.doc_id == of)
    assert held(5) == 2 * tokens[5] and held(4) == tokens[4] and held(None) == 2 * tokens[4] + 1
    at = {}
    for r in pieces:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        assert sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))


def test_pages_with_null_ids(spark):
    rows = [(None, "http://a.net/en/x", "h", "r"), (None, None, "h", "r"), (1, "http://Example.NET/en/", "h", "r"), (1, "http://Example.NET/en/", "h", "r"), (2, "http://x.y/" + "p" * 2_000_000, "h", "r")]
    got = url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 5 and {(r.rule, r.verdict) for r in got if r.page_id == 1} == {("example.net/en/", "allow")}
    assert {r.rule for r in got if r.page_id is None} == {"net/", None}
