import re
from collections import Counter

import corpus_pipeline
from test_near_dups import smallest_alike

from variantlake.llm import quality_rules
def test_pipeline_keeps_what_its_stages_keep(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == ids and ids


def passes(text):
    """The rules of a text by itself."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def test_pipeline_keeps_what_plain_python_keeps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert not quality_rules.quality_rules(docs).filter("host_rejected").count()  # so texts alone decide here
    good = {r.doc_id: r.text for r in docs.collect() if passes(r.text)}
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    texts = {i: t for t, i in first.items()}
    want, _ = smallest_alike(texts)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == want and len(want) < len(good)
