"""Quality rules, exact and near dedup, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents.

Defined cases of every stage: extra columns stay as they are (the last stage returns pieces
only), whatever their names; an empty table gives an empty result; very long texts are read
whole; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from variantlake.llm import exact_dedup, near_dups, packing, pii, quality_rules
from variantlake.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their text and of their host. A null or empty text
    fails (too few words); a null source is no host, so only its text decides; repeated rows
    are judged, and counted for their host, each."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id. Null counts as the empty text; of
    repeated rows one stays; a null id stays only where its group has no other."""
    return exact_dedup.drop_duplicates(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts alike at 0.8 or more in five-word shingles, the document
    with the smallest id. SimHash anchors find the pairs, their similarity decides. Null and
    empty texts are one class; texts of fewer than five words are compared whole; ties of
    ids (repeated rows) leave one row."""
    return near_dups.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data. A null text stays null; repeated rows
    get the same surrogates, as equal entities do in all documents. The key is the session's;
    where it sets none, that of the made-up tables."""
    return pii.without_pii(docs, pii.session_key(spark, pii.TEST_KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. A null or empty text is its end token; repeated rows are
    packed each; ties of length go by a key of the row."""
    return packing.packing_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash", near),
    ("pii", private),
    ("packing", packed),
]

#: SQL can express neither the fingerprints nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
