"""Exact deduplication: a 128-bit content hash groups rows, bytes decide.

DataFrame functions only. The grouping key is the hash *and* the text, so Spark's
aggregation compares bytes inside a hash group, and copies are combined before
the shuffle: a text that holds a third of all rows sends one row per task.

Defined cases: a null text counts as empty; an empty table gives an empty result;
of equal texts the row with the largest (``keep="max"``) or smallest id stays; rows
that repeat both id and text are all marked kept, and ``drop_duplicates`` returns
one of them; null ids lose to any other id; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def _hash128(text: Column) -> Column:
    return F.md5(text)


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    """One row per distinct text: h, sha, keep_id, group_size; ``rows`` has id, text, h."""
    best = F.max("id") if keep == "max" else F.min("id")
    return (
        rows.groupBy("h", "text")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("sha", _sha(F.col("text")))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash128) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", hash128(F.col("text")))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash128=_hash128
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    The rows find their group by hash and SHA-256 (a join that AQE can split where
    a text is very frequent). Two texts that share both digests are found in the
    group table; only then are the rows of those digests matched by their bytes.
    """
    rows = _keyed(docs, id_col, text_col, hash128)
    groups = written(_groups(rows, keep).drop("text"), "exact_groups")
    clash = groups.groupBy("h", "sha").count().filter("count > 1").drop("count")
    ids = rows.select("id", "h", _sha(F.col("text")).alias("sha"))
    if clash.isEmpty():
        out = ids.join(groups, ["h", "sha"])
    else:
        key = ["h", "sha"]
        full = rows.withColumn("sha", _sha(F.col("text"))).join(clash, key, "left_semi")
        by_bytes = full.join(_groups(rows, keep).join(clash, key, "left_semi"), [*key, "text"])
        plain = ids.join(clash, key, "left_anti").join(groups, key)
        out = plain.unionByName(by_bytes.drop("text"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows meet the group table by the id that stays, which spreads evenly however
    large a group is; repeated rows are numbered inside that same partitioning.
    """
    names = docs.columns
    rows = _keyed(docs, id_col, text_col, _hash128)
    groups = written(_groups(rows, keep).select("keep_id", "sha"), "exact_keepers")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), _sha(text).alias("sha")
    )
    joined = packed.join(groups, packed.id.eqNullSafe(groups.keep_id) & (packed.sha == groups.sha)).select(
        "row", "keep_id", groups.sha.alias("sha")
    )
    nth = F.row_number().over(Window.partitionBy("keep_id", "sha").orderBy(F.lit(1)))
    return joined.withColumn("nth", nth).filter("nth = 1").select("row.*")
