"""A cohort's results: calls met with annotations, ranked and counted.

Samples are the unit of order, so windows and counts partition by sample, or by parts of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import BENIGN_FROM, SIGNIFICANT_TO, is_high_impact_gene, is_strong, is_strong_p
from .joins import held_if_small, may_be_in

TOP, TOP_WEB, TOP_SECTION = 20, 50, 100
#: A cell of a huge sample has so many ordinals at most, as a power of two.
CELL_BITS = 16


def collapse(variants: DataFrame) -> DataFrame:
    """One row per sample and rsID: the first place in order, the last call's content.
    Empty rsIDs go."""
    call = F.struct("chromosome", "position", "genotype")
    kept = variants.filter("rsid <> ''").groupBy("sample_id", "rsid")
    return kept.agg(F.min("ordinal").alias("first_ordinal"), F.max_by(call, "ordinal").alias("c")).select("sample_id", "rsid", "first_ordinal", "c.*")


def met(variants: DataFrame, slim: DataFrame) -> DataFrame:
    """Collapsed calls that have an annotation, with its columns. Other calls go before any
    shuffle: by a broadcast of the annotated rsIDs where they are few, by a Bloom filter
    where they are many."""
    slim, held = held_if_small(slim)
    if held:
        return collapse(variants.join(slim.select("rsid"), "rsid", "left_semi")).join(slim, "rsid")
    return collapse(variants.filter(may_be_in("rsid", slim, slim.count()))).join(slim, "rsid")


def _coarse(ordinal: Column, kind: str) -> Column:
    """A part of the order that holds ``2 ** CELL_BITS`` ordinals at most."""
    if kind.startswith("struct"):
        return F.struct(ordinal["block_start"], F.shiftright(ordinal["seq"], CELL_BITS))
    return F.shiftright(ordinal.cast("long"), CELL_BITS)


def ordered(found: DataFrame) -> DataFrame:
    """``result_order``: places by rank, then first occurrence, from 1 in each sample."""
    order = Window.partitionBy("sample_id").orderBy("significance_rank", "first_ordinal")
    return found.withColumn("result_order", F.row_number().over(order))


def ordered_in_cells(found: DataFrame) -> DataFrame:
    """The same for samples that are too large for a task: a sample's results are numbered in
    cells of one rank and one part of the order, and the cells' counts say where each
    begins. ``found`` is computed twice, for counts and for places."""
    cell = ["sample_id", "significance_rank", "__coarse"]
    parted = found.withColumn("__coarse", _coarse(F.col("first_ordinal"), dict(found.dtypes)["first_ordinal"]))
    before = Window.partitionBy("sample_id").orderBy("significance_rank", "__coarse").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = parted.withColumn("__place", F.row_number().over(Window.partitionBy(*cell).orderBy("first_ordinal")))
    out = placed.join(starts, cell).withColumn("result_order", (F.col("__start") + F.col("__place")).cast("int"))
    return out.drop("__coarse", "__place", "__start")


def with_entries(results: DataFrame, table: DataFrame) -> DataFrame:
    """Results with the lists of their annotations, which ``table`` has by rsID."""
    return results.join(table.select("rsid", "clinvar", "gwas"), "rsid")


def analyze(variants: DataFrame, table: DataFrame, include_benign: bool = False, traits_only: bool = False, huge_samples: bool = False) -> DataFrame:
    """Annotated calls in result order: ``result_order`` counts from 1 in each sample. Only
    rank and category go along; a table with lists has them joined to the results."""
    lists = [c for c in ("clinvar", "gwas") if c in table.columns]
    slim = table.drop(*lists)
    if not include_benign:
        slim = slim.filter(F.col("significance_rank") < BENIGN_FROM)
    if traits_only:
        slim = slim.filter(F.col("category") == "Traits")
    found = (ordered_in_cells if huge_samples else ordered)(met(variants, slim))
    return with_entries(found, table) if lists else found


def unannotated(variants: DataFrame, table: DataFrame) -> DataFrame:
    """Calls without an annotation; the others go before the shuffle."""
    return collapse(variants.join(table.select("rsid"), "rsid", "left_anti"))


def high_impact(results: DataFrame, gene_col: str = "gene") -> DataFrame:
    return results.withColumn("high_impact", is_high_impact_gene(F.col(gene_col)))


def top(results: DataFrame, n: int = TOP) -> DataFrame:
    return results.filter(F.col("result_order") <= n)


def top_per_category(results: DataFrame, n: int = TOP_SECTION) -> DataFrame:
    order = Window.partitionBy("sample_id", "category").orderBy("result_order")
    return results.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def summary(variants: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (repeats counted), results and significant results of each sample."""
    calls = variants.groupBy("sample_id").agg(F.count(F.lit(1)).alias("parsed"))
    found = results.groupBy("sample_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("significance_rank") <= SIGNIFICANT_TO).alias("significant"))
    return calls.join(found, "sample_id", "left").na.fill(0, ["results", "significant"])


def category_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("sample_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("result_order").alias("first_order"))


def top_categories(results: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent; the one that comes first in order wins ties."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("n"), "first_order")
    return category_counts(results).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def bucket_counts(variants: DataFrame, table: DataFrame) -> DataFrame:
    """Findings of each sample by weight: high, moderate (any other annotated), low."""
    if "strong" in table.columns:
        strong = F.col("strong")
    else:
        strong = F.exists("clinvar", lambda e: is_strong(e["clinical_significance"])) | F.exists("gwas", lambda e: is_strong_p(e["p_value"]))
    weights = table.select("rsid", F.when(strong, "high").otherwise("moderate").alias("bucket"))
    found = variants.filter("rsid <> ''").select("sample_id", "rsid").distinct().join(weights, "rsid", "left")
    b = F.coalesce("bucket", F.lit("low"))
    return found.groupBy("sample_id").agg(*[F.count_if(b == x).alias(x) for x in ("high", "moderate", "low")])
