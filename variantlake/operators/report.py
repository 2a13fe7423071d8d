"""What a report shows, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .analysis import TOP_SECTION, category_counts, top, top_per_category
from .store import BUCKETS, Store

# Sections in order, by category.
SECTIONS = (
    (1, "Health Conditions", "Health Conditions", "Variants classified as pathogenic or likely pathogenic by ClinVar."),
    (2, "Risk Factors", "Risk Factors", "Variants associated with increased risk for certain conditions."),
    (3, "Pharmacogenomics", "Pharmacogenomics", "Variants that may affect drug metabolism or response."),
    (4, "Traits", "Trait Associations", "Variants associated with traits identified in genome-wide studies."),
    (5, "Carrier Status", "Carrier Status", "Benign or carrier-status variants."),
)


def sections(results: DataFrame) -> DataFrame:
    """Sections that have results, with their counts."""
    five = results.sparkSession.createDataFrame(list(SECTIONS), "section int, category string, title string, description string")
    return category_counts(results).drop("first_order").join(F.broadcast(five), "category")  # five rows


def cards(results: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """A row per displayed result. Explanations have sample_id, rsid, explanation."""
    c, g = F.col("clinvar"), F.col("gwas")
    stars, quality = rules.review_display(c)
    out = results.select(
        "sample_id", "rsid", "category", "result_order", "significance_rank",
        F.coalesce(F.nullif("genotype", F.lit("")), F.lit("-")).alias("genotype"),
        F.coalesce(F.nullif("chromosome", F.lit("")), F.lit("N/A")).alias("chromosome"), "position",
        rules.gene(c, g, "Unknown").alias("gene"), rules.conditions(c, g).alias("conditions"),
        rules.significance_text(c).alias("clinical_significance"), stars.alias("stars"), quality.alias("quality"),
        rules.rank_label(F.col("significance_rank")).alias("rank_label"),
    )
    if explanations is None:
        return out.withColumn("explanation", F.lit(""))
    return out.join(explanations, ["sample_id", "rsid"], "left").withColumn("explanation", F.coalesce("explanation", F.lit("")))


def section_results(results: DataFrame) -> DataFrame:
    """The first 100 of each of the five sections."""
    return top_per_category(results.filter(F.col("category").isin(*[s[1] for s in SECTIONS])), TOP_SECTION)


def section_cards(results: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    return cards(section_results(results), explanations)


def fallback_results(results: DataFrame) -> DataFrame:
    """The first 100 of all for samples whose results lie in none of the sections."""
    shown = results.filter(F.col("category").isin(*[s[1] for s in SECTIONS])).select("sample_id").distinct()
    return top(results.join(shown, "sample_id", "left_anti"), TOP_SECTION)


def fallback_cards(results: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    return cards(fallback_results(results), explanations)


def flat(results: DataFrame, n: int = TOP_SECTION) -> DataFrame:
    return top(results, n).select(
        "sample_id", F.col("result_order").alias("significance_order"), "rsid", "genotype", "category", "significance_rank",
        rules.gene(F.col("clinvar"), F.col("gwas"), "-").alias("gene"), rules.conditions(F.col("clinvar"), F.col("gwas")).alias("conditions"),
    )


def write_results(df: DataFrame, path: str, form: str = "parquet", by: str | None = "category") -> None:
    """Parquet (by category), or flat rows as JSON or CSV."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(by) if by and form == "parquet" else writer).save(path)


def replace_results(spark: SparkSession, results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes results into the store under ``path``: those of a sample replace its earlier
    ones, other samples keep theirs. Samples share buckets, so files stay few."""
    Store(spark, path, buckets).replace("results", results, ["sample_id"], "sample_id")


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read("results")
