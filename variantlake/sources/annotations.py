"""The two public annotation tables from their tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import blank, no_dash, normal_rsid, real_number, strip
from .genotypes import numbered

# Places in a ClinVar line, names in a GWAS header.
CLINVAR = {"gene": 4, "clinical_significance": 6, "last_evaluated": 8, "rs_num": 9, "conditions": 13, "assembly": 16, "review_status": 24}
CLINVAR_FIELDS = 25
ASSEMBLIES = ("GRCh37", "GRCh38")
GWAS = {"snps": "SNPS", "snp_id_current": "SNP_ID_CURRENT", "trait": "DISEASE/TRAIT", "p_value": "P-VALUE", "odds_ratio": "OR or BETA", "mapped_gene": "MAPPED_GENE", "study": "STUDY", "pubmed_id": "PUBMEDID", "link": "LINK"}


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``file, ordinal, line`` of an annotation file, and its first line; a missing path and
    a file without a line raise."""
    lines = spark.read.text(path)
    first = lines.head()
    if first is None:
        raise ValueError(f"Empty annotation file: {path}")
    return numbered(lines.select("value", "_metadata")), first[0]


def normal_clinvar(rows: DataFrame) -> DataFrame:
    """Rows with raw text columns named as in ``CLINVAR`` and ``ordinal``: those of the
    two assemblies that have an rsID, blanks null."""
    text = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    number = strip(F.col("rs_num"))
    kept = rows.filter(~blank(number) & (number != "-1") & strip(F.col("assembly")).isin(*ASSEMBLIES))
    return kept.select("ordinal", normal_rsid(number).alias("rsid"), *[text(c).alias(c) for c in ("gene", "clinical_significance", "conditions", "review_status", "last_evaluated")])


def read_clinvar(spark: SparkSession, path: str) -> DataFrame:
    fields = F.split("line", "\t", -1)
    lines = read_lines(spark, path)[0].filter(~F.col("line").startswith("#AlleleID") & (F.size(fields) >= CLINVAR_FIELDS))
    return normal_clinvar(lines.select("ordinal", *[F.get(fields, F.lit(i)).alias(c) for c, i in CLINVAR.items()]))


def normal_gwas(rows: DataFrame) -> DataFrame:
    """Rows with ``id`` and raw text columns named as in ``GWAS`` (nulls where a column
    is missing)."""
    rsid: Column = F.coalesce(no_dash(F.col("snp_id_current")), no_dash(F.col("snps")))
    named = rows.withColumn("__rsid", rsid).filter("__rsid is not null")
    return named.select(
        "id", normal_rsid(F.col("__rsid")).alias("rsid"), F.nullif(strip(F.col("trait")), F.lit("")).alias("trait"),
        real_number(F.col("p_value")).alias("p_value"), *[no_dash(F.col(c)).alias(c) for c in ("odds_ratio", "mapped_gene", "study", "pubmed_id", "link")],
    )


def read_gwas(spark: SparkSession, path: str) -> DataFrame:
    """Columns go by the names in the first line, in any order."""
    lines, header = read_lines(spark, path)
    names = header.split("\t")
    at = {c: names.index(n) for c, n in GWAS.items() if n in names}
    if not at:
        raise ValueError("no known column in the GWAS header")
    fields = F.split("line", "\t", -1)
    last = max(at.values())
    # A line one field short passes only where what it lacks is an rsID that is not needed.
    enough = F.size(fields) > last
    if at.get("snps") == last and "snp_id_current" in at:
        enough |= (F.size(fields) == last) & no_dash(F.get(fields, F.lit(at["snp_id_current"]))).isNotNull()
    first = (F.col("ordinal.block_start") == 0) & (F.col("line") == F.lit(header))
    raw = lines.filter(enough & ~first)
    return normal_gwas(raw.select(F.col("ordinal").alias("id"), *[(F.get(fields, F.lit(at[c])) if c in at else F.lit(None).cast("string")).alias(c) for c in GWAS]))
