"""Inputs of the registered queries: calls, annotation rows and texts that the given
tables yield by expressions which Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import SIGNIFICANCE_RANKS, REVIEW_STARS
from ..sources.annotations import normal_clinvar, normal_gwas


def _case(of: str, values: list[str | None]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


EXPRESSIONS = {
    "variants": ("orders", {
        "sample_id": "'S' || (o_orderkey % 10)",
        "ordinal": "o_orderkey",
        "rsid": "'rs' || o_custkey",
        "chromosome": "CAST(1 + o_custkey % 22 AS STRING)",
        "position": "CAST(1000 + o_custkey * 10 AS BIGINT)",
        "genotype": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'AA' WHEN '2' THEN 'AG' WHEN '3' THEN 'GG' WHEN '4' THEN 'CT' ELSE '--' END",
    }),
    "raw_clinvar": ("part", {
        "ordinal": "p_partkey",
        "rs_num": "CASE WHEN p_partkey % 17 = 0 THEN '-1' ELSE CAST(p_partkey - p_partkey % 2 AS STRING) END",
        "assembly": "CASE p_partkey % 5 WHEN 0 THEN 'NCBI36' WHEN 1 THEN 'GRCh37' WHEN 2 THEN 'GRCh37' ELSE 'GRCh38' END",
        "gene": "CASE WHEN p_size = 50 THEN '' WHEN p_size = 49 THEN 'BRCA1' WHEN p_size = 48 THEN 'APOE' WHEN p_size = 47 THEN 'MLH1' ELSE p_brand END",
        "clinical_significance": _case("p_size % 14", [*SIGNIFICANCE_RANKS, "Conflicting interpretations of pathogenicity", "drug response"]),
        "conditions": "CASE WHEN p_size % 11 = 0 THEN '-' ELSE p_name END",
        "review_status": _case("p_partkey % 10", list(REVIEW_STARS)),
        "last_evaluated": "CAST(NULL AS STRING)",
    }),
    "raw_gwas": ("events", {
        "id": "event_id",
        "snps": "'-'",
        "snp_id_current": "CAST(user_id * 5 AS STRING)",
        "trait": "CASE WHEN user_id % 3 = 0 THEN 'Height' WHEN event_id % 5 = 4 THEN NULL ELSE CASE event_id % 5 WHEN 0 THEN 'Drug response' WHEN 1 THEN 'Disease risk' WHEN 2 THEN 'Height' WHEN 3 THEN '-' END END",
        "p_value": "value / 1e7",
        "odds_ratio": "CAST(event_id % 9 AS STRING)",
        "mapped_gene": "'G' || (user_id % 7)",
        "study": "'study ' || (event_id % 3)",
        "pubmed_id": "CAST(NULL AS STRING)",
        "link": "CAST(NULL AS STRING)",
    }),
    "texts": ("documents", {
        "doc_id": "doc_id",
        "explanation": "text || CASE doc_id % 9 WHEN 0 THEN ' So you have it.' WHEN 1 THEN ' There is a 100% chance.' WHEN 2 THEN ' It is CERTAIN TO come.' ELSE '' END",
    }),
}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = EXPRESSIONS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(name: str) -> str:
    table, columns = EXPRESSIONS[name]
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "variants").filter("genotype <> '--'")


def clinvar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_clinvar(rows(spark, sf_dir, "raw_clinvar"))


def gwas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_gwas(rows(spark, sf_dir, "raw_gwas").withColumn("p_value", F.col("p_value").cast("string")))


_LINE_FORMS = {
    "23andme": "concat_ws('\t', rsid, chromosome, position, genotype)",
    "ancestry": "concat_ws('\t', rsid, chromosome, position, substr(genotype, 1, 1), substr(genotype, 2, 1))",
    "vcf": "concat_ws('\t', chromosome, position, rsid, 'A', 'G,T', '.', '.', '.', 'GT:DP', CASE genotype WHEN 'AA' THEN '0/0:9' WHEN 'AG' THEN '1|0:9' WHEN 'GG' THEN '1' WHEN 'CT' THEN '2/1:7' ELSE './.:0' END)",
}
_LINE_HEADS = {"23andme": ["# rsid\tchromosome\tposition\tgenotype"], "ancestry": ["#export", "rsid\tchromosome\tposition\tallele1\tallele2"], "vcf": ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]}


def genotype_lines(spark: SparkSession, sf_dir: str, layout: str | None = None) -> DataFrame:
    """The calls as lines of genotype files, one file a sample; without a layout the samples
    have the three in turn."""
    forms = list(_LINE_FORMS)
    calls = rows(spark, sf_dir, "variants").withColumn("form", F.lit(layout) if layout else F.get(F.array(*map(F.lit, forms)), F.substring("sample_id", 2, 9).cast("int") % len(forms)))
    place = lambda seq: F.struct(F.lit(0).cast("bigint").alias("block_start"), seq.cast("bigint").alias("seq")).alias("ordinal")
    pick = lambda of: F.coalesce(*[F.when(F.col("form") == f, of(f)) for f in forms])
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("ordinal")) + 1
    data = calls.select(F.col("sample_id").alias("file"), place(F.col("ordinal")), pick(lambda f: F.expr(_LINE_FORMS[f])).alias("line"), nth.cast("bigint").alias("nth"))
    head = calls.select(F.col("sample_id").alias("file"), "form").distinct().select("file", F.posexplode(pick(lambda f: F.array(*[F.lit(h) for h in _LINE_HEADS[f]]))).alias("n", "line"))
    return head.select("file", place(F.col("n") - 10), "line", F.col("n").cast("bigint").alias("nth")).unionByName(data)
