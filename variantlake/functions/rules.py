"""Significance, quality, category and display rules.

Texts are matched in the tables' order: a later key never wins over an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stars of a review status, ranks of a significance.
REVIEW_STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, multiple submitters": 2,
    "criteria provided, conflicting interpretations": 1,
    "criteria provided, single submitter": 1,
    "no assertion for the individual variant": 0,
    "no assertion criteria provided": 0,
    "no assertion provided": 0,
}
SIGNIFICANCE_RANKS = {
    "pathogenic": 1,
    "likely pathogenic": 2,
    "pathogenic/likely pathogenic": 2,
    "risk factor": 3,
    "association": 4,
    "protective": 5,
    "conflicting data": 6,
    "conflicting interpretations": 6,
    "uncertain significance": 7,
    "likely benign": 8,
    "benign": 10,
    "benign/likely benign": 10,
}
UNRANKED = 999
GWAS_RANK = 4.0
STAR_WEIGHT = 0.1
BENIGN_FROM = 8
SIGNIFICANT_TO = 4

# Genes of high impact.
HIGH_IMPACT_GENES = (
    "BRCA1", "BRCA2", "APOE", "TP53", "MLH1", "MSH2", "MSH6", "PMS2",
    "APC", "MUTYH", "CDKN2A", "STK11", "PTEN", "RB1", "CHEK2",
    "PALB2", "RAD51C", "RAD51D", "BARD1", "ATM", "NF1", "VHL",
    "SDHA", "SDHB", "SDHC", "SDHD", "LDLR", "PCSK9", "APOB",
)

CLINVAR_ENTRY = "struct<rsid:string,gene:string,clinical_significance:string,conditions:string,review_status:string,review_stars:int>"
GWAS_ENTRY = "struct<rsid:string,trait:string,p_value:double,odds_ratio:string,mapped_gene:string,study:string,pubmed_id:string>"


#: White space of any script, as Unicode's property has it.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """White space of any script removed at both ends; without an expression, which costs
    many times as much and is repeated wherever the column is used."""
    return F.trim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _table_value(text: Column, table: dict[str, int], default: int) -> Column:
    exact = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), text)
    contained = F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in table.items()], F.lit(default))
    return F.coalesce(exact, contained)


def review_stars(status: Column) -> Column:
    """0 to 4; blank and unknown texts have none."""
    return F.when(blank(status), F.lit(0)).otherwise(_table_value(strip(F.lower(status)), REVIEW_STARS, 0))


def base_rank(significance: Column) -> Column:
    return F.when(blank(significance), F.lit(UNRANKED)).otherwise(_table_value(F.lower(significance), SIGNIFICANCE_RANKS, UNRANKED))


def weighted_rank(significance: Column, stars: Column, has_gwas: Column) -> Column:
    return (
        F.when(~blank(significance), base_rank(significance) - stars * F.lit(STAR_WEIGHT))
        .when(has_gwas, F.lit(GWAS_RANK))
        .otherwise(F.lit(float(UNRANKED)))
        .cast("double")
    )


def _has(c: Column, *words: str) -> Column:
    return F.coalesce(c.rlike("|".join(words)), F.lit(False))


def trait_category(trait: Column) -> Column:
    """What a GWAS trait tells of the category; null where it tells nothing."""
    t = F.lower(trait)
    return F.when(_has(t, "drug", "pharmacogenom", "medication", "response"), "Pharmacogenomics").when(_has(t, "risk", "association"), "Risk Factors")


def category_of(significance: Column, has_gwas: Column, first_told: Column) -> Column:
    """From the significance; else what the first telling trait tells decides."""
    sig = F.lower(significance)
    return (
        F.when(_has(sig, "pathogenic"), "Health Conditions")
        .when(_has(sig, "risk factor", "risk_factor", "association"), "Risk Factors")
        .when(_has(sig, "benign"), "Carrier Status")
        .when(has_gwas, F.coalesce(first_told, F.lit("Traits")))
        .otherwise("Unknown")
    )


def category(significance: Column, gwas: Column) -> Column:
    told = F.filter(F.transform(gwas, lambda e: trait_category(e["trait"])), lambda x: x.isNotNull())
    return category_of(significance, F.size(gwas) > 0, F.get(told, F.lit(0)))


def is_strong(significance: Column) -> Column:
    return F.coalesce(F.lower(significance).contains("pathogenic"), F.lit(False))


def is_strong_p(p: Column) -> Column:
    """The written exponent lies below -5."""
    return F.coalesce((p > 0) & (p < F.lit(1e-5)), F.lit(False))


def gene(clinvar: Column, gwas: Column, default: str | None = None) -> Column:
    """The ClinVar gene where there is an entry (no fallback), else the first mapped one."""
    found = F.when(F.size(clinvar) > 0, F.get(clinvar, F.lit(0))["gene"]).otherwise(F.get(gwas, F.lit(0))["mapped_gene"])
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def is_high_impact_gene(c: Column) -> Column:
    return F.coalesce(c.isin(*HIGH_IMPACT_GENES), F.lit(False))


def conditions(clinvar: Column, gwas: Column) -> Column:
    texts = F.concat(F.transform(F.slice(clinvar, 1, 1), lambda e: e["conditions"]), F.transform(gwas, lambda e: e["trait"]))
    told = F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & ~t.isin("", "-")))
    return F.when(F.size(told) > 0, F.array_join(F.slice(told, 1, 3), "; ")).otherwise("No condition data")


def significance_text(clinvar: Column) -> Column:
    own = F.get(clinvar, F.lit(0))["clinical_significance"]
    return F.when(F.size(clinvar) > 0, F.coalesce(F.nullif(own, F.lit("")), F.lit("Unknown"))).otherwise("GWAS association")


def star_text(stars: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), stars), F.repeat(F.lit("☆"), 4 - stars))


def review_display(clinvar: Column) -> tuple[Column, Column]:
    """Stars and quality class of the first entry; empty without one."""
    stars = F.get(clinvar, F.lit(0))["review_stars"]
    shown = F.size(clinvar) > 0
    quality = F.when(stars >= 3, "green").when(stars >= 1, "amber").otherwise("gray")
    return F.when(shown, star_text(stars)).otherwise(""), F.when(shown, quality).otherwise("")


def rank_label(rank: Column) -> Column:
    return F.when(rank <= 2, "High").when(rank <= 4, "Moderate").when(rank <= 6, "Low").otherwise("Minimal")


def genotype_of_gt(gt: Column, ref: Column, alt: Column) -> Column:
    """Alleles of a GT field: two sorted, one doubled; null where any is missing."""
    alleles = F.concat(F.array(ref), F.split(alt, ","))
    named = F.transform(
        F.split(gt, F.when(gt.contains("|"), r"\|").otherwise("/")),
        lambda a: F.when(a.rlike(r"^\s*[+]?[0-9]+\s*$"), F.get(alleles, F.least(strip(a).try_cast("bigint"), F.lit(1_000_000)).cast("int"))),
    )
    whole = ~F.exists(named, lambda x: x.isNull())
    return F.when(
        whole,
        F.when(F.size(named) == 2, F.array_join(F.array_sort(named), "")).when(F.size(named) == 1, F.repeat(F.get(named, F.lit(0)), 2)),
    )


def normal_rsid(c: Column) -> Column:
    return F.when(c.startswith("rs"), c).otherwise(F.concat(F.lit("rs"), c))


def no_dash(c: Column) -> Column:
    """Stripped; empty and dash become null."""
    text = strip(c)
    return F.when(~text.isin("", "-"), text)


def whole_number(c: Column) -> Column:
    """Null where the text is no whole number; single underscores between digits count as none."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))


def real_number(c: Column) -> Column:
    t = strip(c)
    plain = t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, t.try_cast("double")).when(F.lower(t).rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(F.lower(t).rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
