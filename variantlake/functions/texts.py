"""Warnings, prompts and safety checks of explanation texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import gene, star_text

# Messages by gene or rsID, phrases of a diagnosis, texts that are shown.
WARNINGS = {
    "BRCA1": "Variants in BRCA1 are associated with significantly elevated cancer risk. It is strongly recommended to discuss these results with a genetic counselor.",
    "BRCA2": "Variants in BRCA2 are associated with significantly elevated cancer risk. It is strongly recommended to discuss these results with a genetic counselor.",
    "rs429358": "APOE variants are associated with Alzheimer's disease risk. These results can have significant psychological impact. Consider speaking with a genetic counselor before reviewing.",
    "rs7412": "APOE variants are associated with Alzheimer's disease risk. These results can have significant psychological impact. Consider speaking with a genetic counselor before reviewing.",
    "TP53": "TP53 variants are associated with elevated cancer risk across multiple cancer types. Genetic counseling is strongly recommended.",
    "MLH1": "MLH1 variants are associated with Lynch syndrome and hereditary cancer risk. Genetic counseling is strongly recommended.",
    "MSH2": "MSH2 variants are associated with Lynch syndrome and hereditary cancer risk. Genetic counseling is strongly recommended.",
    "MSH6": "MSH6 variants are associated with Lynch syndrome and hereditary cancer risk. Genetic counseling is strongly recommended.",
    "PMS2": "PMS2 variants are associated with Lynch syndrome and hereditary cancer risk. Genetic counseling is strongly recommended.",
}
DIAGNOSTIC = (
    r"\byou have\b",
    r"\byou will develop\b",
    r"\byou are diagnosed\b",
    r"\bthis means you have\b",
    r"\byou definitely\b",
    r"\b100%\s*chance\b",
    r"\bguaranteed to\b",
    r"\bcertain to\b",
    r"\bwill certainly\b",
)
SAFETY_WARNING = "Explanation contained definitive medical language that has been flagged for review."
SAFETY_NOTE = "\n[Safety Note: This explanation has been flagged for potentially definitive language. Please review carefully and consult a healthcare provider.]"
NOTES_TITLE = "\n**⚠ Important Notes:**\n"
DISCLAIMER = (
    "\n---\n\n**Important Disclaimer:** This explanation is for educational purposes only and should not be interpreted as medical advice. "
    "Genetic findings can be complex and may have different implications for different individuals. "
    "Always consult with a qualified healthcare provider or genetic counselor before making any health decisions based on genetic information. "
    "{product} and its AI explanation tools do not provide medical diagnosis or treatment recommendations.\n"
)
NO_CLINVAR = "No ClinVar data available for this variant."
NO_GWAS = "No GWAS associations available for this variant."
ADVICE = "Please consult a genetic counselor or healthcare provider for interpretation of these findings."
NO_ANSWER = "AI explanations unavailable"
# Filled by format_string: rsID, genotype, gene, chromosome, position, ClinVar and GWAS lines.
PROMPT = """Please explain the following genetic variant finding for the user:

**Variant:** %1$s
**User's Genotype:** %2$s
**Gene:** %3$s
**Chromosome:** %4$s, Position: %5$s

**ClinVar Data:**
%6$s

**GWAS Associations:**
%7$s

Please provide:
1. A plain-English explanation of what this variant means
2. What the user's specific genotype (%2$s) implies
3. Any relevant lifestyle, dietary, or environmental context from research
4. Important caveats and limitations"""
SYSTEM_PROMPT = (
    "You are a genetics education assistant for {product}, an open-source genomics tool. Your role is to explain genetic variant findings in clear, accessible language. "
    "You MUST: 1) Use plain English that a non-scientist can understand. 2) Explain what the variant means in practical terms. "
    "3) Provide relevant lifestyle or dietary context from published research when applicable. 4) Always note limitations and uncertainties. "
    "5) Never make definitive medical diagnoses. 6) Cite the source databases (ClinVar, GWAS Catalog) and relevant studies. "
    "7) Recommend consulting a genetic counselor for clinically significant findings. Keep explanations concise (2-4 paragraphs). "
    "Be warm, informative, and reassuring without minimizing genuine risks."
)


def told(c: Column, default: str = "None") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def number_text(c: Column) -> Column:
    """A double as its shortest text: 5.3e-47, 0.0001, 12.0."""
    t = c.cast("string")
    sign = F.when(c < 0, "-").otherwise("")
    mantissa = F.translate(F.substring_index(t, "E", 1), "-.", "")
    exponent = F.substring_index(t, "E", -1).try_cast("int")
    digits = F.rtrim(mantissa, F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    scientific = F.concat(
        sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""),
        F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(sign, F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), F.lit("0")))
    large = F.concat(F.substring(large, F.lit(1), F.length(sign) + exponent + 1), F.lit("."), F.coalesce(F.nullif(F.substring(large, F.length(sign) + exponent + 2, F.length(large)), F.lit("")), F.lit("0")))
    return (
        F.when(F.isnan(c), "nan").when(t.contains("Inf"), F.concat(sign, F.lit("inf")))
        .when(~t.contains("E"), t).when((exponent < -4) | (exponent >= 16), scientific).when(exponent < 0, small).otherwise(large)
    )


def warnings(clinvar: Column, gwas: Column, rsid: Column) -> Column:
    """The gene's message, then the rsID's."""
    return gene_warnings(gene(clinvar, gwas), rsid)


def gene_warnings(gene: Column, rsid: Column) -> Column:
    """The same where the gene is known."""
    known = F.create_map(*[F.lit(x) for kv in WARNINGS.items() for x in kv])
    of = lambda c: F.when(c.isNotNull(), F.try_element_at(known, c))
    return F.array_compact(F.array(of(gene), of(rsid)))


def is_diagnostic(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + "|".join(DIAGNOSTIC)), F.lit(False))


def safe_text(text: Column) -> Column:
    return F.when(is_diagnostic(text), F.concat(text, F.lit(SAFETY_NOTE))).otherwise(text)


def wrapped(text: Column, notes: Column, product: str = "This library") -> Column:
    lines = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), "")
    section = F.when(F.size(notes) > 0, F.concat(F.lit("\n" + NOTES_TITLE), lines)).otherwise("")
    return F.concat(text, section, F.lit(DISCLAIMER.format(product=product)))


def _listed(entries: Column, line, none: str) -> Column:
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, line), "\n")).otherwise(none)


def clinvar_lines(clinvar: Column) -> Column:
    line = lambda e: F.concat(F.lit("- "), told(e["conditions"]), F.lit(": "), told(e["clinical_significance"]), F.lit(" ("), star_text(e["review_stars"]), F.lit(" "), told(e["review_status"]), F.lit(")"))
    return _listed(clinvar, line, NO_CLINVAR)


def gwas_lines(gwas: Column) -> Column:
    odds = lambda e: F.when(F.coalesce(e["odds_ratio"], F.lit("")) != "", F.concat(F.lit(", Odds Ratio = "), e["odds_ratio"])).otherwise("")
    line = lambda e: F.concat(F.lit("- "), told(e["trait"]), F.lit(": p-value = "), told(number_text(e["p_value"])), odds(e), F.lit(" (Mixed ancestry)"))
    return _listed(gwas, line, NO_GWAS)


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def _facts(f, named: Column | None = None) -> dict[str, Column]:
    position = F.when(F.coalesce(f("position"), F.lit(0)) == 0, "Unknown").otherwise(f("position").cast("string"))
    return {n: _or_unknown(f(n)) for n in ("rsid", "genotype", "chromosome")} | {"position": position, "gene": gene(f("clinvar"), f("gwas"), "Unknown") if named is None else _or_unknown(named)}


def prompt(f=F.col) -> Column:
    """The request to a language model for one result; ``f`` gives its columns."""
    x = _facts(f)
    return F.format_string(PROMPT, x["rsid"], x["genotype"], x["gene"], x["chromosome"], x["position"], clinvar_lines(f("clinvar")), gwas_lines(f("gwas")))


def system_prompt(product: str = "this library") -> Column:
    """What goes before every request."""
    return F.lit(SYSTEM_PROMPT.format(product=product))


def clinvar_fact(conditions: Column, significance: Column) -> Column:
    """The line of a ClinVar entry in the raw data."""
    return F.concat(F.lit("  - "), told(conditions), F.lit(": "), told(significance))


def gwas_fact(trait: Column, p_value: Column) -> Column:
    """The line of an association in the raw data."""
    return F.concat(F.lit("  - "), told(trait), F.lit(": p-value = "), told(number_text(p_value)))


def fact_blocks(clinvar_facts: Column, gwas_facts: Column) -> Column:
    """Both lists of lines under their titles; nothing for an empty one."""
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(lines, "\n"))).otherwise("")
    return F.concat(block("ClinVar Information", clinvar_facts), block("GWAS Associations", gwas_facts))


def fallback_text(f=F.col, reason: str | Column = NO_ANSWER) -> Column:
    """What is shown of a result when no model explains it, with the reason."""
    facts = fact_blocks(
        F.transform(f("clinvar"), lambda e: clinvar_fact(e["conditions"], e["clinical_significance"])),
        F.transform(f("gwas"), lambda e: gwas_fact(e["trait"], e["p_value"])),
    )
    return _raw_data(_facts(f), reason, facts)


def fallback_of(facts: Column, f=F.col, reason: str | Column = NO_ANSWER) -> Column:
    """The same for a result that has its gene, and its rsID's ``fact_blocks`` instead of the
    lists."""
    return _raw_data(_facts(f, f("gene")), reason, facts)


def _raw_data(x: dict[str, Column], reason: str | Column, facts: Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.concat(
        F.lit("Explanation: "), reason, F.lit("\n\nRaw variant data:\n- rsID: "), x["rsid"], F.lit("\n- Gene: "), x["gene"],
        F.lit("\n- Chromosome: "), x["chromosome"], F.lit(", Position: "), x["position"], F.lit("\n- Genotype: "), x["genotype"],
        facts, F.lit("\n\n" + ADVICE),
    )
