"""The registered queries of the genotype jobs and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, texts
from ..operators import analysis, annotation, explanations, report
from ..operators.scratch import scratch_path, written_once
from ..operators.store import Store
from ..sources.genotypes import parse
from . import derived
from .derived import sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.annotations(annotation.last_by_rsid(derived.clinvar_lines(spark, sf_dir)), derived.gwas(spark, sf_dir))


def slim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, since an analysis counts it, makes a filter of it and joins it."""
    return written_once(annotation.slim_annotations(annotation.last_by_rsid(derived.clinvar_lines(spark, sf_dir)), derived.gwas(spark, sf_dir)))


def slim_results(spark: SparkSession, sf_dir: str, known: DataFrame | None = None, **options) -> DataFrame:
    """Results without the lists of their annotations; ``known`` is the slim table, where
    several analyses share it."""
    return analysis.analyze(derived.variants(spark, sf_dir), slim_table(spark, sf_dir) if known is None else known, **options)


def with_entries(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Results with the lists, built for their rsIDs only. They are written, since their
    rsIDs choose what is listed before they meet it."""
    found = written_once(found)
    return analysis.with_entries(found, annotation.entries_of(found, annotation.last_by_rsid(derived.clinvar_lines(spark, sf_dir)), derived.gwas(spark, sf_dir)))


def results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return with_entries(spark, sf_dir, slim_results(spark, sf_dir, **options))


def with_facts(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Results with the raw-data lines of their rsIDs."""
    return found.join(annotation.facts(annotation.last_by_rsid(derived.clinvar_lines(spark, sf_dir)), derived.gwas(spark, sf_dir)), "rsid")


def _flat_results(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "rsid", "chromosome", "position", "genotype", "category", "significance_rank", "n_clinvar", "n_gwas", "result_order")


def _parsed(layout: str | None) -> Query:
    return lambda s, d: parse(derived.genotype_lines(s, d, layout)).select("sample_id", F.col("ordinal.seq").alias("ordinal"), "rsid", "chromosome", "position", "genotype")


def clinvar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.last_by_rsid(derived.clinvar_lines(spark, sf_dir)).drop("last_evaluated")


def clinvar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of the first half's lines, then one of the rest."""
    lines = derived.clinvar_lines(spark, sf_dir)
    old, new = lines.filter("ordinal % 4 < 2"), lines.filter("ordinal % 4 >= 1")
    return annotation.upsert(annotation.last_by_rsid(old), annotation.last_by_rsid(new)).drop("last_evaluated")


def annotation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = F.col("clinvar"), F.col("gwas")
    return table(spark, sf_dir).select("rsid", F.size(c).alias("n_clinvar"), F.size(g).alias("n_gwas"), "significance_rank", "category", rules.gene(c, g).alias("gene"), rules.conditions(c, g).alias("conditions"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotation.lookup(derived.variants(spark, sf_dir), table(spark, sf_dir))
    c, g = F.col("clinvar"), F.col("gwas")
    return found.select("rsid", F.size(c).alias("n_clinvar"), F.size(g).alias("n_gwas"), texts.clinvar_lines(c).alias("clinvar_text"), texts.gwas_lines(g).alias("gwas_text"))


def unannotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.unannotated(derived.variants(spark, sf_dir), slim_table(spark, sf_dir)).select("sample_id", "rsid", "genotype")


def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.summary(derived.variants(spark, sf_dir), slim_results(spark, sf_dir))


def summary_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.bucket_counts(derived.variants(spark, sf_dir), slim_table(spark, sf_dir))


def high_impact_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.high_impact(slim_results(spark, sf_dir)).select("sample_id", "rsid", "gene", "high_impact")


def variant_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = texts.gene_warnings(F.col("gene"), F.col("rsid"))
    return slim_results(spark, sf_dir).select("sample_id", "rsid", F.array_join(notes, "\n").alias("warnings"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = with_entries(spark, sf_dir, analysis.top(slim_results(spark, sf_dir)))
    return shown.select("sample_id", "rsid", texts.system_prompt().alias("system"), texts.prompt().alias("prompt"))


def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = with_facts(spark, sf_dir, slim_results(spark, sf_dir))
    return shown.select("sample_id", "rsid", texts.fallback_of(F.col("facts")).alias("explanation"))


def safe_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("explanation")
    notes = F.when(texts.is_diagnostic(x), F.array(F.lit(texts.SAFETY_WARNING))).otherwise(F.array().cast("array<string>"))
    return derived.rows(spark, sf_dir, "texts").select("doc_id", texts.is_diagnostic(x).alias("flagged"), texts.wrapped(texts.safe_text(x), notes).alias("shown"))


def fallback_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples from S5 on meet only annotations outside the sections, so their results
    lie in none of them."""
    return report.cards(with_entries(spark, sf_dir, report.fallback_results(_partly_unknown(spark, sf_dir))))


def _partly_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, known = derived.variants(spark, sf_dir), slim_table(spark, sf_dir)
    early = analysis.analyze(calls.filter("sample_id < 'S5'"), known, include_benign=True)
    late = analysis.analyze(calls.filter("sample_id >= 'S5'"), known.filter("category = 'Unknown'"), include_benign=True)
    return early.unionByName(late)


def section_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cards(with_entries(spark, sf_dir, report.section_results(slim_results(spark, sf_dir))))


def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flat(with_entries(spark, sf_dir, analysis.top(slim_results(spark, sf_dir), analysis.TOP_SECTION)))


def collapsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some calls have no rsID."""
    calls = derived.variants(spark, sf_dir).withColumn("rsid", F.expr(BLANKED))
    return analysis.collapse(calls)


BLANKED = "CASE WHEN position % 70 = 0 THEN '' ELSE rsid END"
#: Results that take the rsIDs which have a warning of their own.
RENAMED = "CASE rsid WHEN 'rs20' THEN 'rs7412' WHEN 'rs40' THEN 'rs429358' ELSE rsid END"
#: Answers to a part of the results, some of them twice, some without a text.
ANSWERED = {
    "answer": "CASE WHEN result_order % 5 <> 1 THEN 'About ' || rsid || CASE result_order % 4 WHEN 1 THEN ': now You HAVE it.' WHEN 2 THEN ': it is guaranteed to come.' ELSE ', it is common.' END END",
    "reason": "CASE WHEN result_order % 10 = 1 THEN 'Request timed out' END",
}


def _renamed(found: DataFrame) -> DataFrame:
    return found.withColumn("rsid", F.expr(RENAMED))


def _found_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, written since answers are made of them too."""
    return written_once(slim_results(spark, sf_dir))


def _answers(asked: DataFrame) -> DataFrame:
    some = asked.filter("result_order % 3 <> 0")
    last = some.selectExpr("sample_id", "rsid", *[f"{e} AS {c}" for c, e in ANSWERED.items()], "CAST(2 AS BIGINT) AS ordinal")
    early = some.filter("result_order % 2 = 0").selectExpr("sample_id", "rsid", "'too early' AS answer", "CAST(NULL AS STRING) AS reason", "CAST(1 AS BIGINT) AS ordinal")
    return last.unionByName(early)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found_results(spark, sf_dir)
    asked = _renamed(with_facts(spark, sf_dir, found))
    return explanations.explained(asked, _answers(_renamed(found))).select("sample_id", "rsid", "answered", "flagged", "explanation")


def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answers come first, then the early ones, then the first lot again."""
    answers = _answers(_renamed(_found_results(spark, sf_dir)))
    store = Store(spark, scratch_path(spark))
    for lot in ("ordinal = 2", "ordinal = 1", "ordinal = 2"):
        explanations.merge_answers(store, answers.filter(lot))
    return store.read("answers")


def fallback_cards_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.fallback_results(_partly_unknown(spark, sf_dir))
    found = written_once(found)
    told = found.filter("result_order % 2 = 0").selectExpr("sample_id", "rsid", "'told of ' || rsid AS explanation")
    return report.cards(with_entries(spark, sf_dir, found), told)


def _two_loads(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, scratch_path(spark), buckets=16)
    lines, entries = derived.clinvar_lines(spark, sf_dir), derived.gwas(spark, sf_dir)
    annotation.load_tables(lines.filter("ordinal % 4 < 2"), entries.filter("id % 2 = 0"), store, ("1", "a"), "first")
    annotation.load_tables(lines.filter("ordinal % 4 >= 1"), entries.filter("id % 2 = 1"), store, ("2", "b"), "second", gwas_mode="append")
    return store


def stored_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = F.col("clinvar"), F.col("gwas")
    table = _two_loads(spark, sf_dir).read("annotations")
    return table.select("rsid", "n_clinvar", "n_gwas", "significance_rank", "category", "gene", texts.clinvar_lines(c).alias("clinvar_text"), texts.gwas_lines(g).alias("gwas_text"))


def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_loads(spark, sf_dir).read("loads")


def replaced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all samples, then those of one sample anew."""
    path, known = scratch_path(spark), slim_table(spark, sf_dir)
    report.replace_results(spark, slim_results(spark, sf_dir, known), path, 16)
    report.replace_results(spark, slim_results(spark, sf_dir, known, include_benign=True).filter("sample_id = 'S3'"), path)
    return _flat_results(report.stored_results(spark, path))


def queries() -> dict[str, Query]:
    of = lambda f, **o: lambda s, d: f(slim_results(s, d, **o))
    return {
        "parse_23andme": _parsed("23andme"),
        "parse_ancestry": _parsed("ancestry"),
        "parse_vcf": _parsed("vcf"),
        "parse_mixed": _parsed(None),
        "clinvar_table": clinvar_table,
        "clinvar_upsert": clinvar_upsert,
        "gwas_table": lambda s, d: derived.gwas(s, d).drop("pubmed_id", "link"),
        "annotation_table": annotation_table,
        "lookup": lookup,
        "store_statistics": lambda s, d: annotation.store_statistics(clinvar_table(s, d), derived.gwas(s, d)),
        "analyze": of(_flat_results),
        "analyze_with_benign": of(_flat_results, include_benign=True),
        "analyze_traits": of(_flat_results, traits_only=True),
        "analyze_huge_samples": of(_flat_results, huge_samples=True),
        "unannotated": unannotated,
        "top_results": of(lambda r: _flat_results(analysis.top(r))),
        "top_per_category": of(lambda r: analysis.top_per_category(r).select("sample_id", "category", "rsid", "place")),
        "analysis_summary": analysis_summary,
        "category_counts": of(analysis.category_counts),
        "top_categories": of(lambda r: analysis.top_categories(r).select("sample_id", "category", "n", "place")),
        "summary_buckets": summary_buckets,
        "high_impact_genes": high_impact_genes,
        "variant_warnings": variant_warnings,
        "prompts": prompts,
        "fallback_texts": fallback_texts,
        "safe_explanations": safe_explanations,
        "report_sections": of(report.sections),
        "section_cards": section_cards,
        "fallback_cards": fallback_cards,
        "flat_results": flat_results,
        "collapsed_calls": collapsed_calls,
        "explained": explained,
        "merged_answers": merged_answers,
        "fallback_cards_explained": fallback_cards_explained,
        "stored_annotations": stored_annotations,
        "load_records": load_records,
        "replaced_results": replaced_results,
    }


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _of_table(text: str, values: dict[str, int], default: int) -> str:
    exact = f"CASE {text} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
    part = "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN {v}" for k, v in values.items()) + f" ELSE {default} END"
    return f"CASE WHEN coalesce({text}, '') = '' THEN {default} ELSE coalesce({exact}, {part}) END"


_CLINVAR = sql("raw_clinvar") + f""",
  lines AS (SELECT ordinal, 'rs' || rs_num AS rsid, nullif(gene, '') AS gene, clinical_significance, conditions, review_status
            FROM raw_clinvar WHERE rs_num <> '-1' AND assembly <> 'NCBI36'),
  clinvar AS (SELECT *, {_of_table("trim(lower(review_status))", rules.REVIEW_STARS, 0)} AS stars FROM lines
              QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY ordinal DESC) = 1)"""
_GWAS = sql("raw_gwas") + """,
  gwas AS (SELECT id, 'rs' || snp_id_current AS rsid, trait, p_value, odds_ratio, mapped_gene, study FROM raw_gwas)"""
_VARIANTS = sql("variants").replace("variants AS", "lines_v AS", 1) + ", variants AS (SELECT * FROM lines_v WHERE genotype <> '--')"
_TABLE = f"""{_CLINVAR}, {_GWAS},
  lists AS (SELECT rsid, list(struct_pack(trait := trait, p_value := p_value, odds_ratio := odds_ratio, mapped_gene := mapped_gene) ORDER BY id) AS g,
                   arg_min(CASE WHEN regexp_matches(lower(trait), 'drug|pharmacogenom|medication|response') THEN 'Pharmacogenomics'
                                WHEN regexp_matches(lower(trait), 'risk|association') THEN 'Risk Factors' END, id) FILTER (regexp_matches(lower(trait), 'drug|pharmacogenom|medication|response|risk|association')) AS of_trait
            FROM gwas GROUP BY rsid),
  met AS (SELECT coalesce(c.rsid, l.rsid) AS rsid, c.rsid IS NOT NULL AS has_c, coalesce(l.g, []) AS g, l.of_trait, c.gene AS c_gene, clinical_significance AS sig, conditions AS cond, review_status, stars
          FROM clinvar c FULL JOIN lists l ON c.rsid = l.rsid),
  annotated AS (SELECT *, CASE WHEN coalesce(sig, '') <> '' THEN CAST({_of_table("lower(sig)", rules.SIGNIFICANCE_RANKS, 999)} AS DOUBLE) - stars * CAST(0.1 AS DOUBLE)
                               WHEN len(g) > 0 THEN CAST(4 AS DOUBLE) ELSE CAST(999 AS DOUBLE) END AS significance_rank,
                  CASE WHEN contains(lower(sig), 'pathogenic') THEN 'Health Conditions'
                       WHEN regexp_matches(lower(sig), 'risk factor|risk_factor|association') THEN 'Risk Factors'
                       WHEN contains(lower(sig), 'benign') THEN 'Carrier Status'
                       WHEN len(g) > 0 THEN coalesce(of_trait, 'Traits') ELSE 'Unknown' END AS category,
                  nullif(CASE WHEN has_c THEN c_gene ELSE g[1].mapped_gene END, '') AS gene,
                  list_filter(list_prepend(cond, list_transform(g, lambda x: x.trait)), lambda x: x IS NOT NULL AND x NOT IN ('', '-')) AS told
                FROM met),
  shown AS (SELECT *, CAST(has_c AS INTEGER) AS n_clinvar, CAST(len(g) AS INTEGER) AS n_gwas,
              coalesce(nullif(array_to_string(list_filter(told, lambda x, i: list_position(told, x) = i)[1:3], '; '), ''), 'No condition data') AS conditions
            FROM annotated)"""
_COLLAPSED = f"""{_VARIANTS},
  calls AS (SELECT sample_id, rsid, min(ordinal) AS first_ordinal, arg_max(chromosome, ordinal) AS chromosome, arg_max(position, ordinal) AS position, arg_max(genotype, ordinal) AS genotype
            FROM variants WHERE rsid <> '' GROUP BY sample_id, rsid)"""


def _results(where: str = "significance_rank < 8") -> str:
    return f"""WITH {_TABLE}, {_COLLAPSED},
  results AS (SELECT calls.*, shown.* EXCLUDE (rsid), CAST(row_number() OVER (PARTITION BY sample_id ORDER BY significance_rank, first_ordinal) AS INTEGER) AS result_order
              FROM calls JOIN shown ON calls.rsid = shown.rsid WHERE {where}),
  placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, category ORDER BY result_order) AS INTEGER) AS place FROM results),
  counts AS (SELECT sample_id, category, count(*) AS n, min(result_order) AS first_order FROM results GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    flat = "SELECT sample_id, rsid, chromosome, position, genotype, category, significance_rank, n_clinvar, n_gwas, result_order FROM results"
    parsed = f"WITH {sql('variants')} SELECT sample_id, ordinal, rsid, chromosome, position, genotype FROM variants WHERE genotype <> '--'"
    in_sections = "(" + ", ".join(f"'{s[1]}'" for s in report.SECTIONS) + ")"
    star = "CASE WHEN has_c THEN repeat('★', stars) || repeat('☆', 4 - stars) ELSE '' END"
    cards = f"""sample_id, rsid, category, result_order, significance_rank, genotype, chromosome, position, coalesce(gene, 'Unknown') AS gene, conditions,
      CASE WHEN has_c THEN coalesce(nullif(sig, ''), 'Unknown') ELSE 'GWAS association' END AS clinical_significance, {star} AS stars,
      CASE WHEN NOT has_c THEN '' WHEN stars >= 3 THEN 'green' WHEN stars >= 1 THEN 'amber' ELSE 'gray' END AS quality,
      CASE WHEN significance_rank <= 2 THEN 'High' WHEN significance_rank <= 4 THEN 'Moderate' WHEN significance_rank <= 6 THEN 'Low' ELSE 'Minimal' END AS rank_label, '' AS explanation"""
    warn = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in texts.WARNINGS.items()) + " END"
    genes = "(" + ", ".join(f"'{g}'" for g in rules.HIGH_IMPACT_GENES) + ")"
    titles = "(VALUES " + ", ".join(f"({n}, '{c}', '{t}', {_q(d)})" for n, c, t, d in report.SECTIONS) + ") s(section, category, title, description)"
    flagged = "regexp_matches(explanation, " + _q("|".join(texts.DIAGNOSTIC)) + ", 'i')"
    note = _q(texts.SAFETY_NOTE + "\n" + texts.NOTES_TITLE + "- " + texts.SAFETY_WARNING + "\n")
    told = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
    of_clinvar = f"CASE WHEN has_c THEN '- ' || {told('cond')} || ': ' || {told('sig')} || ' (' || {star} || ' ' || {told('review_status')} || ')' ELSE {_q(texts.NO_CLINVAR)} END"
    odds = "CASE WHEN coalesce(x.odds_ratio, '') <> '' THEN ', Odds Ratio = ' || x.odds_ratio ELSE '' END"
    of_gwas = f"CASE WHEN len(g) > 0 THEN array_to_string(list_transform(g, lambda x: '- ' || {told('x.trait')} || ': p-value = ' || {told('x.p_value')} || {odds} || ' (Mixed ancestry)'), chr(10)) ELSE {_q(texts.NO_GWAS)} END"
    facts = ["rsid", "genotype", "coalesce(gene, 'Unknown')", "chromosome", "CAST(position AS VARCHAR)", of_clinvar, of_gwas]
    request = _q(texts.PROMPT)
    for n, fact in enumerate(facts, 1):
        request = request.replace(f"%{n}$s", f"' || {fact} || '")
    told_why = lambda reason: f"""'Explanation: ' || {reason} || repeat(chr(10), 2) || 'Raw variant data:' || chr(10) || '- rsID: ' || rsid || chr(10) || '- Gene: ' || {facts[2]} || chr(10)
      || '- Chromosome: ' || chromosome || ', Position: ' || position || chr(10) || '- Genotype: ' || genotype
      || CASE WHEN has_c THEN repeat(chr(10), 2) || 'ClinVar Information:' || chr(10) || '  - ' || {told('cond')} || ': ' || {told('sig')} ELSE '' END
      || CASE WHEN len(g) > 0 THEN repeat(chr(10), 2) || 'GWAS Associations:' || chr(10) || array_to_string(list_transform(g, lambda x: '  - ' || {told('x.trait')} || ': p-value = ' || {told('x.p_value')}), chr(10)) ELSE '' END
      || repeat(chr(10), 2) || {_q(texts.ADVICE)}"""  # noqa: E731
    shown = told_why(_q(texts.NO_ANSWER))
    fallback = _results("sample_id < 'S5' OR category = 'Unknown'") + f"SELECT {cards} FROM results WHERE result_order <= 100 AND sample_id NOT IN (SELECT sample_id FROM results WHERE category IN {in_sections})"
    # Answers and warnings of the results that take other rsIDs. A sample may hold the other
    # rsID too: both results share the last answer to it, of equal ordinals the greater text.
    answered = f"regexp_matches(answer, {_q('|'.join(texts.DIAGNOSTIC))}, 'i')"
    notes = f"concat_ws('', '- ' || {warn('gene')} || chr(10), '- ' || {warn('rsid')} || chr(10))"
    asked = f"""asked AS (SELECT * REPLACE ({RENAMED} AS rsid) FROM results),
      given AS (SELECT sample_id, rsid, {ANSWERED["answer"]} AS answer, {ANSWERED["reason"]} AS reason FROM asked WHERE result_order % 3 <> 0),
      answers AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY sample_id, rsid ORDER BY answer DESC NULLS LAST, reason DESC NULLS LAST) = 1),
      told AS (SELECT asked.*, answers.answer, answers.reason FROM asked LEFT JOIN answers ON asked.sample_id = answers.sample_id AND asked.rsid = answers.rsid),
      noted AS (SELECT *, {notes} AS notes, coalesce({answered}, false) AS flagged FROM told)"""
    in_loads = lambda q: q.replace("gwas AS (SELECT id,", "gwas AS (SELECT (id % 2) * 1000000000000 + id AS id,").replace("PARTITION BY rsid ORDER BY ordinal DESC", "PARTITION BY rsid ORDER BY ordinal % 4 >= 1 DESC, ordinal DESC")
    record = lambda n, lines, entries: f"""SELECT '{["first", "second"][n - 1]}' AS last_update, '{n}' AS clinvar_version, '{"ab"[n - 1]}' AS gwas_version, c AS clinvar_rows, genes, g AS gwas_rows, c + g AS total_rows
            FROM (SELECT count(*) AS c, count(DISTINCT gene) AS genes FROM (SELECT gene FROM lines WHERE {lines} QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY ordinal % 4 >= 1 AND {n} = 2 DESC, ordinal DESC) = 1)), (SELECT count(*) AS g FROM gwas WHERE {entries})"""  # noqa: E731
    return {
        "parse_23andme": parsed,
        "parse_ancestry": parsed,
        "parse_vcf": parsed.replace("position, genotype FROM", "position, CASE genotype WHEN 'CT' THEN 'GT' ELSE genotype END AS genotype FROM"),
        "parse_mixed": parsed.replace("position, genotype FROM", "position, CASE WHEN genotype = 'CT' AND CAST(substr(sample_id, 2) AS INTEGER) % 3 = 2 THEN 'GT' ELSE genotype END AS genotype FROM"),
        "clinvar_table": f"WITH {_CLINVAR} SELECT rsid, gene, clinical_significance, conditions, review_status FROM clinvar",
        "clinvar_upsert": f"""WITH {_CLINVAR}
            SELECT rsid, gene, clinical_significance, conditions, review_status FROM lines
            QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY ordinal % 4 >= 1 DESC, ordinal DESC) = 1""",
        "gwas_table": f"WITH {_GWAS} SELECT * FROM gwas",
        "annotation_table": f"WITH {_TABLE} SELECT rsid, n_clinvar, n_gwas, significance_rank, category, gene, conditions FROM shown",
        "lookup": f"WITH {_TABLE}, {_VARIANTS} SELECT v.rsid, coalesce(n_clinvar, 0) AS n_clinvar, coalesce(n_gwas, 0) AS n_gwas, CASE WHEN s.rsid IS NULL THEN {_q(texts.NO_CLINVAR)} ELSE {of_clinvar} END AS clinvar_text, CASE WHEN s.rsid IS NULL THEN {_q(texts.NO_GWAS)} ELSE {of_gwas} END AS gwas_text FROM (SELECT DISTINCT rsid FROM variants) v LEFT JOIN shown s ON v.rsid = s.rsid",
        "store_statistics": f"WITH {_CLINVAR}, {_GWAS} SELECT c AS clinvar_rows, n AS genes, g AS gwas_rows, c + g AS total_rows FROM (SELECT count(*) AS c, count(DISTINCT gene) AS n FROM clinvar), (SELECT count(*) AS g FROM gwas)",
        "analyze": _results() + flat,
        "analyze_with_benign": _results("true") + flat,
        "analyze_huge_samples": _results() + flat,
        "analyze_traits": _results("significance_rank < 8 AND category = 'Traits'") + flat,
        "unannotated": f"WITH {_TABLE}, {_COLLAPSED} SELECT sample_id, rsid, genotype FROM calls WHERE rsid NOT IN (SELECT rsid FROM shown)",
        "top_results": _results() + flat + " WHERE result_order <= 20",
        "top_per_category": _results() + "SELECT sample_id, category, rsid, place FROM placed WHERE place <= 100",
        "analysis_summary": _results() + """SELECT v.sample_id, parsed, coalesce(n, 0) AS results, coalesce(s, 0) AS significant
            FROM (SELECT sample_id, count(*) AS parsed FROM variants GROUP BY 1) v
            LEFT JOIN (SELECT sample_id, count(*) AS n, count(*) FILTER (significance_rank <= 4) AS s FROM results GROUP BY 1) r ON v.sample_id = r.sample_id""",
        "category_counts": _results() + "SELECT * FROM counts",
        "top_categories": _results() + "SELECT sample_id, category, n, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first_order) AS INTEGER) AS place FROM counts QUALIFY place <= 5",
        "summary_buckets": f"""WITH {_TABLE}, {_COLLAPSED},
            weighed AS (SELECT sample_id, CASE WHEN s.rsid IS NULL THEN 'low' WHEN coalesce(contains(lower(sig), 'pathogenic'), false) OR len(list_filter(g, lambda x: x.p_value > 0 AND x.p_value < 1e-5)) > 0 THEN 'high' ELSE 'moderate' END AS bucket
                        FROM calls LEFT JOIN shown s ON calls.rsid = s.rsid)
            SELECT sample_id, count(*) FILTER (bucket = 'high') AS high, count(*) FILTER (bucket = 'moderate') AS moderate, count(*) FILTER (bucket = 'low') AS low FROM weighed GROUP BY 1""",
        "high_impact_genes": _results() + f"SELECT sample_id, rsid, gene, coalesce(gene IN {genes}, false) AS high_impact FROM results",
        "variant_warnings": _results() + f"SELECT sample_id, rsid, concat_ws(chr(10), {warn('gene')}, {warn('rsid')}) AS warnings FROM results",
        "safe_explanations": f"WITH {sql('texts')} SELECT doc_id, coalesce({flagged}, false) AS flagged, explanation || CASE WHEN {flagged} THEN {note} ELSE '' END || {_q(texts.DISCLAIMER.format(product='This library'))} AS shown FROM texts",
        "report_sections": _results() + f"SELECT sample_id, category, n, section, title, description FROM counts JOIN {titles} USING (category)",
        "section_cards": _results() + f"SELECT {cards} FROM placed WHERE place <= 100 AND category IN {in_sections}",
        "fallback_cards": fallback,
        "fallback_cards_explained": fallback.replace("'' AS explanation", "CASE WHEN result_order % 2 = 0 THEN 'told of ' || rsid ELSE '' END AS explanation"),
        "collapsed_calls": f"""WITH {_VARIANTS}, named AS (SELECT * REPLACE ({BLANKED} AS rsid) FROM variants)
            SELECT sample_id, rsid, min(ordinal) AS first_ordinal, arg_max(chromosome, ordinal) AS chromosome, arg_max(position, ordinal) AS position, arg_max(genotype, ordinal) AS genotype
            FROM named WHERE rsid <> '' GROUP BY sample_id, rsid""",
        "explained": _results().rstrip() + f""", {asked}
            SELECT sample_id, rsid, answer IS NOT NULL AS answered, flagged,
              CASE WHEN answer IS NULL THEN {told_why(f"coalesce(reason, {_q(texts.NO_ANSWER)})")}
                   ELSE answer || CASE WHEN flagged THEN {_q(texts.SAFETY_NOTE)} ELSE '' END || CASE WHEN notes <> '' THEN {_q(chr(10) + texts.NOTES_TITLE)} || notes ELSE '' END || {_q(texts.DISCLAIMER.format(product='This library'))} END AS explanation
            FROM noted""",
        "merged_answers": _results().rstrip() + f", {asked} SELECT sample_id, rsid, answer, reason, CAST(2 AS BIGINT) AS ordinal FROM answers",
        "stored_annotations": in_loads(f"WITH {_TABLE} SELECT rsid, n_clinvar, n_gwas, significance_rank, category, gene, {of_clinvar} AS clinvar_text, {of_gwas} AS gwas_text FROM shown"),
        "load_records": f"WITH {_CLINVAR}, {_GWAS} {record(1, 'ordinal % 4 < 2', 'id % 2 = 0')} UNION ALL {record(2, 'true', 'true')}",
        "replaced_results": _results("significance_rank < 8 OR sample_id = 'S3'") + flat,
        "prompts": _results() + f"SELECT sample_id, rsid, {_q(texts.SYSTEM_PROMPT.format(product='this library'))} AS system, {request} AS prompt FROM results WHERE result_order <= 20",
        "fallback_texts": _results() + f"SELECT sample_id, rsid, {shown} AS explanation FROM results",
        "flat_results": _results() + "SELECT sample_id, result_order AS significance_order, rsid, genotype, category, significance_rank, coalesce(gene, '-') AS gene, conditions FROM results WHERE result_order <= 100",
    }
