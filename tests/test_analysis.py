"""Analysis: the golden table of all formats, slim plans, busy rsIDs and huge samples."""

import random

import pytest
from pyspark.sql import functions as F

from variantlake.functions import rules
from variantlake.operators import analysis, annotation, joins, report
from variantlake.plans import derived, registry
from variantlake.sources.genotypes import read_genotypes

DIR = "/root/testdata/sf0.001"

CLINVAR = [
    ("rs429358", "APOE", "risk factor", "Alzheimer disease", "criteria provided, single submitter", "2020-01-01"),
    ("rs7412", "APOE", "risk factor", "Alzheimer disease", "criteria provided, single submitter", "2020-01-01"),
    ("rs12913832", "OCA2", "benign", "Eye color", "benign", "2019-01-01"),
    ("rs4988235", "MCM6", "association", "Lactose intolerance", "criteria provided, single submitter", "2018-01-01"),
    ("rs762551", "CYP1A2", "pathogenic", "Caffeine sensitivity", "criteria provided, multiple submitters", "2021-01-01"),
]
GWAS = [
    (1, "rs429358", "Alzheimer's disease", 5.3e-47, "1.73", "APOE", "s", None, None),
    (2, "rs7412", "Cognitive decline", 3.2e-15, "1.35", "APOE", "s", None, None),
    (3, "rs4988235", "Lactose intolerance", 2.1e-100, "2.1", "MCM6", "s", None, None),
    (4, "rs1052373", "Caffeine metabolism", 1.5e-20, "1.5", "CYP1A2", "s", None, None),
    (5, "rs1234", "General trait", 1e-5, "1.1", "GENE1", "s", None, None),
]
CLINVAR_SCHEMA = "rsid string, gene string, clinical_significance string, conditions string, review_status string, last_evaluated string"
GWAS_SCHEMA = "id long, rsid string, trait string, p_value double, odds_ratio string, mapped_gene string, study string, pubmed_id string, link string"
CALLS = [("rs429358", "C", "T"), ("rs7412", "T", "C"), ("rs1234", "A", "A"), ("rs4988235", "C", "C"), ("rs762551", "A", "A"), ("rs12913832", "G", "G"), ("rs1052373", "A", "A")]
OTHERS = [(f"rs9{i:05}", "A", "G") for i in range(11)]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(CLINVAR, CLINVAR_SCHEMA), spark.createDataFrame(GWAS, GWAS_SCHEMA)


def files(form):
    calls = [*CALLS, *OTHERS]
    place = lambda i: f"{1 + i % 22}\t{1000 + i}"
    if form == "23andme":
        lines = ["# rsid\tchromosome\tposition\tgenotype", *(f"{r}\t{place(i)}\t{a}{b}" for i, (r, a, b) in enumerate(calls)), "rs8\t1\t5\t--", "i9\t1\t6\t--"]
    elif form == "ancestry":
        lines = ["#x", "rsid\tchromosome\tposition\tallele1\tallele2", *(f"{r}\t{place(i)}\t{a}\t{b}" for i, (r, a, b) in enumerate(calls)), "rs8\t1\t5\t0\t0", "rs9\t1\t6\t0\t0"]
    else:
        lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]
        lines += [f"{place(i)}\t{r}\t{a}\t{b if a != b else '.'}\t.\t.\t.\tGT\t{'0/0' if a == b else '0/1'}" for i, (r, a, b) in enumerate(calls)]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("form", ["23andme", "ancestry", "vcf"])
@pytest.mark.parametrize("slim", [True, False])
def test_golden_table(spark, golden, tmp_path, form, slim):
    (tmp_path / "f.txt").write_text(files(form))
    calls = read_genotypes(spark, str(tmp_path))
    table = (annotation.slim_annotations if slim else annotation.annotations)(*golden)
    results = analysis.analyze(calls, table)
    got = [(r.rsid, r.genotype, r.category, round(r.significance_rank, 9)) for r in results.orderBy("result_order").collect()]
    sorted_ct = "CT" if form == "vcf" else "TC"
    want = [
        ("rs762551", "AA", "Health Conditions", 0.8), ("rs429358", "CT", "Risk Factors", 2.9), ("rs7412", sorted_ct, "Risk Factors", 2.9),
        ("rs4988235", "CC", "Risk Factors", 3.9), ("rs1234", "AA", "Traits", 4.0), ("rs1052373", "AA", "Traits", 4.0),
    ]
    assert got == want
    s = analysis.summary(calls, results).first()
    assert (s.parsed, s.results, s.significant) == (18, 6, 6)
    benign = analysis.analyze(calls, table, include_benign=True).orderBy("result_order").collect()[-1]
    assert len(got) == benign.result_order - 1 and (benign.rsid, benign.genotype, benign.category, benign.significance_rank) == ("rs12913832", "GG", "Carrier Status", 10.0)
    assert sorted(r.rsid for r in analysis.analyze(calls, table, traits_only=True).collect()) == ["rs1052373", "rs1234"]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_slim_is_what_the_lists_say(spark):
    """Ordered aggregates against the lists, with busy rsIDs, ties of place and nulls."""
    rng = random.Random(1)
    sigs = [*rules.SIGNIFICANCE_RANKS, "Conflicting interpretations of pathogenicity", "drug response", "", None]
    clinvar = [(f"rs{i}", rng.choice(["G1", "", None]), rng.choice(sigs), "c", rng.choice([*rules.REVIEW_STARS, None]), None) for i in range(80)]
    traits = ["Drug response", "Disease risk", "Height", "-", None, "Warfarin medication", "association"]
    gwas = [(i, f"rs{5 if i % 3 else rng.randrange(40, 160)}", rng.choice(traits), rng.choice([1e-9, 1e-5, 0.0, None, 0.5]), None, rng.choice(["M1", "", None]), None, None, None) for i in range(3000)]
    rng.shuffle(gwas)
    c, g = spark.createDataFrame(clinvar, CLINVAR_SCHEMA), spark.createDataFrame(gwas, GWAS_SCHEMA).repartition(7)
    lists = annotation.annotations(c, g)
    strong = F.exists("clinvar", lambda e: rules.is_strong(e["clinical_significance"])) | F.exists("gwas", lambda e: rules.is_strong_p(e["p_value"]))
    want = lists.select("rsid", F.size("clinvar").alias("n_clinvar"), F.size("gwas").alias("n_gwas"), "significance_rank", "category", rules.gene(F.col("clinvar"), F.col("gwas")).alias("gene"), strong.alias("strong"))
    assert rows(annotation.slim_annotations(c, g)) == rows(want)
    some = spark.createDataFrame([("rs5",), ("rs5",), ("rs70",), ("nothing",)], "rsid string")
    assert rows(annotation.entries_of(some, c, g)) == rows(lists.select("rsid", "clinvar", "gwas").filter("rsid in ('rs5', 'rs70')"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["analyze", "analysis_summary", "category_counts", "top_categories", "summary_buckets", "top_results", "high_impact_genes"])
def test_no_list_is_built_for_counts(spark, name):
    text = plan(registry.queries()[name](spark, DIR))
    assert "collect_list" not in text and "clinvar#" not in text.replace("n_clinvar#", "")


def test_calls_without_annotation_go_before_the_shuffle(spark, monkeypatch):
    calls, slim = derived.variants(spark, DIR), registry.slim_table(spark, DIR)
    want = rows(analysis.analyze(calls, slim))
    few = plan(analysis.met(calls, slim))
    assert few.index("Join LeftSemi") > few.index("Aggregate [sample_id")  # deeper: before the aggregation
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    many = analysis.met(calls, slim)
    text = plan(many)
    assert text.count("bit_get") >= 3 and text.rindex("bit_get") > text.index("Aggregate [sample_id")
    assert rows(analysis.analyze(calls, slim)) == want
    # All annotated calls pass the filter, and few others do.
    kept = calls.filter(joins.may_be_in("rsid", slim, slim.count()))
    known = {r.rsid for r in slim.select("rsid").collect()}
    passed, given = [r.rsid for r in kept.select("rsid").collect()], [r.rsid for r in calls.select("rsid").collect()]
    others = [x for x in given if x not in known]
    assert sum(x in known for x in passed) == len(given) - len(others) and sum(x not in known for x in passed) < 0.02 * len(others) + 3


def test_huge_samples_in_cells(spark, monkeypatch):
    """One sample has nearly all results, most of one rank; cells are as small as can be told."""
    monkeypatch.setattr(analysis, "CELL_BITS", 4)
    rng = random.Random(3)
    found = [("big", f"rs{i}", rng.choice([4.0, 4.0, 4.0, 0.9, 2.9]), i) for i in rng.sample(range(100_000), 5000)] + [(f"s{i % 9}", f"rs{i}", 4.0, i) for i in range(50)]
    df = spark.createDataFrame(found, "sample_id string, rsid string, significance_rank double, first_ordinal long").repartition(5)
    assert rows(analysis.ordered_in_cells(df)) == rows(analysis.ordered(df))
    nested = df.withColumn("first_ordinal", F.struct((F.col("first_ordinal") % 3).alias("block_start"), F.col("first_ordinal").alias("seq")))
    got = analysis.ordered_in_cells(nested)
    assert rows(got) == rows(analysis.ordered(nested))
    largest = got.groupBy("sample_id", "significance_rank", F.col("first_ordinal.block_start"), F.shiftright("first_ordinal.seq", 4)).count().agg(F.max("count")).first()[0]
    assert largest <= 16
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "__place" in text and "Window [row_number()" in text


def test_fallback_has_explanations(spark):
    results = registry.with_entries(spark, DIR, registry._partly_unknown(spark, DIR))
    first = report.fallback_results(results).first()
    told = spark.createDataFrame([(first.sample_id, first.rsid, "told")], "sample_id string, rsid string, explanation string")
    cards = report.fallback_cards(results, told).collect()
    assert [c.explanation for c in cards if c.explanation] == ["told"] and len(cards) > 1
