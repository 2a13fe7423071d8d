"""Loads in versions, point lookups, results and answers that are written again."""

import random

import pytest
from pyspark.sql import functions as F

from variantlake.operators import analysis, annotation, report
from variantlake.operators.store import Store
from variantlake.plans import derived, registry

from test_analysis import CLINVAR_SCHEMA, GWAS_SCHEMA, rows

DIR = "/root/testdata/sf0.001"


def clinvar(spark, data, first=0):
    return spark.createDataFrame([(first + i, rs, gene, sig, "c", "reviewed by expert panel", None) for i, (rs, gene, sig) in enumerate(data)], "ordinal long, " + CLINVAR_SCHEMA)


def gwas(spark, data):
    return spark.createDataFrame([(i, rs, trait, 1e-9, None, "M", None, None, None) for i, (rs, trait) in enumerate(data)], GWAS_SCHEMA)


def known(store):
    c = {r.rsid: (r.gene, r.clinical_significance) for r in store.read("clinvar").collect()}
    a = {r.rsid: (r.category, r.n_clinvar, [e.trait for e in r.gwas]) for r in store.read("annotations").collect()}
    return c, a


def test_two_loads_and_a_failed_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), buckets=8)
    one = clinvar(spark, [("rs1", "A", "benign"), ("rs2", "B", "pathogenic"), ("rs1", "A", "risk factor"), ("rs9", "", "benign")])
    record = annotation.load_tables(one, gwas(spark, [("rs2", "Height"), ("rs5", "Drug response")]), store, ("1", "a"), "2020-01-01").first()
    assert tuple(record) == ("2020-01-01", "1", "a", 3, 2, 2, 5)
    first = store.version()
    two = clinvar(spark, [("rs2", "B2", "benign"), ("rs7", "A", "association")])
    record = annotation.load_tables(two, gwas(spark, [("rs2", "Weight"), ("rs2", "Weight")]), store, ("2", "b"), "2020-01-02", gwas_mode="append").first()
    assert (record.clinvar_rows, record.genes, record.gwas_rows, record.total_rows) == (4, 2, 4, 8)
    want_c = {"rs1": ("A", "risk factor"), "rs2": ("B2", "benign"), "rs7": ("A", "association"), "rs9": ("", "benign")}
    want_a = {
        "rs1": ("Risk Factors", 1, []), "rs2": ("Carrier Status", 1, ["Height", "Weight", "Weight"]), "rs5": ("Pharmacogenomics", 0, ["Drug response"]),
        "rs7": ("Risk Factors", 1, []), "rs9": ("Carrier Status", 1, []),
    }
    assert known(store) == (want_c, want_a)
    # A reader of the first version sees it whole.
    assert {r.rsid: r.gene for r in store.read("clinvar", first).collect()} == {"rs1": "A", "rs2": "B", "rs9": ""}
    # Untouched buckets are not written again.
    second = store.version()
    touched = {p.bucket for p in second.of("clinvar")} - {p.bucket for p in first.of("clinvar") if p in second.of("clinvar")}
    assert touched <= {r[0] for r in two.select(store.bucket(F.col("rsid"))).collect()}
    # A load that fails on its way leaves the version.
    bad = two.withColumn("gene", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        annotation.load_tables(bad, None, store)
    torn = gwas(spark, [("rs1", "x")]).withColumn("trait", F.raise_error(F.lit("torn later")).cast("string"))
    with pytest.raises(Exception, match="torn later"):
        annotation.load_tables(clinvar(spark, [("rs1", "Z", "benign")]), torn, store)
    again = Store(spark, str(tmp_path / "db"))
    assert again.buckets == 8 and again.version().number == 2 and known(again) == (want_c, want_a)
    # Without associations the old ones stay; replacing drops them.
    assert annotation.load_tables(clinvar(spark, []), None, store).first().gwas_version == "unavailable"
    assert known(store) == (want_c, want_a)
    annotation.load_tables(clinvar(spark, []), gwas(spark, [("rs8", "Height")]), store)
    c, a = known(store)
    assert c == want_c and a["rs8"] == ("Traits", 0, ["Height"]) and "rs5" not in a and a["rs2"] == ("Carrier Status", 1, [])
    assert sorted(r.clinvar_version for r in store.read("loads").collect()) == ["1", "2", "unknown", "unknown"]


def test_stored_annotations_serve_analysis(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), buckets=5)
    lines, entries = derived.clinvar_lines(spark, DIR), derived.gwas(spark, DIR)
    annotation.load_tables(lines, entries, store)
    calls = derived.variants(spark, DIR)
    results = analysis.analyze(calls, store.read("annotations"))
    assert rows(results.select(registry.slim_results(spark, DIR).columns)) == rows(registry.slim_results(spark, DIR))
    assert rows(results.select("sample_id", "rsid", "clinvar", "gwas").withColumn("gwas", F.size("gwas"))) == rows(registry.results(spark, DIR).select("sample_id", "rsid", "clinvar", "gwas").withColumn("gwas", F.size("gwas")))


def scan_metrics(df):
    """Files and rows of the scan of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().apply(0)
    value = lambda n: plan.metrics().get(n).get().value()
    return value("numFiles"), value("numOutputRows")


def test_point_lookup_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(6)
    store = Store(spark, str(tmp_path / "db"), buckets=4, row_group_bytes=16 << 10)
    data = spark.range(40_000).select(F.concat(F.lit("rs"), F.col("id")).alias("rsid"), F.sha2(F.col("id").cast("string"), 512).alias("gene"))
    store.replace("clinvar", data, ["rsid"], "rsid")
    for x in rng.sample(range(40_000), 3):
        found = store.lookup("clinvar", "rsid", [f"rs{x}"])
        files, read = scan_metrics(found)
        assert [r.rsid for r in found.collect()] == [f"rs{x}"]
        assert files <= 2 and read < 1_000, (files, read)
    assert store.lookup("clinvar", "rsid", ["nothing", "rs5", "rs5"]).count() == 1


def test_a_sample_s_results_are_replaced(spark, tmp_path):
    results = registry.slim_results(spark, DIR)
    path = str(tmp_path / "out")
    report.replace_results(spark, results, path, buckets=3)
    files = lambda: len(list((tmp_path / "out/data/results").rglob("*.parquet")))
    assert files() <= 3 and rows(report.stored_results(spark, path)) == rows(results)
    again = registry.slim_results(spark, DIR, include_benign=True).filter("sample_id = 'S3'")
    for _ in range(2):
        report.replace_results(spark, again, path)
        assert rows(report.stored_results(spark, path)) == rows(results.filter("sample_id <> 'S3'").unionByName(again))
    assert files() <= 9


def test_change_with_a_token_is_made_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    assert store.version().number == 0
    with pytest.raises(ValueError, match="no table"):
        store.read("t")
    store.replace("t", row("a", 1), ["k"], "k", token="0")
    store.replace("t", row("a", 2), ["k"], "k", token="0")
    store.replace("t", row(None, 3), ["k"], "k", token="1")
    store.replace("t", row(None, 4), ["k"], "k")
    assert sorted((r.k or "", r.v) for r in store.read("t").collect()) == [("", 4), ("a", 1)] and store.version().number == 3
    store.replace("u", row("a", 1).limit(0), ["k"], "k")
    assert store.read("u").count() == 0 and store.read("t").count() == 2
