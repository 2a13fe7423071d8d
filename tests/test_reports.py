"""Loads that are repeated, report rows with explanations, outputs, odd genotype files."""

import pytest

from variantlake.operators import analysis, annotation, report
from variantlake.plans import registry
from variantlake.sources.genotypes import read_genotypes

from test_sources import ANCESTRY, T23, VCF, tables

DIR = "/root/testdata/sf0.001"


def test_explanations_meet_their_cards(spark):
    results = registry.results(spark, DIR)
    told = {(r.sample_id, r.rsid): f"about {r.rsid}" for r in results.limit(3).collect()}
    given = spark.createDataFrame([(*k, v) for k, v in told.items()], "sample_id string, rsid string, explanation string")
    rows = report.cards(results, given).collect()
    assert len(rows) == results.count() and told
    assert all(r.explanation == told.get((r.sample_id, r.rsid), "") for r in rows)


def test_fallback_cards_are_given(spark):
    rows = registry.fallback_cards(spark, DIR).collect()
    assert rows and {r.category for r in rows} == {"Unknown"} and {r.sample_id for r in rows} <= {f"S{i}" for i in range(5, 10)}


def test_second_load_appends_associations(spark, tmp_path):
    clinvar, gwas = tables(spark, tmp_path)
    path = str(tmp_path / "db")
    annotation.build_tables(clinvar, gwas, path, ("1", "a"), "2020-01-01")
    record = annotation.build_tables(clinvar, gwas, path, ("2", "b"), "2020-01-02", gwas_mode="append").first()
    assert (record.clinvar_rows, record.gwas_rows, record.total_rows, record.clinvar_version) == (2, 6, 8, "2")
    assert sorted(r.last_update for r in spark.read.parquet(f"{path}/loads").collect()) == ["2020-01-01", "2020-01-02"]
    lists = {r.rsid: len(r.gwas) for r in spark.read.parquet(f"{path}/annotations").collect()}
    assert lists == {"rs1": 0, "rs3": 4, "rs1; rs2": 2}


def test_results_are_written(spark, tmp_path):
    results = registry.results(spark, DIR)
    report.write_results(results, str(tmp_path / "all"))
    back = spark.read.parquet(str(tmp_path / "all"))
    assert back.count() == results.count() and sorted(back.columns) == sorted(results.columns)
    flat = report.flat(results, 5)
    report.write_results(flat, str(tmp_path / "flat"), "json")
    assert spark.read.json(str(tmp_path / "flat")).count() == flat.count() > 0


def test_empty_file_raises(spark, tmp_path):
    (tmp_path / "a.txt").write_text(T23)
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError, match="Empty genotype file"):
        read_genotypes(spark, str(tmp_path))


def test_calls_without_rsid_go(spark):
    calls = spark.createDataFrame([("S", 1, "", "1", 10, "AA"), ("S", 2, "rs1", "1", 11, "AG")], "sample_id string, ordinal long, rsid string, chromosome string, position long, genotype string")
    assert [r.rsid for r in analysis.collapse(calls).collect()] == ["rs1"]


def test_formats_agree_on_the_same_calls(spark, tmp_path):
    (tmp_path / "t.txt").write_text(T23)
    (tmp_path / "a.txt").write_text(ANCESTRY)
    (tmp_path / "v.vcf").write_text(VCF)
    of = {name: {(r.rsid, r.position) for r in read_genotypes(spark, str(tmp_path / name)).collect()} for name in ("t.txt", "a.txt", "v.vcf")}
    assert all(("rs1", 10) in x for x in of.values())
