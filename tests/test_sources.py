import gzip

import pytest

from variantlake.operators import analysis, annotation
from variantlake.sources.annotations import read_clinvar, read_gwas
from variantlake.sources.genotypes import read_genotypes
from variantlake.streaming.landing import analyze_arrivals

T23 = "# rsid\tchromosome\tposition\tgenotype\n" + "".join(f"{r}\t1\t{p}\t{g}\n" for r, p, g in [("rs1", 10, "AA"), ("rs2", 20, "--"), ("i3", 30, "CT  "), ("x4", 40, "AA"), ("rs5", "x", "AA"), ("rs1", 11, "AG")])
ANCESTRY = "#a\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t1\t10\tA\tG\nrs2\t1\t20\t0\t0\nk3\t1\t30\tTT\n"
VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t10\trs1\tT\tC\t.\t.\t.\tDP:GT\t3:0/1\n1\t20\t.\tT\tC\t.\t.\t.\tGT\t0/1\n1\t30\trs3\tT\tC\t.\t.\t.\tGT\t./.\n"


def clinvar_line(rs, assembly, sig, gene=" G1 "):
    f = [""] * 34
    f[4], f[6], f[9], f[13], f[16], f[24] = gene, sig, rs, "c", assembly, "criteria provided, single submitter"
    return "\t".join(f) + "\n"


def tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("#AlleleID\tx\n" + clinvar_line("1", "GRCh37", "benign") + clinvar_line("1", "GRCh38", "pathogenic") + clinvar_line("-1", "GRCh38", "benign") + clinvar_line("7", "NCBI36", "benign") + "short\tline\n" + clinvar_line("3", "GRCh38", "", " "))
    (tmp_path / "g.tsv").write_text("P-VALUE\tDISEASE/TRAIT\tSNP_ID_CURRENT\tSNPS\n1E-9\tHeight\t3\trs3\n-\t-\t\trs1; rs2\nabc\t\t-\t-\n5e-1\tDrug response\t3\n")
    return read_clinvar(spark, str(tmp_path / "c.tsv")), read_gwas(spark, str(tmp_path / "g.tsv"))


def test_genotypes(spark, tmp_path):
    (tmp_path / "a.txt").write_text(T23.replace("\n", "\r\n"))
    (tmp_path / "b.csv").write_text(ANCESTRY)
    with gzip.open(tmp_path / "c.vcf.gz", "wt") as f:
        f.write(VCF)
    rows = sorted((r.sample_id[-8:], r.rsid, r.position, r.genotype) for r in read_genotypes(spark, str(tmp_path)).collect())
    assert rows == sorted([("st_genotypes0/a.txt"[-8:], "rs1", 10, "AA"), ("st_genotypes0/a.txt"[-8:], "i3", 30, "CT  "), ("st_genotypes0/a.txt"[-8:], "rs1", 11, "AG"), ("s0/b.csv"[-8:], "rs1", 10, "AG"), ("s0/b.csv"[-8:], "k3", 30, "TT"), ("c.vcf.gz", "rs1", 10, "CT")])


def test_unknown_format(spark, tmp_path):
    (tmp_path / "x.txt").write_text("some prose\nmore\n")
    with pytest.raises(Exception, match="Unknown genotype format"):
        read_genotypes(spark, str(tmp_path)).collect()


def test_clinvar_ids_with_their_prefix(spark, tmp_path):
    (tmp_path / "c.tsv").write_text(clinvar_line("rs5", "GRCh38", "benign") + clinvar_line(" 6 ", "GRCh38", "benign"))
    assert sorted(r.rsid for r in read_clinvar(spark, str(tmp_path / "c.tsv")).collect()) == ["rs5", "rs6"]


def test_loads(spark, tmp_path):
    clinvar, gwas = tables(spark, tmp_path)
    assert {(r.rsid, r.gene, r.clinical_significance) for r in annotation.last_by_rsid(clinvar).collect()} == {("rs1", "G1", "pathogenic"), ("rs3", None, None)}
    assert sorted((r.rsid, r.trait, r.p_value) for r in gwas.collect()) == [("rs1; rs2", "-", None), ("rs3", "Drug response", 0.5), ("rs3", "Height", 1e-9)] if gwas.count() == 3 else False


def test_results_and_stream(spark, tmp_path):
    clinvar, gwas = tables(spark, tmp_path)
    annotation.build_tables(clinvar, gwas, str(tmp_path / "db"))
    table = spark.read.parquet(str(tmp_path / "db/annotations"))
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.txt").write_text(T23.replace("i3", "rs3"))
    analyze_arrivals(spark, str(land), table, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("result_order").collect()
    assert [(r.rsid, r.genotype, r.category, r.significance_rank) for r in rows] == [("rs1", "AG", "Health Conditions", 0.9), ("rs3", "CT  ", "Pharmacogenomics", 4.0)]
    batch = analysis.analyze(read_genotypes(spark, str(land)), table)
    assert batch.count() == 2
