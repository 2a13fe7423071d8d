"""Mixed folders in one pass, and streams that outlive bad files."""

import gzip

import pytest
from pyspark.sql import functions as F

from variantlake.operators import analysis, annotation
from variantlake.sources import genotypes
from variantlake.sources.genotypes import read_genotypes
from variantlake.streaming.landing import analyze_arrivals, broken_files

from test_sources import ANCESTRY, T23, VCF, tables


@pytest.fixture
def table(spark, tmp_path):
    clinvar, gwas = tables(spark, tmp_path)
    annotation.build_tables(clinvar, gwas, str(tmp_path / "db"))
    return spark.read.parquet(str(tmp_path / "db/annotations"))


def landed(tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.txt").write_text(T23)
    (land / "b [1] é*.csv").write_text(ANCESTRY)
    (land / "prose.txt").write_text("some prose\nmore\n")
    (land / "empty.txt").write_text("")
    with gzip.open(land / "empty.vcf.gz", "wt"):
        pass
    with gzip.open(land / "c.vcf.gz", "wt") as f:
        f.write(VCF)
    whole = gzip.compress(("##fileformat=VCFv4.2\n" + "x" * 100_000 + VCF).encode() + bytes(range(256)) * 999)
    (land / "cut.vcf.gz").write_bytes(whole[: len(whole) // 2])
    (land / "nocalls.txt").write_text("rs1\t1\t10\t--\n")
    (land / "nocolumn.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\n1\t1\trs1\tA\tC\n")
    return land


def ledger(spark, path):
    return {r.file.rsplit("/", 1)[1]: (r.format, r.lines, r.calls, r.reason) for r in spark.read.parquet(path).collect()}


def test_bad_files_are_put_aside(spark, table, tmp_path):
    land, out, cp = landed(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        analyze_arrivals(spark, str(land), table, out, cp).awaitTermination(120)
        return sorted((r.sample_id.rsplit("/", 1)[1], r.rsid, r.genotype, r.result_order) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == [("a.txt", "rs1", "AG", 1), ("b%20%5B1%5D%20é*.csv", "rs1", "AG", 1), ("c.vcf.gz", "rs1", "CT", 1)]
    assert ledger(spark, f"{out}-files") == {
        "a.txt": ("23andme", 7, 3, None),
        "b%20%5B1%5D%20é*.csv": ("ancestry", 5, 2, None),
        "c.vcf.gz": ("vcf", 5, 1, None),
        "prose.txt": (None, 2, 0, genotypes.UNKNOWN),
        "empty.txt": (None, 0, 0, genotypes.EMPTY),
        "empty.vcf.gz": (None, 0, 0, genotypes.EMPTY),
        "cut.vcf.gz": (None, 0, 0, "Unreadable genotype file"),
        "nocalls.txt": ("23andme", 1, 0, genotypes.NO_CALLS),
        "nocolumn.vcf": ("vcf", 3, 0, genotypes.NO_COLUMN),
    }
    assert run() == first and len(ledger(spark, f"{out}-files")) == 9
    (land / "late.txt").write_text("rs3\t1\t5\tCC\n")
    assert run() == sorted([*first, ("late.txt", "rs3", "CC", 1)])


def test_batches_of_bad_files_only(spark, table, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "x.txt").write_text("")
    (land / "y.gz").write_bytes(gzip.compress(b"abc" * 9999)[:-9])
    out = str(tmp_path / "out")
    analyze_arrivals(spark, str(land), table, out, str(tmp_path / "cp"), files_per_batch=1).awaitTermination(120)
    assert {k: v[3] for k, v in ledger(spark, f"{out}-files").items()} == {"x.txt": genotypes.EMPTY, "y.gz": "Unreadable genotype file"}
    assert spark.read.parquet(out).count() == 0


def test_gzip_of_several_members_is_whole(spark, tmp_path):
    (tmp_path / "m.gz").write_bytes(gzip.compress(b"a" * 10) * 300 + gzip.compress(b"b" * 200_000))
    (tmp_path / "n.gz").write_bytes(b"no gzip at all")
    files = {r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()}
    assert {p.rsplit("/", 1)[1] for p in broken_files(spark, sorted(files))} == {"n.gz"}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_one_scan_beside_detection(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"a{n}.txt").write_text(T23)
        (tmp_path / f"b{n}.txt").write_text(ANCESTRY)
        (tmp_path / f"c{n}.vcf").write_text(VCF)
    calls = read_genotypes(spark, str(tmp_path))
    assert scans(calls) == 1 and calls.count() == 3 * (3 + 2 + 1)
    described = genotypes.describe_files(genotypes.read_lines(spark, str(tmp_path)))
    plan = described._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_empty_packed_file_raises(spark, tmp_path):
    with gzip.open(tmp_path / "e.txt.gz", "wt"):
        pass
    (tmp_path / "a.txt").write_text(T23)
    with pytest.raises(ValueError, match="Empty genotype file: .*e.txt.gz"):
        read_genotypes(spark, str(tmp_path))


def test_files_beyond_the_bound_are_joined(spark, tmp_path, monkeypatch):
    from variantlake.operators import joins

    (tmp_path / "a.txt").write_text(T23)
    (tmp_path / "b.txt").write_text(ANCESTRY)
    (tmp_path / "c.vcf").write_text(VCF)
    want = sorted(map(tuple, read_genotypes(spark, str(tmp_path)).drop("ordinal").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, read_genotypes(spark, str(tmp_path)).drop("ordinal").collect())) == want
    (tmp_path / "x.txt").write_text("prose\n")
    with pytest.raises(Exception, match="Unknown genotype format"):
        read_genotypes(spark, str(tmp_path)).collect()


def test_header_in_another_block(spark):
    """The header may lie in a later block than the first 50 lines; the first one counts."""
    rows = [("f", (0, 0), "##fileformat=VCFv4.2")] + [("f", (0, i), f"##{i}") for i in range(1, 60)]
    rows += [("f", (1000, 5 + (3 << 33)), "#CHROM\tID\tPOS\tREF\tALT\tFORMAT\tS"), ("f", (1000, 6 + (3 << 33)), "2\trs9\t7\tA\tC\tGT\t0/1")]
    rows += [("f", (2000, 1 + (1 << 33)), "#CHROM\tPOS\tID\tREF\tALT\tFORMAT\tS"), ("f", (2000, 2 + (1 << 33)), "2\trs8\t8\tA\tC\tGT\t1/1"), ("f", (0, 70), "2\trs7\t9\tA\tC\tGT\t1/1")]
    lines = spark.createDataFrame(rows, "file string, ordinal struct<block_start:long,seq:long>, line string").repartition(5)
    got = sorted((r.rsid, r.chromosome, r.position, r.genotype) for r in genotypes.parse(lines).collect())
    assert got == [("rs8", "2", 8, "CC"), ("rs9", "2", 7, "AC")]
    late = [("g", (0, i), "#") for i in range(50)] + [("g", (0, 50), "rs1\t1\t1\tAA")]
    lines = spark.createDataFrame(late, lines.schema)
    assert genotypes.describe_files(lines).first().reason == genotypes.UNKNOWN
    assert analysis.collapse(genotypes.calls(lines, genotypes.describe_files(lines).withColumn("reason", F.lit("x")))).count() == 0
