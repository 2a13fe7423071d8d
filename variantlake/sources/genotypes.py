"""Genotype exports as one table of calls: two tab-separated layouts and VCF.

A file is one sample; its format is inferred from its first 50 lines. Lines carry an
``ordinal`` (block start, line in block) that orders them within their file, so files
may be split. Bad bytes are replaced; gzip goes by the extension.

Reading takes two scans of the text. The first makes a row for each file: its format, the
places of a VCF header's columns, its number of lines. All of that is minima and counts of
numbers, so it is combined on each task without a sort. Up to ``BROADCAST_ROWS`` files the
rows are collected and broadcast, and the second scan parses every line by its file's
format; beyond that they are joined by file. A file that cannot be read is a reason in its
row, which ``parse`` raises and a stream puts aside.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import genotype_of_gt, whole_number
from ..operators.joins import held_if_small

DETECT_LINES = 50
VCF_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "FORMAT")
COLUMNS = ["sample_id", "ordinal", "rsid", "chromosome", "position", "genotype"]

# Why a file has no calls.
EMPTY, UNKNOWN, NO_COLUMN, NO_CALLS = "Empty genotype file", "Unknown genotype format", "VCF header lacks a required column", "No valid genotype data"

#: Places of a header's columns, three to a number, so that they are found without a sort.
_PLACE_BITS = 20
#: Lines of a block are told apart by so many bits of ``seq``.
_SEQ = 1 << 33


def numbered(lines: DataFrame) -> DataFrame:
    """``file, ordinal, line`` of rows with ``value`` and the file metadata."""
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("seq")).alias("ordinal"),
        F.make_valid_utf8("value").alias("line"),
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, ordinal, line``; a missing path raises."""
    return numbered(spark.read.text(paths).select("value", "_metadata"))


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file`` of all files, those of no bytes too, which scans pass over; none is opened."""
    names = spark.read.format("binaryFile").load(paths).inputFiles()
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", n),) for n in names], "file string")


def _at(column: str) -> str:
    return f"at_{column.lower()}"


def _packed(names: Column) -> tuple[Column, Column]:
    """The places (from 1, 0: missing) of the six columns of a header, three to a number."""
    place = [F.array_position(names, c) for c in VCF_COLUMNS]
    three = lambda x: x[0] + x[1] * F.lit(1 << _PLACE_BITS) + x[2] * F.lit(1 << 2 * _PLACE_BITS)
    return three(place[:3]), three(place[3:])


def _unpacked(c: Column, k: int) -> Column:
    """The place of a header's column, counted from 0; -1 where it is missing."""
    return (F.shiftright(c, k * _PLACE_BITS).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) - 1).cast("int")


def describe_files(lines: DataFrame) -> DataFrame:
    """A row for each file that has a line: ``file, format, reason, lines``, and for VCF the
    header's ordinal and its columns' places. Without a format there is a reason. ``lines``
    may have a dense line number ``nth``; it is ``ordinal.seq`` where they have none."""
    line, seq, block = F.col("line"), F.col("ordinal.seq"), F.col("ordinal.block_start")
    nth = F.when(block == 0, F.col("nth") if "nth" in lines.columns else seq)
    fields = F.split(line, "\t", -1)
    data = ~line.startswith("#")
    called = data & (F.size(fields) >= 4) & (line.startswith("rs") | line.startswith("i")) & whole_number(F.get(fields, F.lit(2))).isNotNull()
    header = line.startswith("#CHROM")
    # Orders the lines of a file's blocks: where the block starts, then the line.
    key = F.when(header, block.cast("decimal(38,0)") * F.lit(_SEQ) + F.pmod(seq, F.lit(_SEQ)))
    low, high = _packed(F.split(F.substring(line, 2, 1 << 30), "\t", -1))
    seen = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(nth).alias("first"),
        F.min(F.when(header | F.lower(line).startswith("##fileformat=vcf"), nth)).alias("vcf"),
        F.min(F.when(data & (line != ""), 2 * nth + F.when(F.lower(line).startswith("rsid"), 0).otherwise(1))).alias("data"),
        F.min(F.when(called, nth)).alias("called"),
        F.min_by(F.when(header, block), key).alias("since_block"),
        F.min_by(F.when(header, seq), key).alias("since"),
        F.min_by(F.when(header, low), key).alias("low"),
        F.min_by(F.when(header, high), key).alias("high"),
    )
    near = lambda c: F.coalesce(c - F.col("first") < DETECT_LINES, F.lit(False))
    form = F.when(near(F.col("vcf")), "vcf").when(near(F.shiftright("data", 1)) & (F.col("data") % 2 == 0), "ancestry").when(near(F.col("called")), "23andme")
    places = {c: _unpacked(F.col("low" if k < 3 else "high"), k % 3) for k, c in enumerate(VCF_COLUMNS)}
    out = seen.select("file", "lines", form.alias("format"), "since_block", "since", *[p.alias(_at(c)) for c, p in places.items()])
    lacking = (F.col("format") == "vcf") & F.col("since").isNotNull() & (F.least(*[F.col(_at(c)) for c in VCF_COLUMNS]) < 0)
    return out.withColumn("reason", F.when(F.col("format").isNull(), UNKNOWN).when(lacking, NO_COLUMN))


def with_empty(described: DataFrame, files: DataFrame) -> DataFrame:
    """Also the files that have no line, with their reason."""
    empty = files.select("file").distinct().join(described.select("file"), "file", "left_anti")
    return described.unionByName(empty.select("file", F.lit(EMPTY).alias("reason")), allowMissingColumns=True)


Call = tuple[Column, Column, Column, Column, Column]


def _call_23andme(line: Column, fields: Column) -> Call:
    f = lambda i: F.get(fields, F.lit(i))
    fits = (F.size(fields) >= 4) & (f(0).startswith("rs") | f(0).startswith("i")) & (f(3) != "--")
    return fits, f(0), f(1), f(2), f(3)


def _call_ancestry(line: Column, fields: Column) -> Call:
    f = lambda i: F.get(fields, F.lit(i))
    genotype = F.when(F.size(fields) == 4, f(3)).otherwise(F.concat(f(3), f(4)))
    fits = ~F.lower(line).startswith("rsid") & (F.size(fields) >= 4) & ~genotype.isin("00", "0", "--")
    return fits, f(0), f(1), f(2), genotype


def _call_vcf(line: Column, fields: Column) -> Call:
    """Lines after the file's first header; the first sample counts."""
    at = lambda c: F.get(fields, F.col(_at(c)))
    block, seq = F.col("ordinal.block_start"), F.col("ordinal.seq")
    gt_at = F.array_position(F.split(at("FORMAT"), ":", -1), "GT").cast("int") - 1
    gt = F.when(gt_at >= 0, F.get(F.split(F.get(fields, F.col(_at("FORMAT")) + 1), ":", -1), gt_at))
    after = (block > F.col("since_block")) | ((block == F.col("since_block")) & (seq > F.col("since")))
    fits = after & (F.size(fields) >= F.col(_at("FORMAT")) + 2) & (at("ID") != ".")
    return fits, at("ID"), at("CHROM"), at("POS"), genotype_of_gt(gt, at("REF"), at("ALT"))


_CALLS = {"23andme": _call_23andme, "ancestry": _call_ancestry, "vcf": _call_vcf}


def calls(lines: DataFrame, described: DataFrame) -> DataFrame:
    """Calls of the lines of all files that have a format and no reason against it, each
    line by its file's format, in one pass. ``described`` is held or joined by file."""
    good = described.filter("reason is null and format is not null").drop("lines", "reason")
    data = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).join(good, "file")
    data = data.withColumn("fields", F.split("line", "\t", -1))
    found = None
    for name, of in _CALLS.items():
        fits, *values = of(F.col("line"), F.col("fields"))
        values[2] = whole_number(values[2])
        call = F.array(F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS[2:])]))
        is_call = (F.col("format") == name) & fits
        found = F.when(is_call, call) if found is None else found.when(is_call, call)
    # A generator, so that a call's columns are computed once, not for each use.
    out = data.select(F.col("file").alias("sample_id"), "ordinal", F.inline(found))
    return out.filter("position is not null and genotype is not null")


def _raise(described: DataFrame, held: bool) -> DataFrame:
    """``described`` without a reason; raises the first one, now where the rows are held."""
    if held:
        bad = described.filter("reason is not null").orderBy("file").select("reason", "file").head()
        if bad:
            raise ValueError(f"{bad['reason']}: {bad['file']}")
        return described
    return described.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat("reason", F.lit(": "), "file"))))


def parse(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Calls of all files, each by its own format; raises where a file has none. ``files``
    names the files that must have lines."""
    described = describe_files(lines)
    described, held = held_if_small(described if files is None else with_empty(described, files))
    return calls(lines, _raise(described, held))


def read_genotypes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``sample_id, ordinal, rsid, chromosome, position, genotype`` of genotype files."""
    return parse(read_lines(spark, paths), listed_files(spark, paths))
