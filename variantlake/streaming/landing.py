"""Files analysed once as they arrive in a folder.

The stream is one of files, not of lines, and opens none; files of no bytes are found by
listing the folder. Each batch describes its files, analyses the good ones and puts the others
aside in the ledger with a reason, so a bad file never ends the stream, nor does it come
again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.analysis import analyze
from ..sources.genotypes import EMPTY, NO_CALLS, calls, describe_files, listed_files, read_lines, with_empty

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LEDGER_SCHEMA = "file string, format string, lines long, calls long, reason string"
#: Files of a batch at most; so many paths, and rows of the ledger, reach the driver.
FILES_PER_BATCH = 10_000
CHUNK = 1 << 16

# Fixed value: why a compressed file has no calls.
UNREADABLE = "Unreadable genotype file"


def _literal(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _is_broken(content: bytes) -> bool:
    """Whether a gzip file, of one or more members, cannot be read to its end."""
    at = 0
    try:
        while at < len(content):
            member = zlib.decompressobj(31)
            while not member.eof:
                chunk = content[at : at + CHUNK]
                if not chunk:
                    return True
                member.decompress(chunk)
                at += len(chunk) - len(member.unused_data)
        return False
    except zlib.error:
        return True


def broken_files(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of these gzip files that cannot be read to their end; each is tried by a task."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [p.as_py() for p, c in zip(batch.column("path"), batch.column("content")) if _is_broken(c.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])

    packed = [p for p in paths if p.endswith(".gz")]
    if not packed:
        return set()
    files = spark.read.format("binaryFile").load([_literal(p) for p in packed]).select("path", "content")
    return {r["path"] for r in files.mapInArrow(tried, "path string").collect()}


def analyze_arrivals(
    spark: SparkSession, folder: str, table: DataFrame, out: str, checkpoint: str, include_benign: bool = False, ledger: str | None = None, files_per_batch: int = FILES_PER_BATCH
) -> StreamingQuery:
    """New files of ``folder`` are read, analysed against ``table`` and written under
    ``out``, a folder for each batch, so a batch that runs again replaces its own rows.
    Files never span batches. The table ``ledger`` (by default next to ``out``) has a row
    for each file: ``file, format, lines, calls, reason``; a file with a reason has no
    results."""
    ledger = ledger or f"{out.rstrip('/')}-files"

    def analysed(files: DataFrame, paths: list[str], broken: set[str], batch_id: int) -> None:
        readable = [p for p in paths if p not in broken]
        listed = files.filter(~F.coalesce(F.col("path").isin(*broken), F.lit(False))) if broken else files
        if readable:
            lines = read_lines(spark, [_literal(p) for p in readable])
        else:
            lines = spark.createDataFrame([], "file string, ordinal struct<block_start:long,seq:long>, line string")
        described = with_empty(describe_files(lines), listed)
        described = described.unionByName(files.filter(F.col("path").isin(*broken)).select("file", F.lit(UNREADABLE).alias("reason")), allowMissingColumns=True)
        described = spark.createDataFrame(described.collect(), described.schema)  # a row a file of the batch
        found = calls(lines, F.broadcast(described)).persist()
        try:
            counted = found.groupBy(F.col("sample_id").alias("file")).agg(F.count(F.lit(1)).alias("calls"))
            none = F.col("calls") == 0
            rows = described.join(counted, "file", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
            rows = rows.select("file", "format", F.coalesce("lines", F.lit(0)).alias("lines"), "calls", F.coalesce("reason", F.when(none, NO_CALLS)).alias("reason"))
            rows.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
            analyze(found, table, include_benign).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            found.unpersist()

    def without_bytes(batch_id: int) -> DataFrame:
        """Files of no bytes, which no stream shows, unless an earlier batch put them aside."""
        seen = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file"))
        out = listed_files(spark, folder).join(seen, "file", "left_anti")
        if batch_id:
            told = spark.read.schema(f"{LEDGER_SCHEMA}, batch long").parquet(ledger).filter((F.col("batch") < batch_id) & (F.col("reason") == EMPTY))
            out = out.join(told, "file", "left_anti")
        return out

    def run(batch: DataFrame, batch_id: int) -> None:
        listed = batch.distinct().collect()  # names that look like patterns come more than once
        paths = [r["path"] for r in listed]
        files = spark.createDataFrame(listed, batch.schema).unionByName(without_bytes(batch_id).selectExpr("null AS path", "file"))
        try:
            analysed(files, paths, set(), batch_id)
        except Exception:
            broken = broken_files(spark, paths)
            if not broken:
                raise
            analysed(files, paths, broken, batch_id)

    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = source.select("path", F.col("_metadata.file_path").alias("file"))
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
