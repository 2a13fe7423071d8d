"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many rows, counted beforehand.
BROADCAST_ROWS = 200_000
#: Spark deletes a query's shuffle files when it ends, not at some collection of garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Copies of the smaller side of a salted join.
SALTS = 16

_made: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset, in
    local mode."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return _own_dir[0]


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut of lineage that
    outlives executors. It is deleted when the driver ends; the shuffle files that it
    came from are deleted at once, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/variantlake-{uuid.uuid4().hex}/{label}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session has ended already
            return
    _made.clear()


def join_small(
    big: DataFrame, small: DataFrame, key: str, how: str = "left", spread: str | None = None
) -> DataFrame:
    """``big`` joined to a table with one row per ``key``. Up to
    ``BROADCAST_ROWS`` rows (counted) it is broadcast; beyond that both sides are
    salted by ``spread``, so that a key with a third of all rows is dealt out."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(F.col(spread or key)), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return big.withColumn("__salt", salt).join(copies, [key, "__salt"], how).drop("__salt")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def crc32_words(ids: Iterable[int]) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def steps(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of ``column``; at least a row each."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.searchsorted(total, np.arange(size, (total[-1] if len(total) else 0) + size, size)) + 1)
    start = 0
    for end in cuts.tolist():
        yield batch.slice(start, end - start)
        start = end
    if start < batch.num_rows:
        yield batch.slice(start)
