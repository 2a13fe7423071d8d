"""A folder for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in one of our own only where
    that is unset, in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """Rows that several steps read, computed once: Parquet in the scratch folder, whatever
    their number. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session has ended
            return
