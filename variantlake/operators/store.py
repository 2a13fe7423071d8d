"""Tables in buckets of a key, in versions that readers see whole.

A version is a manifest: the folders that hold each bucket of each table. A change writes
new folders of the buckets it touches and then one manifest, as one small file; what fails
before leaves folders that no manifest names, so the last version stays readable, and a
reader that began goes on with the version it saw. Folders are never written twice.

Rows lie sorted by the bucket's column in files with small row groups and Bloom filters,
so a lookup of a few keys reads their buckets, and there the row groups that may hold
them. Changes of one store run one after another. Old folders stay until they are deleted
by hand.

Defined cases: a store without a version has no table; a table whose buckets are all empty
keeps its columns; null keys lie in bucket 0; repeated rows stay.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
ROW_GROUP_BYTES = 1 << 20
MANIFEST = "table string, bucket int, folder string, rows long, columns string, token string, buckets int"


@dataclass
class Part:
    """Rows of a bucket in a folder."""

    table: str
    bucket: int
    folder: str
    rows: int
    columns: str


@dataclass
class Version:
    """What a manifest says; ``number`` is 0 where there is none."""

    number: int
    parts: list[Part]
    token: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def of(self, table: str, buckets: set[int] | None = None) -> list[Part]:
        return [p for p in self.parts if p.table == table and (buckets is None or p.bucket in buckets)]

    def rows(self, table: str) -> int:
        return sum(p.rows for p in self.of(table))


class Store:
    """A store under ``path``. ``by`` names the column whose hash gives the bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES):
        self.spark, self.path, self.row_group_bytes = spark, path.rstrip("/"), row_group_bytes
        first = spark.createDataFrame([(None, None, None, 0, None, None, buckets)], MANIFEST)
        first.coalesce(1).write.mode("ignore").json(f"{self.path}/manifest/version=0")
        found = self._manifests()
        self.buckets = found[0]["buckets"] if found else buckets

    def _manifests(self) -> list:
        """The rows of the last manifest: at most the buckets, times the loads appended."""
        rows = self.spark.read.schema(f"{MANIFEST}, version int").json(f"{self.path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == last).collect() if last is not None else []

    def version(self) -> Version:
        rows = self._manifests()
        if not rows:
            return Version(0, [])
        parts = [Part(r["table"], r["bucket"], r["folder"], r["rows"], r["columns"]) for r in rows if r["folder"]]
        return Version(rows[0]["version"], parts, rows[0]["token"], {r["table"]: r["columns"] for r in rows if r["table"]})

    def bucket(self, by: Column) -> Column:
        return F.coalesce(F.pmod(F.crc32(by.cast("string").cast("binary")), F.lit(self.buckets)).cast("int"), F.lit(0))

    def stage(self, table: str, df: DataFrame, by: str) -> list[Part]:
        """Writes rows in a new folder; their numbers are observed as they go by."""
        folder = f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        seen = Observation()
        counts = [F.count_if(F.col("__bucket") == k).alias(f"n{k}") for k in range(self.buckets)]
        placed = df.withColumn("__bucket", self.bucket(F.col(by))).observe(seen, *counts)
        writer = placed.repartition("__bucket").sortWithinPartitions("__bucket", by).write.partitionBy("__bucket")
        writer.option("parquet.block.size", self.row_group_bytes).option(f"parquet.bloom.filter.enabled#{by}", "true").parquet(folder)
        numbers, columns = seen.get, df.schema.json()
        return [Part(table, k, f"{folder}/__bucket={k}", numbers[f"n{k}"], columns) for k in range(self.buckets) if numbers[f"n{k}"]]

    def rows_of(self, parts: list[Part], columns: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(columns))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[p.folder for p in parts])

    def read(self, table: str, version: Version | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as of one version, the last one by default."""
        v = version or self.version()
        if table not in v.columns:
            raise ValueError(f"no table {table!r} in the store {self.path}")
        return self.rows_of(v.of(table, buckets), v.columns[table])

    def lookup(self, table: str, by: str, values: list[str]) -> DataFrame:
        """The rows of a few keys (a stated list), from their buckets alone."""
        wanted = {zlib.crc32(x.encode()) % self.buckets for x in values}
        return self.read(table, buckets=wanted).filter(F.col(by).isin(*values))

    def merged(self, old: Version, table: str, new: list[Part], keys: list[str], by: str) -> list[Part]:
        """Parts of ``table`` in which ``new`` replaces the old rows of its keys; buckets that
        it does not touch stay as they are."""
        touched = {p.bucket for p in new}
        if not old.of(table, touched):
            return [*old.of(table), *new]
        fresh = self.rows_of(new, new[0].columns)
        same = F.lit(True)
        kept, given = self.read(table, old, touched).alias("old"), fresh.select(*keys).distinct().alias("new")
        for k in keys:
            same &= F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
        rest = kept.join(given, same, "left_anti")
        both = self.stage(table, rest.unionByName(fresh, allowMissingColumns=True), by)
        return [*[p for p in old.of(table) if p.bucket not in touched], *both]

    def commit(self, old: Version, parts: dict[str, list[Part]], columns: dict[str, str], token: str | None = None) -> Version:
        """One manifest: the given tables have these parts, other tables the old ones."""
        kept = [p for p in old.parts if p.table not in parts]
        version = Version(old.number + 1, [*kept, *(p for x in parts.values() for p in x)], token, old.columns | columns)
        rows = [(p.table, p.bucket, p.folder, p.rows, p.columns, token, self.buckets) for p in version.parts]
        held = {p.table for p in version.parts}
        rows += [(t, None, None, 0, c, token, self.buckets) for t, c in version.columns.items() if t not in held]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version.number}")
        return version

    def replace(self, table: str, df: DataFrame, keys: list[str], by: str, token: str | None = None) -> Version:
        """A version in which the rows of ``df`` replace those of their keys. A change with
        the token of the last version was made already and is left out."""
        old = self.version()
        if token is not None and token == old.token:
            return old
        new = self.stage(table, df, by)
        return self.commit(old, {table: self.merged(old, table, new, keys, by)}, {table: df.schema.json()}, token)
