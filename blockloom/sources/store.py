"""Named tables in versions, with a table of what is published: the storage engine's state on disk.

A version is written to folders of its own and never over another one. Only when all its tables are written, one file
with a row for each of them is added to the folder `published`; a version that isn't there doesn't exist, whatever an
ended job left behind. A table that a version doesn't change stays where it is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete

#: Partition columns and sort columns of the engine's tables: point and range filters on them prune files and row groups.
LAYOUT = {
    "blockmap": (("fsid",), ("ino", "fbn")),
    "clog": ((), ("fsid", "ino", "fbn")),
    "fpdb": ((), ("dbn",)),
    "script": ((), ("fsid", "ino", "fbn")),
    "refcounts": ((), ("dbn",)),
    "volumes": ((), ("fsid",)),
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def published(self) -> DataFrame | None:
        """version, name, path and schema of every table of every version; None before the first."""
        try:
            return self.spark.read.schema("version long, name string, path string, schema string").parquet(f"{self.folder}/published")
        except AnalysisException:
            return None

    def versions(self) -> list[int]:
        every = self.published()
        return [] if every is None else sorted(r.version for r in every.select("version").distinct().collect())

    def publish(self, **tables: DataFrame) -> int:
        """Writes the tables as a new version, and returns its number."""
        version = (self.versions() or [0])[-1] + 1
        rows = []
        for name, df in tables.items():
            path, (parts, order) = f"{self.folder}/v={version:08d}/{name}", LAYOUT.get(name, ((), ()))
            if parts or order:
                df = df.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
            writer = df.write.mode("overwrite")  # of what an unpublished try left
            (writer.partitionBy(*parts) if parts else writer).parquet(path)
            rows.append((version, name, path, df.schema.json()))
        made = self.spark.createDataFrame(rows, "version long, name string, path string, schema string")
        made.coalesce(1).write.mode("append").parquet(f"{self.folder}/published")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as the version has it (default: the last)."""
        from pyspark.sql.types import StructType

        every = self.published()
        own = None if every is None else every.where(F.col("name") == name)
        found = None if own is None else (own if version is None else own.where(F.col("version") <= version)).orderBy(F.desc("version")).first()
        if found is None:
            raise KeyError(f"no table {name} is published in {self.folder}")
        import json

        return self.spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(found.path)

    def drop_before(self, version: int) -> int:
        """Removes tables that no version from this one on reads; returns how many."""
        every = self.published()
        rows = [] if every is None else every.collect()  # a row for each table of each version
        kept = {max((r for r in rows if r.name == n and r.version <= version), key=lambda r: r.version, default=None) for n in {r.name for r in rows}}
        used = {r.path for r in rows if r.version >= version} | {r.path for r in kept if r}
        return sum(delete(self.spark, p) for p in {r.path for r in rows} - used)
