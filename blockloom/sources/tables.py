"""Sources and sinks: Parquet tables, files of a folder, versioned directories, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and content of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), "content")


def mount(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def unmount(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def publish(df: DataFrame, folder: str, version: int, order: list[str] | None = None) -> str:
    """Writes a version of a table beside the older ones, and never over one of them."""
    path = f"{folder.rstrip('/')}/v={version:08d}"
    (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").parquet(path)
    return path


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the latest version that was written."""
    every = spark.read.option("basePath", folder).parquet(folder)
    last = every.agg(F.max("v")).first()[0]
    return every.where(F.col("v") == F.lit(last)).drop("v")
