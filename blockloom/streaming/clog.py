"""The changelog as a stream: a file source, and the last writer of each block in batches.

The state is cut into BUCKETS by the hash of the key. A batch reads the buckets that it touches, and writes only those
anew, in a folder of its number; when they are written, a file that says so is added to `published`. A batch that runs
again writes its own folder again; what a batch replaced is removed by the one after it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.dedupe import newest
from blockloom.sources.shared import delete

BUCKETS = 64


def source(spark: SparkSession, pattern: str, schema, files: int | None = None) -> DataFrame:
    """The files as a stream, so many in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)


def paths(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """For each bucket that was written (by batches before that number) the folder that holds it now."""
    try:
        every = spark.read.schema("number long, bucket int").parquet(f"{folder}/published")
    except AnalysisException:
        return {}
    rows = (every if before is None else every.where(F.col("number") < before)).groupBy("bucket").agg(F.max("number").alias("number")).collect()  # BUCKETS at most
    return {r.bucket: f"{folder}/v={r.number:08d}/bucket={r.bucket}" for r in rows}


def keep_current(stream: DataFrame, folder: str, key: tuple[str, ...] = ("ino", "fbn")):
    """Starts a query that keeps the newest entry of each key below the folder."""

    def step(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")
        batch = newest(batch, *key).withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
        old = {b: p for b, p in paths(spark, folder, number).items() if b in touched}
        rows = batch
        if old:
            rows = newest(rows.unionByName(spark.read.schema(schema).parquet(*old.values()).withColumn("bucket", bucket)), *key)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number:08d}")
        made = spark.createDataFrame([(number, b) for b in touched], "number long, bucket int")
        made.coalesce(1).write.mode("append").parquet(f"{folder}/published")
        # what the batch before replaced: no repeated batch reads it any more
        before, then = paths(spark, folder, number - 1), paths(spark, folder, number)
        for b, path in before.items():
            if then[b] != path:
                delete(spark, path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest entry of each key, after the last batch."""
    found = paths(spark, folder)
    return spark.read.schema(schema).parquet(*found.values()) if found else spark.createDataFrame([], schema)
