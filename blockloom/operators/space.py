"""Space accounting: logical and physical sizes, savings, free space, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(blocks: DataFrame, capacity: int) -> DataFrame:
    """One row: what files hold, what distinct blocks hold, the difference, and what is left of the capacity."""
    per = blocks.groupBy("fp").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    all_ = per.agg(F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("physical"), F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"))
    return all_.select("logical", "physical", (F.col("logical") - F.col("physical")).alias("savings"), "blocks", "distinct_blocks", F.lit(capacity).cast("long").alias("capacity"), (F.lit(capacity) - F.col("physical")).cast("long").alias("free"))


def by_volume(blocks: DataFrame) -> DataFrame:
    """fsid, is_total, logical, physical: distinct blocks count once in each volume, and once in the row of the total (1; fsid null)."""
    per = blocks.groupBy("fsid", "fp").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    each = per.groupBy("fsid").agg(F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("physical"))
    over = per.groupBy("fp").agg(F.sum("n").alias("n"), F.max("len").alias("len")).agg(F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("physical"))
    total = over.select(F.lit(None).cast("int").alias("fsid"), F.lit(1).alias("is_total"), "logical", "physical")
    return each.select("fsid", F.lit(0).alias("is_total"), "logical", "physical").unionByName(total)


def sizes(blocks: DataFrame, capacity: int) -> DataFrame:
    """name and bytes of the virtual disk, of its free space, and of what a file browser sees (all files at full length)."""
    rows = "stack(3, 'virtual_disk', capacity, 'free', free, 'visible', logical) as (name, bytes)"
    return summary(blocks, capacity).select(F.expr(rows))


def per_drive(messages: DataFrame) -> DataFrame:
    """driveid, requests, total_io, written, punched."""
    size = F.col("datasize").cast("long")
    return messages.groupBy("driveid").agg(F.count("*").alias("requests"), F.sum(size).alias("total_io"), F.sum(F.when(F.col("optype") == 7, size).otherwise(0)).alias("written"), F.sum(F.when(F.col("optype") == 9, size).otherwise(0)).alias("punched"))


def predicted(clog: DataFrame) -> DataFrame:
    """ino, allocations, frees and their difference."""
    one = lambda op: F.sum(F.when(F.col("op") == op, 1).otherwise(0))
    return clog.groupBy("ino").agg(one("WRITE").alias("allocated"), one("PUNCH").alias("freed")).withColumn("net", F.col("allocated") - F.col("freed"))


def free_blocks(universe: DataFrame, used: DataFrame) -> DataFrame:
    """Blocks of the universe that nothing refers to."""
    return universe.select("dbn").join(used.select("dbn"), "dbn", "left_anti")
