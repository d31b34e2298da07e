"""Delta backup: file lists, checksums against the last image, copy of the difference, job records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(last: DataFrame, now: DataFrame) -> DataFrame:
    """path and status (new, gone, changed, same) of every file in either list of path, fp. A null fp is a value like others."""
    own, old = now.select("path", F.col("fp").alias("new_fp"), F.lit(True).alias("here")), last.select("path", F.col("fp").alias("old_fp"), F.lit(True).alias("there"))
    both = own.join(old, "path", "full_outer")
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "gone").when(F.col("old_fp").eqNullSafe(F.col("new_fp")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def delta(last: DataFrame, now: DataFrame) -> DataFrame:
    """Blocks of now (ino, fbn, fp) that the last image doesn't hold at the same place. A null fp is never known: it is copied."""
    return now.join(last.select("ino", "fbn", "fp"), ["ino", "fbn", "fp"], "left_anti")


def job(delta_: DataFrame) -> DataFrame:
    """What a job copied: files, blocks, data_copied."""
    return delta_.agg(F.countDistinct("ino").alias("files"), F.count("*").alias("blocks"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("data_copied"))


def numbered(jobs: DataFrame) -> DataFrame:
    """Jobs with jobnum: 1, 2 ... within their task in the order of time."""
    return jobs.withColumn("jobnum", F.row_number().over(Window.partitionBy("task").orderBy("backup_time", "job_id")))


def next_number(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("task").agg((F.max("jobnum") + 1).alias("next"))


def clone_last(jobs: DataFrame) -> DataFrame:
    """task, job_id (the new one) and backing (the last one) of the image that each task's next job starts from: one row of metadata."""
    return jobs.groupBy("task").agg((F.max("jobnum") + 1).alias("jobnum"), F.max_by("job_id", "jobnum").alias("backing"))


def details(jobs: DataFrame, task: int) -> DataFrame:
    return jobs.where(F.col("task") == task)


def delete_task(jobs: DataFrame, task: int) -> DataFrame:
    return jobs.where(~F.col("task").eqNullSafe(F.lit(task)))


def scrubbed(blocks: DataFrame) -> DataFrame:
    """Blocks whose data no longer have the fingerprint that is recorded."""
    return blocks.where(~F.col("fp").eqNullSafe(F.md5("data")))


def task_sizes(copied: DataFrame) -> DataFrame:
    """task, logical (all blocks copied) and physical (each distinct block once) of task, fp, len."""
    per = copied.groupBy("task", "fp").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return per.groupBy("task").agg(F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("physical"))
