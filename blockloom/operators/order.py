"""Order without one task that sorts everything: positions and running sums over range partitions; orders of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.sources.shared import materialise


def running(df: DataFrame, keys: list[str], weight: str | None = None, name: str = "before") -> DataFrame:
    """The rows with the sum of the weights (default: the number) of all rows before them in the order of the keys.

    Keys must tell rows apart. Rows are dealt to ranges of keys, and written with their range; each range is summed
    by itself, and the few ranges' sums (one row for each shuffle partition) among each other.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(tasks, *keys).withColumn("_part", F.spark_partition_id()))
    weighed = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(weighed).alias("_sum"))
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(weighed).over(before(Window.partitionBy("_part").orderBy(*keys))), F.lit(0))
    return dealt.withColumn(name, own).join(F.broadcast(starts), "_part").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_start")


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with pos, their position from 1 in the order of the keys."""
    return running(df, list(keys), name="pos").withColumn("pos", F.col("pos") + 1)


def arranged(df: DataFrame, *first: str) -> DataFrame:
    """The columns named first, the others after them as they were."""
    return df.select(*first, *[c for c in df.columns if c not in first])
