"""Files as blocks: splitting, numbering, reassembly, truncation.

A file is (fsid, ino, text); a block is BLOCK characters of it. Blocks get disk
block numbers in the order of inodes. An empty or null file has no blocks. A file is
known by fsid and ino; two rows with the same ones are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.order import running

BLOCK = 256
#: The volume of files whose source names none.
NOWHERE = -1


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files: the volume is the number in source, NOWHERE if there is none."""
    return documents.select(F.coalesce(F.substring("source", 4, 10).try_cast("int"), F.lit(NOWHERE)).alias("fsid"), F.col("doc_id").alias("ino"), "text")


def inodes(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """fsid, ino, path, size, nblocks."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return files.select("fsid", "ino", F.concat(F.lit("/vol"), "fsid", F.lit("/"), F.floor(F.col("ino") / 100), F.lit("/"), "ino").alias("path"), size.alias("size"), F.ceil(size / block).cast("long").alias("nblocks"))


def bases(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """fsid, ino and base: the blocks of all files before. Fails if a file stands there twice."""
    sizes = files.select("fsid", "ino", F.coalesce(F.ceil(F.length("text") / block), F.lit(0)).cast("long").alias("n"))
    twice = sizes.groupBy("fsid", "ino").agg(F.count("*").alias("c")).where("c > 1").limit(1).collect()
    if twice:
        raise ValueError(f"volume {twice[0].fsid} holds inode {twice[0].ino} {twice[0].c} times")
    return running(sizes.where("n > 0"), ["ino", "fsid"], "n", "base").select("fsid", "ino", "base")


def blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """fsid, ino, fbn, dbn, fp, len and data of every block."""
    cut = files.where(F.length("text") > 0).join(bases(files, block), ["fsid", "ino"]).select(
        "fsid", "ino", "base", F.posexplode(F.expr(f"transform(sequence(0, cast(ceil(length(text) / {block}) as int) - 1), i -> substring(text, i * {block} + 1, {block}))")).alias("fbn", "data")
    )
    return cut.select("fsid", "ino", F.col("fbn").cast("long").alias("fbn"), (F.col("base") + F.col("fbn") + 1).alias("dbn"), F.md5("data").alias("fp"), F.length("data").cast("long").alias("len"), "data")


def block_data(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """ino, fbn and data, for reading without block numbers."""
    cut = files.where(F.length("text") > 0)
    return cut.select("fsid", "ino", F.posexplode(F.expr(f"transform(sequence(0, cast(ceil(length(text) / {block}) as int) - 1), i -> substring(text, i * {block} + 1, {block}))")).alias("fbn", "data"))


def reassemble(data: DataFrame) -> DataFrame:
    """ino and fp of each file put together again from its blocks."""
    parts = data.groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("fbn", "data"))).alias("parts"))
    return parts.select("ino", F.md5(F.array_join(F.col("parts.data"), "")).alias("fp"))


def paths(inodes_: DataFrame) -> DataFrame:
    """ino and path of a tree of ino, parent (0 or null: none) and name: each round doubles the part of the way that is known."""
    from blockloom.sources.shared import materialise

    way = materialise(inodes_.select("ino", F.when(F.col("parent") != 0, F.col("parent")).alias("up"), F.concat(F.lit("/"), "name").alias("path")))
    for _ in range(64):
        if not way.where("up is not null").limit(1).count():
            return way.select("ino", "path")
        above = way.select(F.col("ino").alias("up"), F.col("up").alias("up_"), F.col("path").alias("path_"))
        far = way.join(above, "up", "left").select("ino", F.col("up_").alias("up"), F.concat(F.coalesce("path_", F.lit("")), "path").alias("path"))
        way = materialise(far)
    raise ValueError("the tree has a cycle")


def truncate_freed(blocks_: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks that are freed when files shrink: ino, size to the new sizes."""
    return blocks_.join(sizes.select("ino", "new_size"), "ino").where(F.col("fbn") >= F.ceil(F.col("new_size") / block))
