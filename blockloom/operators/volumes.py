"""Volumes, snapshots and clones. A clone is one row of metadata; reads resolve through the chain of backing volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.sources.shared import materialise

ROOT = 0
#: Chains longer than two to the power of this are an error (a cycle).
ROUNDS = 40
#: Later than every entry.
NEVER = (1 << 63) - 1


def volumes_of(nation: DataFrame) -> DataFrame:
    """fsid, name, backing_fsid; the root is the zero volume."""
    return nation.select((F.col("n_nationkey") + 1).alias("fsid"), F.col("n_name").alias("name"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("backing_fsid"))


def ancestry(volumes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """fsid, ancestor, depth and upto: each (wanted) volume with itself (0) and every volume it stands on.

    upto is the last sequence number of the ancestor's entries that the volume sees: a clone sees what was written
    before it was made (volumes.made; without it, everything). Each round doubles the part of each chain that is known.
    """
    made = F.coalesce("made", F.lit(NEVER)) if "made" in volumes.columns else F.lit(NEVER)
    jump = materialise(volumes.where(F.col("backing_fsid") != ROOT).select("fsid", F.col("backing_fsid").alias("to"), made.cast("long").alias("upto")))
    start = volumes if wanted is None else volumes.join(wanted.select("fsid").distinct(), "fsid", "left_semi")
    known = start.select("fsid", F.col("fsid").alias("ancestor"), F.lit(0).alias("depth"), F.lit(NEVER).alias("upto"))
    for n in range(ROUNDS):
        if not jump.limit(1).count():
            return known
        step = jump.select(F.col("fsid").alias("ancestor"), "to", F.col("upto").alias("till"))
        above = known.join(step, "ancestor").select("fsid", F.col("to").alias("ancestor"), (F.col("depth") + (1 << n)).cast("int").alias("depth"), F.least("upto", "till").alias("upto"))
        known = materialise(known.unionByName(above))
        over = jump.select(F.col("fsid").alias("to"), F.col("to").alias("to_"), F.col("upto").alias("till"))
        jump = materialise(jump.join(over, "to").select("fsid", F.col("to_").alias("to"), F.least("upto", "till").alias("upto")))
    raise ValueError("the volumes' chains have a cycle")


def resolve(blockmap: DataFrame, volumes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """fsid, ino, fbn, dbn and depth as each (wanted) volume reads: the nearest ancestor that has the block wins, and its newest
    entry (by seq, if the map has it) among those that the volume sees. A hole (dbn 0) hides what lies below it."""
    entries = blockmap.select(F.col("fsid").alias("ancestor"), "ino", "fbn", "dbn", (F.col("seq") if "seq" in blockmap.columns else F.lit(0)).cast("long").alias("seq"))
    seen = entries.join(ancestry(volumes, wanted), "ancestor").where("seq <= upto")
    nearest = F.max_by(F.struct("dbn", "depth"), F.struct(-F.col("depth"), F.col("seq"), F.col("dbn")))
    return seen.groupBy("fsid", "ino", "fbn").agg(nearest.alias("x")).select("fsid", "ino", "fbn", "x.dbn", "x.depth")


def snapshot(volumes: DataFrame, of: int, fsid: int, name: str, seq: int) -> DataFrame:
    """The volumes with one more, which stands on `of` as it was after the entry seq: one row, whatever the volume holds."""
    new = volumes.where(F.col("fsid") == of).select(F.lit(fsid).alias("fsid"), F.lit(name).alias("name"), F.lit(of).alias("backing_fsid"), F.lit(seq).cast("long").alias("made"))
    return volumes.select("fsid", "name", "backing_fsid", F.col("made") if "made" in volumes.columns else F.lit(None).cast("long").alias("made")).unionByName(new)


def open_volume(blockmap: DataFrame, volumes: DataFrame, fsid: int, view: str) -> DataFrame:
    """Mounts a volume: a view with its name, of the blocks as it reads them."""
    one = resolve(blockmap, volumes, volumes.where(F.col("fsid") == fsid)).where("dbn <> 0").select("ino", "fbn", "dbn")
    one.createOrReplaceTempView(view)
    return one


def close_volume(volumes: DataFrame, view: str) -> bool:
    return volumes.sparkSession.catalog.dropTempView(view)


def clone_files(aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Files that stand for others: fsid, ino take the blocks of src_fsid, src_ino."""
    source = files.select(F.col("fsid").alias("src_fsid"), F.col("ino").alias("src_ino"), "fbn", "dbn")
    return aliases.join(source, ["src_fsid", "src_ino"]).select("fsid", "ino", "fbn", "dbn")


def clone_directory(inodes: DataFrame, prefix: str, to_fsid: int, to_prefix: str) -> DataFrame:
    """A row for each file under the prefix; its new number is the old one."""
    return inodes.where(F.col("path").startswith(prefix)).select(
        F.lit(to_fsid).alias("fsid"), "ino", F.col("fsid").alias("src_fsid"), F.col("ino").alias("src_ino"),
        F.concat(F.lit(to_prefix), F.substring("path", len(prefix) + 1, 1 << 20)).alias("path"),
    )


def move(inodes: DataFrame, prefix: str, to_prefix: str) -> DataFrame:
    """Every path with the prefix changed; the rest as it is."""
    new = F.concat(F.lit(to_prefix), F.substring("path", len(prefix) + 1, 1 << 20))
    return inodes.withColumn("path", F.when(F.col("path").startswith(prefix), new).otherwise(F.col("path")))


def rename(inodes: DataFrame, path: str, name: str) -> DataFrame:
    """The file or folder at path, with all below it, under another name in the same folder."""
    to = path.rsplit("/", 1)[0] + "/" + name
    own = (F.col("path") == path) | F.col("path").startswith(path + "/")
    return inodes.withColumn("path", F.when(own, F.concat(F.lit(to), F.substring("path", len(path) + 1, 1 << 20))).otherwise(F.col("path")))


def remove(inodes: DataFrame, path: str) -> DataFrame:
    """All but the file or folder at path and what is below it."""
    return inodes.where(F.col("path").isNull() | ~((F.col("path") == path) | F.col("path").startswith(path + "/")))


def new_folder(folders: DataFrame, path: str) -> DataFrame:
    """The folders (path) with one more; one that is there stays as it is."""
    return folders.select("path").unionByName(folders.sparkSession.range(1).select(F.lit(path).alias("path"))).distinct()


def alive(volumes: DataFrame, now: str, after: str = "autodel_ts") -> DataFrame:
    """Volumes whose time of deletion (none: never) is yet to come. The time is a literal against the bare column."""
    return volumes.where(F.col(after).isNull() | (F.col(after) > F.to_timestamp(F.lit(now))))


def refreshed(clog: DataFrame, by: str = "fsid") -> DataFrame:
    """The volume and the time of its last entry."""
    return clog.groupBy(by).agg(F.max("ts").alias("last_refreshed"))


def valid_new(candidates: DataFrame, volumes: DataFrame, most: int = 1024) -> DataFrame:
    """New volumes whose backing volume is there, with names not taken (of candidates with one name: none) and comments short enough."""
    there = volumes.select(F.col("fsid").alias("backing_fsid"))
    ok = candidates.where((F.length("name") > 0) & (F.coalesce(F.length("comments"), F.lit(0)) <= most))
    once = candidates.groupBy("name").agg(F.count("*").alias("c")).where("c = 1")
    return ok.join(there, "backing_fsid", "left_semi").join(volumes.select("name"), "name", "left_anti").join(once, "name", "left_semi")


def delete(volumes: DataFrame, gone: DataFrame) -> DataFrame:
    """Volumes that stay; one that others stand on can't go."""
    used = volumes.select(F.col("backing_fsid").alias("fsid"))
    return volumes.join(gone.select("fsid").join(used, "fsid", "left_anti"), "fsid", "left_anti")




def freed_by(volumes: DataFrame, gone: DataFrame, blockmap: DataFrame) -> DataFrame:
    """dbn of the blocks that only volumes refer to that delete() lets go."""
    kept = blockmap.join(delete(volumes, gone).select("fsid"), "fsid", "left_semi").select("dbn")
    return blockmap.select("dbn").distinct().join(kept, "dbn", "left_anti")


def clone_lun(luns: DataFrame, of: int, drive_id: int) -> DataFrame:
    """The LUNs (drive_id, size, state, backing) with a clone of one: a row, as for volumes."""
    new = luns.where(F.col("drive_id") == of).select(F.lit(drive_id).cast("long").alias("drive_id"), "size", F.lit("unmounted").alias("state"), F.lit(of).cast("long").alias("backing"))
    return luns.unionByName(new)


def set_lun_state(luns: DataFrame, drive_id: int, state: str) -> DataFrame:
    return luns.withColumn("state", F.when(F.col("drive_id") == drive_id, F.lit(state)).otherwise(F.col("state")))


def delete_lun(luns: DataFrame, drive_id: int) -> DataFrame:
    """Without the LUN, if no other stands on it and it isn't mounted."""
    used = luns.where(F.col("backing") == drive_id).select(F.col("backing").alias("drive_id"))
    goes = luns.where((F.col("drive_id") == drive_id) & (F.col("state") != "mounted")).select("drive_id").join(used, "drive_id", "left_anti")
    return luns.join(goes, "drive_id", "left_anti")
