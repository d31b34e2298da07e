"""The dedupe dataflow: changelog, fingerprint database, script, sharing.

Donors are chosen by a minimum for each fingerprint, which Spark sums up before
it shuffles; the script joins on fingerprints, and a frequent one (the blocks of
many copies) is split by adaptive execution. run() is the whole flow over a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.sources.shared import materialise
from blockloom.sources.store import Store


def clog_of_events(events: DataFrame) -> DataFrame:
    """The write log in events: an error punches a hole, all else writes; the block written is the event's own number."""
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "PUNCH").otherwise("WRITE").alias("op"),
        F.col("user_id").alias("ino"), F.get_json_object("props", "$.k").cast("long").alias("fbn"), F.col("event_id").alias("dbn"),
    )


def newest(clog: DataFrame, *key: str) -> DataFrame:
    """The last entry for each key, by time and then by sequence."""
    own = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("seq"))
    return clog.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def overwritten(clog: DataFrame, *key: str) -> DataFrame:
    """The entries with overwritten: whether an earlier one wrote the same place."""
    own = Window.partitionBy(*key).orderBy("ts", "seq")
    return clog.withColumn("overwritten", F.row_number().over(own) > 1)


def place(*tables: DataFrame) -> list[str]:
    """The columns that name a place in a file: with the volume, if all tables have one."""
    return ["fsid", "ino", "fbn"] if all("fsid" in t.columns for t in tables) else ["ino", "fbn"]


def live(clog: DataFrame, blockmap: DataFrame) -> DataFrame:
    """Entries whose block is the mapped one still."""
    at = [*place(clog, blockmap), "dbn"]
    return clog.join(blockmap.select(*at), at, "left_semi")


def fpdb(blocks: DataFrame) -> DataFrame:
    """fp and its donor, the smallest block that holds it."""
    return blocks.groupBy("fp").agg(F.min("dbn").alias("dbn"))


def without_deleted(fpdb_: DataFrame, deleted: DataFrame) -> DataFrame:
    return fpdb_.join(deleted.select("dbn"), "dbn", "left_anti")


def donors(clog: DataFrame, fpdb_: DataFrame) -> DataFrame:
    """fp, donor and whether the database knew it, for each fingerprint in the changelog."""
    own = clog.groupBy("fp").agg(F.min("dbn").alias("least"))
    return own.join(fpdb_.select("fp", F.col("dbn").alias("known")), "fp", "left").select("fp", F.coalesce("known", "least").alias("donor"), F.col("known").isNotNull().alias("old"))


def script(clog: DataFrame, fpdb_: DataFrame) -> DataFrame:
    """fsid, ino, fbn, old_dbn, new_dbn of the blocks to share."""
    met = clog.join(donors(clog, fpdb_), "fp").where(F.col("dbn") != F.col("donor"))
    return met.select("fsid", "ino", "fbn", F.col("dbn").alias("old_dbn"), F.col("donor").alias("new_dbn"))


def merged(clog: DataFrame, fpdb_: DataFrame) -> DataFrame:
    """The database with the changelog's new fingerprints."""
    new = donors(clog, fpdb_).where(~F.col("old")).select("fp", F.col("donor").alias("dbn"))
    return fpdb_.select("fp", "dbn").unionByName(new)


def shared(blockmap: DataFrame, script_: DataFrame) -> DataFrame:
    """The block map after the script; its other columns stay."""
    at = ["fsid", "ino", "fbn"]
    return blockmap.join(script_.select(*at, "new_dbn"), at, "left").withColumn("dbn", F.coalesce("new_dbn", "dbn")).select(*blockmap.columns)


def refcount(blockmap: DataFrame) -> DataFrame:
    return blockmap.groupBy("dbn").agg(F.count("*").alias("n"))


def ignore_shared(clog: DataFrame, refcounts: DataFrame) -> DataFrame:
    """Entries whose block has one reference."""
    return clog.join(refcounts.where("n = 1").select("dbn"), "dbn", "left_semi")


def shared_by(blockmap: DataFrame, a: int, b: int) -> DataFrame:
    """dbn of the blocks that both volumes refer to."""
    own = lambda fsid: blockmap.where(F.col("fsid") == fsid).select("dbn")
    return own(a).intersect(own(b))


def freed(script_: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks that the script gave up and nothing refers to any more."""
    return script_.select(F.col("old_dbn").alias("dbn")).distinct().join(after.select("dbn").distinct(), "dbn", "left_anti")


def opened(store: Store, blockmap: DataFrame, clog: DataFrame, fpdb_: DataFrame, deleted: DataFrame | None = None) -> Store:
    """The store with its first version: map, changelog, database, and the log of deleted blocks."""
    none = blockmap.select("dbn").limit(0)
    store.publish(blockmap=blockmap, clog=clog, fpdb=fpdb_, deletelog=none if deleted is None else deleted.select("dbn"), refcounts=refcount(blockmap))
    return store


def run(store: Store, ignore_shared_: bool = False) -> int:
    """One run over the last version of the store, published as the next; returns the number of blocks re-pointed.

    Changelog: the newest entry of each place, if it is a write and still mapped (with ignore_shared_: and its block has
    one reference). Database: without deleted blocks. The script re-points the map, the database takes the changelog's
    new fingerprints, reference counts are counted anew, and the log of deleted blocks is emptied. The database is
    written in the order of blocks, the script in that of files.
    """
    blockmap, fpdb_ = store.read("blockmap"), store.read("fpdb")
    log = live(newest(store.read("clog"), "fsid", "ino", "fbn").where("op = 'WRITE'"), blockmap)
    if ignore_shared_:
        log = ignore_shared(log, store.read("refcounts"))
    log = materialise(log.select("fsid", "ino", "fbn", "dbn", "fp"))
    base = materialise(without_deleted(fpdb_, store.read("deletelog")).select("fp", "dbn"))
    made = materialise(script(log, base))
    after = materialise(shared(blockmap, made))
    gone = freed(made, after)
    store.publish(
        blockmap=after, fpdb=merged(log, base), script=made, refcounts=refcount(after), freed=gone,
        deletelog=store.read("deletelog").limit(0),
    )
    return made.count()
