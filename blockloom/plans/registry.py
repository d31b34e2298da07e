"""Every query by name, with the DuckDB SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import wire
from blockloom.operators import backup, blocks, dedupe, device, order, space, volumes
from blockloom.sources import container
from blockloom.sources.shared import materialise, shared_folder
from blockloom.sources.store import Store
from blockloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CAPACITY = 1 << 30

# Common parts of the SQL
_BLOCKS = """ino AS (SELECT CAST(substr(source, 4) AS INTEGER) AS fsid, doc_id AS ino, text, CAST(ceil(length(text) / 256.0) AS BIGINT) AS nb FROM documents WHERE length(text) > 0),
base AS (SELECT *, CAST(coalesce(sum(nb) OVER (ORDER BY ino ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM ino),
cut AS (SELECT fsid, ino, text, b, unnest(range(nb)) AS fbn FROM base),
blocks AS (SELECT fsid, ino, fbn, b + fbn + 1 AS dbn, md5(substr(text, fbn * 256 + 1, 256)) AS fp, CAST(length(substr(text, fbn * 256 + 1, 256)) AS BIGINT) AS len FROM cut)"""
_DEDUPE = f"""{_BLOCKS},
clog AS (SELECT * FROM blocks WHERE ino % 10 = 0),
fpdb AS (SELECT fp, min(dbn) AS dbn FROM blocks WHERE ino % 10 <> 0 GROUP BY fp),
donors AS (SELECT c.fp, coalesce(f.dbn, c.least) AS donor, f.dbn IS NOT NULL AS old FROM (SELECT fp, min(dbn) AS least FROM clog GROUP BY fp) c LEFT JOIN fpdb f ON c.fp = f.fp),
script AS (SELECT fsid, ino, fbn, dbn AS old_dbn, donor AS new_dbn FROM clog JOIN donors USING (fp) WHERE dbn <> donor),
after AS (SELECT b.fsid, b.ino, b.fbn, coalesce(s.new_dbn, b.dbn) AS dbn FROM blocks b LEFT JOIN script s ON b.ino = s.ino AND b.fbn = s.fbn)"""
_CLOG = """clog AS (SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'PUNCH' ELSE 'WRITE' END AS op, user_id AS ino, CAST(json_extract_string(props, '$.k') AS BIGINT) AS fbn, event_id AS dbn FROM events),
clean AS (SELECT * FROM clog QUALIFY row_number() OVER (PARTITION BY ino, fbn ORDER BY ts DESC, seq DESC) = 1)"""
_MESSAGES = """messages AS (SELECT CAST(CASE WHEN event_type = 'error' THEN 9 WHEN event_type = 'click' THEN 7 ELSE 5 END AS INTEGER) AS optype,
CAST(CASE WHEN event_type = 'click' THEN (k % 4 + 1) * 512 ELSE 0 END AS INTEGER) AS payload_size, CAST(user_id AS INTEGER) AS driveid, k * 4096 AS driveoffset, CAST((k % 4 + 1) * 512 AS INTEGER) AS datasize, event_id AS seq_num
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_VOLUMES = "volumes AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS fsid, n_name AS name, CAST(floor(n_nationkey / 2.0) AS INTEGER) AS backing_fsid FROM nation)"
_UP = f"""{_VOLUMES}, up AS (SELECT fsid, fsid AS ancestor, 0 AS depth FROM volumes
UNION ALL SELECT u.fsid, v.backing_fsid, u.depth + 1 FROM up u JOIN volumes v ON v.fsid = u.ancestor WHERE v.backing_fsid <> 0)"""
_INODES = "inodes AS (SELECT CAST(substr(source, 4) AS INTEGER) AS fsid, doc_id AS ino, '/vol' || CAST(substr(source, 4) AS INTEGER) || '/' || CAST(floor(doc_id / 100.0) AS BIGINT) || '/' || doc_id AS path, CAST(length(text) AS BIGINT) AS size, CAST(ceil(length(text) / 256.0) AS BIGINT) AS nblocks FROM documents)"


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def files(spark: SparkSession, d: str) -> DataFrame:
    return blocks.files_of(table(spark, d, "documents"))


_STORES: dict[tuple[str, str], Store] = {}


def stored(spark: SparkSession, d: str) -> Store:
    """The tables' files as the engine holds them: cut, numbered and written once in a session, sorted and partitioned for its queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = Store(spark, shared_folder(spark))
        store.publish(blockmap=blocks.blocks(files(spark, d)))
        _STORES[key] = store
    return _STORES[key]


def all_blocks(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).read("blockmap")


def clog(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.clog_of_events(table(spark, d, "events"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return device.messages_of(table(spark, d, "events"))


def vols(spark: SparkSession, d: str) -> DataFrame:
    return volumes.volumes_of(table(spark, d, "nation"))


def log_of(every: DataFrame) -> DataFrame:
    """Blocks as entries of the changelog."""
    return every.select(F.col("dbn").alias("seq"), F.lit(0).alias("ts"), F.lit("WRITE").alias("op"), "fsid", "ino", "fbn", "dbn", "fp")


def opened(spark: SparkSession, d: str) -> Store:
    """A store of its own, before a dedupe run: the map of all blocks, the changelog and the database of parts()."""
    every, log, base = parts(spark, d)
    return dedupe.opened(Store(spark, shared_folder(spark)), every.drop("data"), log_of(log), base)


def inodes(spark: SparkSession, d: str) -> DataFrame:
    return blocks.inodes(files(spark, d))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All blocks, the changelog (every tenth inode), and the database of the rest."""
    every = all_blocks(spark, d)
    return every, every.where("ino % 10 = 0"), dedupe.fpdb(every.where("ino % 10 <> 0"))


# blocks and space


@query(f"WITH {_BLOCKS} SELECT fsid, ino, fbn, dbn, fp FROM blocks")
def blocks_of_documents(spark, d):
    return all_blocks(spark, d).select("fsid", "ino", "fbn", "dbn", "fp")


@query("SELECT doc_id AS ino, md5(text) AS fp FROM documents WHERE length(text) > 0")
def file_reassemble(spark, d):
    return blocks.reassemble(all_blocks(spark, d))


_SUMMARY = f"""WITH {_BLOCKS}, per AS (SELECT fp, count(*) AS n, max(len) AS len FROM blocks GROUP BY fp)
SELECT CAST(sum(n * len) AS BIGINT) AS logical, CAST(sum(len) AS BIGINT) AS physical, CAST(sum(n * len) - sum(len) AS BIGINT) AS savings, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS distinct_blocks,
CAST({CAPACITY} AS BIGINT) AS capacity, CAST({CAPACITY} - sum(len) AS BIGINT) AS free FROM per"""


@query(_SUMMARY)
def space_summary(spark, d):
    return space.summary(all_blocks(spark, d), CAPACITY)


_BY_VOLUME = f"""WITH {_BLOCKS}, per AS (SELECT fsid, fp, count(*) AS n, max(len) AS len FROM blocks GROUP BY fsid, fp)
SELECT fsid, CAST(0 AS INTEGER) AS is_total, CAST(sum(n * len) AS BIGINT) AS logical, CAST(sum(len) AS BIGINT) AS physical FROM per GROUP BY fsid
UNION ALL SELECT NULL, 1, CAST(sum(n * len) AS BIGINT), CAST(sum(len) AS BIGINT) FROM (SELECT fp, sum(n) AS n, max(len) AS len FROM per GROUP BY fp)"""


@query(_BY_VOLUME)
def space_by_volume(spark, d):
    return space.by_volume(all_blocks(spark, d))


@query(f"""WITH {_BLOCKS}, s AS (SELECT (SELECT CAST(sum(len) AS BIGINT) FROM blocks) AS l, (SELECT CAST(sum(len) AS BIGINT) FROM (SELECT max(len) AS len FROM blocks GROUP BY fp)) AS p)
SELECT 'virtual_disk' AS name, CAST({CAPACITY} AS BIGINT) AS bytes FROM s UNION ALL SELECT 'free', CAST({CAPACITY} - p AS BIGINT) FROM s UNION ALL SELECT 'visible', l FROM s""")
def space_sizes(spark, d):
    return space.sizes(all_blocks(spark, d), CAPACITY)


@query(f"WITH {_BLOCKS} SELECT fp, count(*) AS n FROM blocks GROUP BY fp HAVING count(*) > 1")
def fp_duplicates(spark, d):
    return all_blocks(spark, d).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {_CLOG} SELECT ino, CAST(sum(CASE WHEN op = 'WRITE' THEN 1 ELSE 0 END) AS BIGINT) AS allocated, CAST(sum(CASE WHEN op = 'PUNCH' THEN 1 ELSE 0 END) AS BIGINT) AS freed, CAST(sum(CASE WHEN op = 'WRITE' THEN 1 ELSE -1 END) AS BIGINT) AS net FROM clog GROUP BY ino")
def space_predicted(spark, d):
    return space.predicted(clog(spark, d))


# changelog, fingerprint database, script


@query(f"WITH {_CLOG} SELECT seq, op, ino, fbn, dbn FROM clean")
def clog_clean(spark, d):
    return dedupe.newest(clog(spark, d), "ino", "fbn").select("seq", "op", "ino", "fbn", "dbn")


@query(f"WITH {_CLOG} SELECT seq, row_number() OVER (PARTITION BY ino, fbn ORDER BY ts, seq) > 1 AS overwritten FROM clog")
def clog_overwritten(spark, d):
    return dedupe.overwritten(clog(spark, d), "ino", "fbn").select("seq", "overwritten")


@query(f"WITH {_CLOG} SELECT ino, fbn, seq, row_number() OVER (ORDER BY ino, fbn, seq) AS pos FROM clog")
def sort_ino_fbn(spark, d):
    return order.placed(clog(spark, d).select("ino", "fbn", "seq"), "ino", "fbn", "seq")


@query(f"WITH {_BLOCKS} SELECT dbn, row_number() OVER (ORDER BY dbn) AS pos FROM blocks")
def sort_dbn(spark, d):
    return order.placed(all_blocks(spark, d).select("dbn"), "dbn")


@query(f"WITH {_BLOCKS} SELECT fp, dbn, row_number() OVER (ORDER BY fp, dbn) AS pos FROM blocks")
def sort_fp(spark, d):
    return order.placed(all_blocks(spark, d).select("fp", "dbn"), "fp", "dbn")


@query(f"WITH {_CLOG} SELECT seq, ino, fbn, dbn FROM clog c WHERE EXISTS (SELECT 1 FROM clean m WHERE m.op = 'WRITE' AND m.ino = c.ino AND m.fbn = c.fbn AND m.dbn = c.dbn)")
def clog_live(spark, d):
    log = clog(spark, d)
    mapped = dedupe.newest(log, "ino", "fbn").where("op = 'WRITE'")
    return dedupe.live(log, mapped).select("seq", "ino", "fbn", "dbn")


@query(f"WITH {_DEDUPE} SELECT fp, dbn FROM fpdb")
def fpdb_build(spark, d):
    return parts(spark, d)[2]


@query(f"WITH {_DEDUPE} SELECT fp, dbn FROM fpdb WHERE dbn NOT IN (SELECT dbn FROM blocks WHERE ino % 10 = 1)")
def fpdb_clean(spark, d):
    every, _, base = parts(spark, d)
    return dedupe.without_deleted(base, every.where("ino % 10 = 1")).select("fp", "dbn")


@query(f"WITH {_DEDUPE} SELECT * FROM script")
def dedupe_script(spark, d):
    _, log, base = parts(spark, d)
    return dedupe.script(log, base)


@query(f"WITH {_BLOCKS}, least AS (SELECT fp, min(dbn) AS donor FROM blocks GROUP BY fp) SELECT fsid, ino, fbn, dbn AS old_dbn, donor AS new_dbn FROM blocks JOIN least USING (fp) WHERE dbn <> donor")
def dedupe_script_full(spark, d):
    every = all_blocks(spark, d)
    return dedupe.script(every, every.select("fp", "dbn").limit(0))


@query(f"WITH {_DEDUPE} SELECT fp, dbn FROM fpdb UNION ALL SELECT fp, donor FROM donors WHERE NOT old")
def fpdb_merged(spark, d):
    _, log, base = parts(spark, d)
    return dedupe.merged(log, base)


@query(f"WITH {_DEDUPE} SELECT * FROM after")
def blockmap_shared(spark, d):
    every, log, base = parts(spark, d)
    return dedupe.shared(every, dedupe.script(log, base)).select("fsid", "ino", "fbn", "dbn")


@query(f"WITH {_DEDUPE}, one AS (SELECT dbn FROM after GROUP BY dbn HAVING count(*) = 1) SELECT fsid, ino, fbn, dbn FROM after WHERE dbn IN (SELECT dbn FROM one)")
def dedupe_ignore_shared(spark, d):
    every, log, base = parts(spark, d)
    after = dedupe.shared(every, dedupe.script(log, base))
    return dedupe.ignore_shared(after, dedupe.refcount(after)).select("fsid", "ino", "fbn", "dbn")


@query(f"WITH {_DEDUPE} SELECT DISTINCT old_dbn AS dbn FROM script WHERE old_dbn NOT IN (SELECT dbn FROM after)")
def freed_blocks(spark, d):
    every, log, base = parts(spark, d)
    made = dedupe.script(log, base)
    return dedupe.freed(made, dedupe.shared(every, made))


_PAIR = f"""{_DEDUPE}, two AS (SELECT a.fsid AS a, b.fsid AS b FROM (SELECT DISTINCT fsid, dbn FROM after) a JOIN (SELECT DISTINCT fsid, dbn FROM after) b ON a.dbn = b.dbn AND a.fsid < b.fsid
GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"""


@query(f"WITH {_PAIR} SELECT dbn FROM after, two WHERE fsid = a INTERSECT SELECT dbn FROM after, two WHERE fsid = b")
def shared_between_volumes(spark, d):
    """The blocks that two volumes share, of the two that share most."""
    every, log, base = parts(spark, d)
    after = materialise(dedupe.shared(every, dedupe.script(log, base)).select("fsid", "dbn").distinct())
    pairs = after.withColumnRenamed("fsid", "a").join(after.withColumnRenamed("fsid", "b"), "dbn").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    most = pairs.orderBy(F.desc("n"), "a", "b").first()
    a, b = (most.a, most.b) if most else (0, 1)
    return dedupe.shared_by(after, a, b)


# the whole run over a store


@query(f"WITH {_DEDUPE} SELECT fsid, ino, fbn, dbn FROM after")
def dedupe_run(spark, d):
    store = opened(spark, d)
    dedupe.run(store)
    return store.read("blockmap").select("fsid", "ino", "fbn", "dbn")


@query(f"WITH {_DEDUPE} SELECT dbn, count(*) AS n FROM after GROUP BY dbn")
def dedupe_run_refcounts(spark, d):
    store = opened(spark, d)
    dedupe.run(store)
    return store.read("refcounts")


@query(f"WITH {_DEDUPE} SELECT (SELECT count(*) FROM script) AS first, CAST(0 AS BIGINT) AS second, (SELECT count(*) FROM after) AS blocks")
def dedupe_rerun_empty(spark, d):
    """Blocks that a run re-points, and a second one over what the first left."""
    store = opened(spark, d)
    made = [dedupe.run(store), dedupe.run(store)]
    return store.read("blockmap").agg(F.count("*").alias("blocks")).select(F.lit(made[0]).cast("long").alias("first"), F.lit(made[1]).cast("long").alias("second"), "blocks")


@query("SELECT doc_id AS ino, md5(text) AS fp FROM documents WHERE length(text) > 0")
def dedupe_content_unchanged(spark, d):
    """The files, read through the map that a run left and the blocks as they were written."""
    store = opened(spark, d)
    dedupe.run(store)
    data = all_blocks(spark, d).select("dbn", "data")
    return blocks.reassemble(store.read("blockmap").select("ino", "fbn", "dbn").join(data, "dbn"))


@query(f"""WITH {_DEDUPE}, one AS (SELECT dbn FROM after GROUP BY dbn HAVING count(*) = 1), merged AS (SELECT fp, dbn FROM fpdb UNION ALL SELECT fp, donor FROM donors WHERE NOT old),
clog2 AS (SELECT b.fsid, b.ino, b.fbn, a.dbn, b.fp FROM blocks b JOIN after a ON a.ino = b.ino AND a.fbn = b.fbn WHERE a.dbn IN (SELECT dbn FROM one)),
donors2 AS (SELECT c.fp, coalesce(f.dbn, c.least) AS donor FROM (SELECT fp, min(dbn) AS least FROM clog2 GROUP BY fp) c LEFT JOIN merged f ON c.fp = f.fp)
SELECT fsid, ino, fbn, dbn AS old_dbn, donor AS new_dbn FROM clog2 JOIN donors2 USING (fp) WHERE dbn <> donor""")
def dedupe_run_ignore_shared(spark, d):
    """The script of a second run, with every block in the changelog, that leaves shared blocks out."""
    store = opened(spark, d)
    dedupe.run(store)
    store.publish(clog=log_of(store.read("blockmap")))
    dedupe.run(store, ignore_shared_=True)
    return store.read("script")


# references


@query("SELECT l_partkey AS dbn, count(*) AS n FROM lineitem GROUP BY l_partkey")
def refcount_by_dbn(spark, d):
    return dedupe.refcount(table(spark, d, "lineitem").select(F.col("l_partkey").alias("dbn")))


@query("SELECT n, count(*) AS dbns FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey) GROUP BY n")
def refcount_histogram(spark, d):
    return refcount_by_dbn(spark, d).groupBy("n").agg(F.count("*").alias("dbns"))


@query("SELECT p_partkey AS dbn FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def allocation_free(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("dbn")).distinct()
    return space.free_blocks(table(spark, d, "part").select(F.col("p_partkey").alias("dbn")), used)


@query(f"""WITH RECURSIVE {_UP}, own AS (SELECT CAST(c_nationkey + 1 AS INTEGER) AS fsid, count(*) AS n FROM customer GROUP BY c_nationkey)
SELECT u.ancestor AS fsid, CAST(sum(o.n) AS BIGINT) AS effective FROM up u JOIN own o ON o.fsid = u.fsid GROUP BY u.ancestor""")
def refcount_hierarchical(spark, d):
    own = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).cast("int").alias("fsid")).agg(F.count("*").alias("n"))
    return volumes.ancestry(vols(spark, d)).join(own, "fsid").groupBy(F.col("ancestor").alias("fsid")).agg(F.sum("n").alias("effective"))


# volumes


@query(f"WITH RECURSIVE {_UP} SELECT fsid, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY fsid")
def volume_tree(spark, d):
    return volumes.ancestry(vols(spark, d)).groupBy("fsid").agg(F.max("depth").alias("depth"))


@query(f"WITH RECURSIVE {_UP} SELECT fsid, ancestor, depth FROM up")
def volume_ancestry(spark, d):
    return volumes.ancestry(vols(spark, d)).select("fsid", "ancestor", "depth")


@query(f"""WITH RECURSIVE {_UP}, m AS (SELECT CAST(c_nationkey + 1 AS INTEGER) AS fsid, c_custkey % 50 AS ino, CAST(0 AS BIGINT) AS fbn, max(c_custkey) AS dbn FROM customer GROUP BY 1, 2)
SELECT u.fsid, m.ino, m.fbn, m.dbn, u.depth FROM up u JOIN m ON m.fsid = u.ancestor QUALIFY row_number() OVER (PARTITION BY u.fsid, m.ino, m.fbn ORDER BY u.depth) = 1""")
def clone_resolve(spark, d):
    own = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).cast("int").alias("fsid"), (F.col("c_custkey") % 50).alias("ino"), F.lit(0).cast("long").alias("fbn")).agg(F.max("c_custkey").alias("dbn"))
    return volumes.resolve(own, vols(spark, d))


_MADE = "v2 AS (SELECT fsid, name, backing_fsid, CAST(fsid * 5 AS BIGINT) AS made FROM volumes)"
_SEEN = f"""{_VOLUMES}, {_MADE}, entries AS (SELECT c_custkey AS seq, CAST(c_nationkey + 1 AS INTEGER) AS fsid, c_custkey % 7 AS ino, CAST(c_custkey % 3 AS BIGINT) AS fbn, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey END AS dbn FROM customer),
up AS (SELECT fsid, fsid AS ancestor, 0 AS depth, CAST(9223372036854775807 AS BIGINT) AS upto FROM v2
UNION ALL SELECT u.fsid, v.backing_fsid, u.depth + 1, least(u.upto, v.made) FROM up u JOIN v2 v ON v.fsid = u.ancestor WHERE v.backing_fsid <> 0),
seen AS (SELECT u.fsid, e.ino, e.fbn, e.dbn FROM up u JOIN entries e ON e.fsid = u.ancestor AND e.seq <= u.upto QUALIFY row_number() OVER (PARTITION BY u.fsid, e.ino, e.fbn ORDER BY u.depth, e.seq DESC) = 1)"""


def versioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries with sequence numbers and holes, and volumes that were made at some of them."""
    k = F.col("c_custkey")
    dbn = F.when(k % 11 == 0, F.lit(0)).otherwise(k).cast("long")
    entries = table(spark, d, "customer").select(k.alias("seq"), (F.col("c_nationkey") + 1).cast("int").alias("fsid"), (k % 7).alias("ino"), (k % 3).cast("long").alias("fbn"), dbn.alias("dbn"))
    return entries, vols(spark, d).withColumn("made", (F.col("fsid") * 5).cast("long"))


@query(f"WITH RECURSIVE {_SEEN} SELECT fsid, ino, fbn, dbn FROM seen")
def snapshot_isolated(spark, d):
    """Each volume as it reads: what its ancestors wrote after it was made isn't seen."""
    return volumes.resolve(*versioned(spark, d)).select("fsid", "ino", "fbn", "dbn")


@query(f"WITH RECURSIVE {_SEEN} SELECT fsid, ino, fbn, dbn FROM seen WHERE fsid = 20 AND dbn <> 0")
def open_volume(spark, d):
    entries, every = versioned(spark, d)
    volumes.open_volume(entries, every, 20, "blockloom_volume")
    return spark.table("blockloom_volume").select(F.lit(20).alias("fsid"), "ino", "fbn", "dbn")


@query(f"WITH {_VOLUMES} SELECT fsid, name, backing_fsid, CAST(NULL AS BIGINT) AS made FROM volumes UNION ALL SELECT 100, 'before-upgrade', 3, 77")
def snapshot_create(spark, d):
    return volumes.snapshot(vols(spark, d), 3, 100, "before-upgrade", 77)


@query(f"""WITH {_VOLUMES}, m AS (SELECT CAST(c_nationkey + 1 AS INTEGER) AS fsid, c_custkey % 97 AS dbn FROM customer), gone AS (SELECT fsid FROM volumes WHERE fsid % 3 = 0 AND fsid NOT IN (SELECT backing_fsid FROM volumes))
SELECT DISTINCT dbn FROM m WHERE dbn NOT IN (SELECT dbn FROM m WHERE fsid IN (SELECT fsid FROM volumes) AND fsid NOT IN (SELECT fsid FROM gone))""")
def delete_frees(spark, d):
    every = vols(spark, d)
    own = table(spark, d, "customer").select((F.col("c_nationkey") + 1).cast("int").alias("fsid"), (F.col("c_custkey") % 97).alias("dbn"))
    return volumes.freed_by(every, every.where("fsid % 3 = 0"), own)


_LUNS = "luns AS (SELECT s_suppkey AS drive_id, CAST(s_suppkey * 1000000 AS BIGINT) AS size, CASE WHEN s_suppkey % 2 = 0 THEN 'mounted' ELSE 'unmounted' END AS state, CAST(NULL AS BIGINT) AS backing FROM supplier)"


@query(f"WITH {_LUNS} SELECT drive_id, size, CASE WHEN drive_id = 2 THEN 'unmounted' ELSE state END AS state, backing FROM luns WHERE drive_id <> 3 UNION ALL SELECT 5000, size, 'unmounted', 1 FROM luns WHERE drive_id = 1")
def lun_lifecycle(spark, d):
    """A clone of LUN 1; LUN 2 unmounted; LUN 3 deleted; LUN 1 and 4 can't be, as a clone stands on the one and the other is mounted."""
    k = F.col("s_suppkey")
    luns = table(spark, d, "supplier").select(k.alias("drive_id"), (k * 1_000_000).cast("long").alias("size"), F.when(k % 2 == 0, "mounted").otherwise("unmounted").alias("state"), F.lit(None).cast("long").alias("backing"))
    luns = volumes.set_lun_state(volumes.clone_lun(luns, 1, 5000), 2, "unmounted")
    for drive_id in (1, 3, 4):
        luns = volumes.delete_lun(luns, drive_id)
    return luns


@query(f"WITH {_INODES} SELECT fsid, ino, CASE WHEN path = '/vol3/0' OR starts_with(path, '/vol3/0/') THEN '/vol3/zero' || substr(path, 8) ELSE path END AS path FROM inodes WHERE NOT starts_with(path, '/vol1/') AND path <> '/vol1'")
def rename_and_delete(spark, d):
    return volumes.remove(volumes.rename(inodes(spark, d), "/vol3/0", "zero"), "/vol1").select("fsid", "ino", "path")


@query(f"WITH {_INODES} SELECT DISTINCT '/vol' || fsid AS path FROM inodes UNION SELECT '/vol3/new'")
def new_folder(spark, d):
    folders = inodes(spark, d).select(F.concat(F.lit("/vol"), "fsid").alias("path")).distinct()
    return volumes.new_folder(volumes.new_folder(folders, "/vol3/new"), "/vol3/new")


@query(f"WITH RECURSIVE {_VOLUMES}, p AS (SELECT fsid AS ino, '/' || name AS path FROM volumes WHERE backing_fsid = 0 UNION ALL SELECT v.fsid, p.path || '/' || v.name FROM volumes v JOIN p ON v.backing_fsid = p.ino) SELECT ino, path FROM p")
def inode_paths(spark, d):
    return blocks.paths(vols(spark, d).select(F.col("fsid").alias("ino"), F.col("backing_fsid").alias("parent"), "name"))


@query(f"WITH {_CLOG} SELECT ino AS fsid, max(ts) AS last_refreshed FROM clog GROUP BY ino")
def volume_refreshed(spark, d):
    return volumes.refreshed(clog(spark, d).withColumn("fsid", F.col("ino")))


@query("SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 1073741824 AS bytes FROM part WHERE p_partkey % 2 = 0 AND p_size >= 1 UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT) * 1099511627776 FROM part WHERE p_partkey % 2 = 1 AND p_size BETWEEN 1 AND 8")
def container_check(spark, d):
    k = F.col("p_partkey")
    asked = table(spark, d, "part").select(k.alias("id"), F.lit("/data").alias("location"), F.col("p_size").alias("size"), F.when(k % 2 == 0, "GB").otherwise("TB").alias("unit"))
    return container.valid(asked).select("id", "bytes")


@query(f"WITH {_BLOCKS} SELECT CAST(99 AS INTEGER) AS fsid, ino + 1000000 AS ino, fbn, dbn FROM blocks WHERE fsid = 3")
def file_clone(spark, d):
    own = files(spark, d).where("fsid = 3")
    aliases = own.select(F.lit(99).alias("fsid"), (F.col("ino") + 1_000_000).alias("ino"), F.col("fsid").alias("src_fsid"), F.col("ino").alias("src_ino"))
    return volumes.clone_files(aliases, all_blocks(spark, d))


@query(f"WITH {_INODES} SELECT CAST(77 AS INTEGER) AS fsid, ino, fsid AS src_fsid, ino AS src_ino, '/copy/' || substr(path, 7) AS path FROM inodes WHERE starts_with(path, '/vol3/')")
def dir_clone(spark, d):
    return volumes.clone_directory(inodes(spark, d), "/vol3/", 77, "/copy/")


@query(f"WITH {_INODES} SELECT fsid, ino, CASE WHEN starts_with(path, '/vol1/') THEN '/moved/' || substr(path, 7) ELSE path END AS path FROM inodes")
def move_directory(spark, d):
    return volumes.move(inodes(spark, d), "/vol1/", "/moved/").select("fsid", "ino", "path")


_NEW = "new AS (SELECT p_name || CAST(p_partkey % 50 AS VARCHAR) AS name, CAST(p_size AS INTEGER) AS backing_fsid, repeat('c', CAST(p_partkey % 1100 AS INTEGER)) AS comments FROM part)"


@query(f"WITH {_VOLUMES}, {_NEW} SELECT name, backing_fsid FROM new WHERE name IN (SELECT name FROM new GROUP BY name HAVING count(*) = 1) AND length(name) > 0 AND length(comments) <= 1024 AND backing_fsid IN (SELECT fsid FROM volumes) AND name NOT IN (SELECT name FROM volumes)")
def create_volume_check(spark, d):
    new = table(spark, d, "part").select(F.concat("p_name", (F.col("p_partkey") % 50).cast("string")).alias("name"), F.col("p_size").cast("int").alias("backing_fsid"), F.expr("repeat('c', cast(p_partkey % 1100 as int))").alias("comments"))
    return volumes.valid_new(new, vols(spark, d)).select("name", "backing_fsid")


@query(f"WITH {_VOLUMES} SELECT fsid, name, backing_fsid FROM volumes WHERE NOT (fsid % 3 = 0 AND fsid NOT IN (SELECT backing_fsid FROM volumes))")
def delete_volumes(spark, d):
    every = vols(spark, d)
    return volumes.delete(every, every.where("fsid % 3 = 0"))


@query("SELECT o_orderkey AS fsid FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01 00:00:00'")
def auto_delete(spark, d):
    """Volumes that go 30 days after their date are alive until then: the interval is taken off the literal, so the bound reaches the scan."""
    return volumes.alive(table(spark, d, "orders").where("o_orderdate is not null"), "1996-12-02 00:00:00", "o_orderdate").select(F.col("o_orderkey").alias("fsid"))


@query(f"""WITH {_VOLUMES}, {_BLOCKS} SELECT v.fsid, v.name, v.backing_fsid, CAST(coalesce(s.logical, 0) AS BIGINT) AS logical FROM volumes v
LEFT JOIN (SELECT fsid, sum(len) AS logical FROM blocks GROUP BY fsid) s ON s.fsid = v.fsid""")
def volume_properties(spark, d):
    sizes = files(spark, d).groupBy("fsid").agg(F.sum(F.length("text")).alias("logical"))
    return vols(spark, d).join(sizes, "fsid", "left").select("fsid", "name", "backing_fsid", F.coalesce("logical", F.lit(0)).cast("long").alias("logical"))


@query(f"WITH {_BLOCKS}, s AS (SELECT doc_id AS ino, CAST(floor(length(text) / 3.0) AS BIGINT) AS new_size FROM documents) SELECT b.ino, b.fbn, b.dbn FROM blocks b JOIN s USING (ino) WHERE b.fbn >= ceil(s.new_size / 256.0)")
def truncate_freed(spark, d):
    sizes = files(spark, d).select("ino", F.floor(F.length("text") / 3).alias("new_size"))
    return blocks.truncate_freed(all_blocks(spark, d), sizes).select("ino", "fbn", "dbn")


# backup: the last image lacks every seventh file, and has other text in every fifth

_LAST = "last AS (SELECT doc_id AS ino, CASE WHEN doc_id % 5 = 0 THEN 'x' || substr(text, 2) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


def last_image(spark: SparkSession, d: str) -> DataFrame:
    own = files(spark, d).where("ino % 7 <> 0")
    return own.withColumn("text", F.when(F.col("ino") % 5 == 0, F.concat(F.lit("x"), F.expr("substring(text, 2)"))).otherwise(F.col("text")))


_NOW = "now AS (SELECT doc_id AS ino, text FROM documents WHERE doc_id % 11 <> 0)"


@query(f"""WITH {_LAST}, {_NOW} SELECT CAST(coalesce(n.ino, l.ino) AS VARCHAR) AS path, CASE WHEN l.ino IS NULL THEN 'new' WHEN n.ino IS NULL THEN 'gone' WHEN md5(n.text) = md5(l.text) THEN 'same' ELSE 'changed' END AS status
FROM now n FULL OUTER JOIN last l ON n.ino = l.ino""")
def backup_file_list(spark, d):
    sums = lambda df: df.select(F.col("ino").cast("string").alias("path"), F.md5("text").alias("fp"))
    return backup.compare(sums(last_image(spark, d)), sums(files(spark, d).where("ino % 11 <> 0")))


_DELTA = f"""{_LAST}, lb AS (SELECT ino, fbn, md5(substr(text, fbn * 256 + 1, 256)) AS fp FROM (SELECT ino, text, unnest(range(CAST(ceil(length(text) / 256.0) AS BIGINT))) AS fbn FROM last)),
nb AS (SELECT doc_id AS ino, fbn, md5(substr(text, fbn * 256 + 1, 256)) AS fp, CAST(length(substr(text, fbn * 256 + 1, 256)) AS BIGINT) AS len FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 256.0) AS BIGINT))) AS fbn FROM documents)),
delta AS (SELECT * FROM nb n WHERE NOT EXISTS (SELECT 1 FROM lb l WHERE l.ino = n.ino AND l.fbn = n.fbn AND l.fp = n.fp))"""


def delta_blocks(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda df: blocks.block_data(df).select("ino", F.col("fbn").cast("long").alias("fbn"), F.md5("data").alias("fp"), F.length("data").cast("long").alias("len"))
    return backup.delta(hashed(last_image(spark, d)), hashed(files(spark, d)))


@query(f"WITH {_DELTA} SELECT ino, fbn, fp, len FROM delta")
def backup_delta(spark, d):
    return delta_blocks(spark, d).select("ino", "fbn", "fp", "len")


@query(f"WITH {_DELTA} SELECT count(DISTINCT ino) AS files, count(*) AS blocks, CAST(coalesce(sum(len), 0) AS BIGINT) AS data_copied FROM delta")
def backup_job_stats(spark, d):
    return backup.job(delta_blocks(spark, d))


@query(f"""WITH {_DELTA}, copied AS (SELECT ino % 5 AS task, fp, CAST(length(substr(text, fbn * 256 + 1, 256)) AS BIGINT) AS len FROM (SELECT l.ino, l.text, unnest(range(CAST(ceil(length(l.text) / 256.0) AS BIGINT))) AS fbn FROM last l) x, LATERAL (SELECT md5(substr(text, fbn * 256 + 1, 256)) AS fp)
UNION ALL SELECT ino % 5, fp, len FROM delta), per AS (SELECT task, fp, count(*) AS n, max(len) AS len FROM copied GROUP BY task, fp)
SELECT task, CAST(sum(n * len) AS BIGINT) AS logical, CAST(sum(len) AS BIGINT) AS physical FROM per GROUP BY task""")
def backup_task_sizes(spark, d):
    """The last image and the delta of five tasks."""
    first = blocks.block_data(last_image(spark, d)).select("ino", F.md5("data").alias("fp"), F.length("data").cast("long").alias("len"))
    copied = first.unionByName(delta_blocks(spark, d).select("ino", "fp", "len"))
    return backup.task_sizes(copied.withColumn("task", F.col("ino") % 5))


@query(f"WITH {_BLOCKS} SELECT ino, fbn FROM blocks WHERE dbn % 50 = 0")
def backup_scrub(spark, d):
    """Blocks of which a character has changed since their fingerprint was taken: every fiftieth."""
    changed = all_blocks(spark, d).withColumn("data", F.when(F.col("dbn") % 50 == 0, F.concat(F.lit("\u0001"), F.expr("substring(data, 2)"))).otherwise(F.col("data")))
    return backup.scrubbed(changed).select("ino", "fbn")


@query("SELECT o_custkey AS task, CAST(count(*) + 1 AS INTEGER) AS jobnum, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS backing FROM orders GROUP BY o_custkey")
def backup_clone_last(spark, d):
    return backup.clone_last(backup_jobs(spark, d))


@query("SELECT o_custkey AS task, o_orderkey AS job_id FROM orders WHERE o_custkey <> 7")
def backup_delete_task(spark, d):
    return backup.delete_task(backup_jobs(spark, d), 7).select("task", "job_id")


@query("SELECT o_custkey AS task, o_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS jobnum FROM orders")
def backup_jobs(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("backup_time"))
    return backup.numbered(jobs).select("task", "job_id", "jobnum")


@query("SELECT o_custkey AS task, CAST(count(*) + 1 AS INTEGER) AS next FROM orders GROUP BY o_custkey")
def backup_next_job(spark, d):
    return backup.next_number(backup_jobs(spark, d))


# devices


@query("SELECT doc_id AS ino, substr(text, 701, 1300) AS data FROM documents WHERE length(text) > 512")
def range_read(spark, d):
    return device.read_range(all_blocks(spark, d), 700, 1300, blocks.BLOCK)


# byte ranges: writes of 100 to 400 bytes at any place of 16 drives, a fifth of them holes, over a grid of 128
_WRITES = """w AS (SELECT event_id AS seq, user_id % 16 AS drive, CASE WHEN event_type = 'error' THEN 'PUNCH' ELSE 'WRITE' END AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 AS offset_, 100 + event_id % 4 * 100 AS size FROM events),
bytes AS (SELECT drive, offset_ + i AS pos, CASE WHEN arg_max(op, seq) = 'PUNCH' THEN 0 ELSE 97 + (max(seq) + arg_max(i, seq)) % 26 END AS b FROM (SELECT drive, op, seq, offset_, unnest(range(size)) AS i FROM w) GROUP BY drive, offset_ + i),
asked AS (SELECT seq AS req, drive, offset_ + 50 AS lo, size FROM w WHERE seq % 7 = 0)"""
_READ = f"""{_WRITES}, got AS (SELECT req, a.drive, string_agg(printf('%02X', CAST(coalesce(b.b, 0) AS INTEGER)), '' ORDER BY a.pos) AS data FROM (SELECT req, drive, unnest(range(lo, lo + size)) AS pos FROM asked) a
LEFT JOIN bytes b ON b.drive = a.drive AND b.pos = a.pos GROUP BY req, a.drive)"""


def writes(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    size = (F.lit(100) + F.col("event_id") % 4 * 100).cast("int")
    letters = F.expr("encode(array_join(transform(sequence(0, 399), i -> char(cast(97 + (event_id + i) % 26 as int))), ''), 'UTF-8')")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 16).alias("drive"), F.when(F.col("event_type") == "error", "PUNCH").otherwise("WRITE").alias("op"), (k * 37).alias("offset"), size.alias("size"), letters.alias("payload"))


@query(f"WITH {_READ} SELECT req, drive, data FROM got")
def device_read_after_writes(spark, d):
    every = writes(spark, d)
    asked = every.where("seq % 7 = 0").select(F.col("seq").alias("req"), "drive", (F.col("offset") + 50).alias("offset"), "size")
    return device.read_bytes(asked, device.block_image(every, 128), 128).select("req", "drive", F.hex("data").alias("data"))


@query(f"WITH {_READ} SELECT req, drive, upper(md5(unhex(data))) AS md5 FROM got")
def device_read_checked(spark, d):
    every = writes(spark, d)
    asked = every.where("seq % 7 = 0").select(F.col("seq").alias("req"), "drive", (F.col("offset") + 50).alias("offset"), "size")
    sizes = every.groupBy("drive").agg((F.max(F.col("offset") + F.col("size")) + 1000).alias("drive_size"))
    return device.read_checked(asked, device.block_image(every, 128), sizes, 128).select("req", "drive", "md5")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq_num FROM events")
def wire_stamped(spark, d):
    """Sequence numbers from 0 in the order of time."""
    events = table(spark, d, "events")
    sent = device.messages_of(events).join(events.select("event_id", "ts"), F.col("seq_num") == F.col("event_id"))
    return device.stamped(sent, "ts", "event_id").select("event_id", "seq_num")


@query("SELECT seq_num, prior FROM (SELECT event_id AS seq_num, lag(event_id) OVER (PARTITION BY CAST(user_id AS INTEGER) ORDER BY ts, event_id) AS prior FROM events) WHERE prior >= seq_num")
def wire_out_of_order(spark, d):
    events = table(spark, d, "events")
    sent = device.messages_of(events).join(events.select("event_id", "ts"), F.col("seq_num") == F.col("event_id")).withColumnRenamed("event_id", "at")
    return device.out_of_order(sent).select("seq_num", "prior")


@query(f"WITH {_CLOG} SELECT ino, fbn, CASE WHEN op = 'PUNCH' THEN 0 ELSE dbn END AS dbn FROM clean")
def device_image(spark, d):
    return device.image(clog(spark, d))


@query(f"WITH {_CLOG} SELECT ino, fbn FROM clean WHERE op = 'PUNCH'")
def punch_hole_map(spark, d):
    return device.image(clog(spark, d)).where("dbn = 0").select("ino", "fbn")


@query("SELECT conv_id AS ino, turn AS fbn, 'WRITE' AS op FROM conversations WHERE length(text) > 0 UNION ALL SELECT conv_id, turn, 'PUNCH' FROM conversations WHERE length(text) = 0 UNION ALL SELECT conv_id, turn + 1000, 'PUNCH' FROM conversations")
def scrub(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("ino"), F.col("turn").alias("fbn"), F.col("text").cast("binary").alias("data"))
    zeros = rows.select("ino", (F.col("fbn") + 1000).cast("int").alias("fbn"), F.unhex(F.lit("00" * 16)).alias("data"))
    return rows.unionByName(zeros).select("ino", "fbn", device.scrubbed(F.col("data")).alias("op"))


_LE = lambda x, n: "(" + " || ".join(f"printf('%02x', CAST((({x}) >> {8 * i}) & 255 AS INTEGER))" for i in range(n)) + ")"


@query(f"""WITH {_MESSAGES} SELECT seq_num, upper({_LE('CAST(optype AS BIGINT)', 4)} || {_LE('CAST(payload_size AS BIGINT)', 4)} || {_LE('CAST(driveid AS BIGINT)', 4)} || {_LE('driveoffset', 8)} || {_LE('CAST(datasize AS BIGINT)', 4)} || {_LE('seq_num', 8)}) || repeat('00', 96) AS header FROM messages""")
def wire_encode(spark, d):
    return device.encode(messages(spark, d)).select("seq_num", F.hex("header").alias("header"))


@query(f"WITH {_MESSAGES} SELECT optype, payload_size, driveid, driveoffset, datasize, seq_num FROM messages")
def wire_decode(spark, d):
    return device.decode(device.encode(messages(spark, d)))


@query(f"""WITH {_MESSAGES} SELECT q.seq_num, q.datasize, r.got FROM messages q LEFT JOIN (SELECT seq_num, CASE WHEN seq_num % 5 = 0 THEN 1 ELSE datasize END AS got FROM messages WHERE seq_num % 13 <> 0) r ON q.seq_num = r.seq_num
WHERE r.got IS NULL OR r.got <> q.datasize""")
def wire_mismatch(spark, d):
    sent = messages(spark, d)
    replies = sent.where("seq_num % 13 <> 0").withColumn("datasize", F.when(F.col("seq_num") % 5 == 0, 1).otherwise(F.col("datasize")))
    return device.mismatched(sent, replies)


@query(f"WITH {_MESSAGES} SELECT seq_num, CASE optype WHEN 5 THEN 'READ' WHEN 7 THEN 'WRITE' ELSE 'WRITE_PUNCH_HOLE' END AS op FROM messages WHERE optype IN (5, 7, 9) UNION ALL SELECT seq_num, 'UNKNOWN' FROM messages WHERE seq_num % 10 = 0")
def wire_op_names(spark, d):
    sent = messages(spark, d).select("seq_num", "optype")
    odd = sent.where("seq_num % 10 = 0").withColumn("optype", F.lit(42))
    return sent.unionByName(odd).select("seq_num", wire.op_name(F.col("optype")).alias("op"))


@query(f"""WITH {_MESSAGES} SELECT driveid, count(*) AS requests, CAST(sum(datasize) AS BIGINT) AS total_io, CAST(sum(CASE WHEN optype = 7 THEN datasize ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN optype = 9 THEN datasize ELSE 0 END) AS BIGINT) AS punched FROM messages GROUP BY driveid""")
def lun_io(spark, d):
    return space.per_drive(messages(spark, d))


@query(f"WITH {_MESSAGES} SELECT driveid, blk, count(*) AS n FROM (SELECT driveid, unnest(range(driveoffset // 4096, (driveoffset + datasize - 1) // 4096 + 1)) AS blk FROM messages) GROUP BY driveid, blk")
def range_blocks(spark, d):
    return device.touched(messages(spark, d)).groupBy("driveid", "blk").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS drive_id FROM customer WHERE CAST(round(c_acctbal * 10000000) AS BIGINT) BETWEEN 1 AND 68719476736 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def create_lun_check(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("drive_id"), F.round(F.col("c_acctbal") * 10_000_000).cast("long").alias("size"))
    return device.valid_new_luns(new, table(spark, d, "supplier").select(F.col("s_suppkey").alias("drive_id"))).select("drive_id")


# functions


@query("SELECT page_id AS ino, upper(md5(html)) AS whole, CAST(strlen(html) // 1048576 AS BIGINT) AS megabytes FROM pages")
def checksums(spark, d):
    data = F.col("html").cast("binary")
    return table(spark, d, "pages").select(F.col("page_id").alias("ino"), wire.checksum(data).alias("whole"), wire.megabytes(F.octet_length("html")).alias("megabytes"))


@query("""SELECT c_custkey AS slot, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS INTEGER) AS port, c_custkey % 300 < 256 AS is_ip FROM customer""")
def parse_connection(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("slot"), wire.parse_int(F.when(k % 3 == 0, "x").otherwise(k.cast("string"))).alias("port"), wire.is_ipv4(F.concat(F.lit("10.0.0."), (k % 300).cast("string"))).alias("is_ip"))


# inspection


@query(_SUMMARY)
def status_summary(spark, d):
    return space_summary(spark, d)


@query(_BY_VOLUME)
def status_verbose(spark, d):
    return space_by_volume(spark, d)


@query(f"WITH {_INODES} SELECT fsid, ino, path, size, nblocks FROM inodes WHERE ino = 42 OR path = '/vol3/0/3'")
def inode_info(spark, d):
    return inodes(spark, d).where("ino = 42 or path = '/vol3/0/3'")


@query(f"WITH {_BLOCKS} SELECT fbn, dbn FROM blocks WHERE ino = 42")
def show_dbns(spark, d):
    return all_blocks(spark, d).where("ino = 42").select("fbn", "dbn").orderBy("fbn")


@query(f"WITH {_INODES} SELECT fsid, ino, path, size, nblocks FROM inodes WHERE fsid = 5")
def dump_inofile(spark, d):
    return inodes(spark, d).where("fsid = 5")


@query(f"WITH {_INODES} SELECT ino, path, size FROM inodes WHERE fsid = 2 AND starts_with(path, '/vol2/0/') AND strpos(substr(path, 9), '/') = 0")
def dir_listing(spark, d):
    rest = F.substring("path", 9, 1 << 20)
    return inodes(spark, d).where((F.col("fsid") == 2) & F.col("path").startswith("/vol2/0/") & (F.instr(rest, "/") == 0)).select("ino", "path", "size")


@query(f"WITH {_CLOG} SELECT seq, op, ino, fbn, dbn FROM clean")
def stream_clog_current(spark, d):
    """The changelog as a stream of files; the last writer of each block after all of them."""
    from blockloom.streaming import clog as stream

    folder = shared_folder(spark)
    log = dedupe.clog_of_events(stream.source(spark, f"{d}/events[.]parquet", table(spark, d, "events").schema))
    stream.keep_current(log, folder).awaitTermination()
    return stream.current(spark, folder, log.schema).select("seq", "op", "ino", "fbn", "dbn")
