"""The engine on hand-made rows: what the tables of the queries don't hold."""

import hashlib
import threading
import time

import pytest
from pyspark.sql import functions as F

from blockloom.functions import wire
from blockloom.operators import backup, blocks, dedupe, device, jobs, order, space, volumes
from blockloom.plans import commands, registry
from blockloom.sources import container
from blockloom.sources.shared import shared_folder
from blockloom.sources.store import Store
from blockloom.streaming import clog as stream
from tests.conftest import SF


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


FILES = "fsid int, ino long, text string"


# blocks


def test_files_of_documents_without_a_volume(spark):
    docs = frame(spark, [(1, "a", "src3"), (2, "b", "elsewhere"), (3, None, None)], "doc_id long, text string, source string")
    assert rows(blocks.files_of(docs), "fsid", "ino") == [(-1, 2), (-1, 3), (3, 1)]


def test_blocks_of_odd_files(spark):
    text = "x" * 256 + "y" * 3
    files = frame(spark, [(1, 1, ""), (1, 2, None), (1, 3, text), (2, 3, "z"), (1, 1 << 60, "w"), (1, -5, "v")], FILES)
    got = rows(blocks.blocks(files), "fsid", "ino", "fbn", "dbn", "len")
    assert got == [(1, -5, 0, 1, 1), (1, 3, 0, 2, 256), (1, 3, 1, 3, 3), (1, 1 << 60, 0, 5, 1), (2, 3, 0, 4, 1)]
    assert blocks.blocks(files.limit(0)).count() == 0
    with pytest.raises(ValueError, match="inode 3"):
        blocks.blocks(files.unionByName(frame(spark, [(1, 3, "other")], FILES)))


def test_truncate_to_part_of_a_block(spark):
    files = frame(spark, [(1, 1, "a" * 1000), (1, 2, "b" * 600)], FILES)
    sizes = frame(spark, [(1, 300), (2, 0)], "ino long, new_size long")
    assert rows(blocks.truncate_freed(blocks.blocks(files), sizes), "ino", "fbn") == [(1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]


def test_positions_without_one_sort(spark):
    df = frame(spark, [(i * 7919 % 1000, i) for i in range(1000)], "k long, i long")
    assert [r.k for r in sorted(order.placed(df, "k").collect(), key=lambda r: r.pos)] == list(range(1000))
    assert order.arranged(df, "i").columns == ["i", "k"] and order.placed(df.limit(0), "k").count() == 0


def test_paths_and_cycles(spark):
    tree = frame(spark, [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], "ino long, parent long, name string")
    assert rows(blocks.paths(tree), "ino", "path") == [(1, "/a"), (2, "/a/b"), (3, "/a/b/c"), (4, "/d")]


# dedupe


def entry(seq, op, ino, fbn, dbn, ts=0, fsid=1, fp="f"):
    return (seq, ts, op, fsid, ino, fbn, dbn, fp)


LOG = "seq long, ts int, op string, fsid int, ino long, fbn long, dbn long, fp string"


def test_newest_by_time_then_sequence(spark):
    log = frame(spark, [entry(1, "WRITE", 1, 0, 10), entry(2, "PUNCH", 1, 0, 0), entry(3, "WRITE", 2, 0, 11, ts=5), entry(9, "WRITE", 2, 0, 12, ts=4)], LOG)
    assert rows(dedupe.newest(log, "ino", "fbn"), "seq") == [(2,), (3,)]
    assert rows(device.image(log), "ino", "fbn", "dbn") == [(1, 0, 0), (2, 0, 11)]
    assert rows(dedupe.overwritten(log, "ino", "fbn"), "seq", "overwritten") == [(1, False), (2, True), (3, True), (9, False)]


def small_store(spark):
    """Three files of which two blocks are equal; one stands in the database, with a freed block's fingerprint beside it."""
    files = frame(spark, [(1, 1, "a" * 256 + "b" * 256), (1, 2, "a" * 256 + "c" * 10), (2, 3, "b" * 256), (2, 4, "a" * 256)], FILES)
    every = blocks.blocks(files)
    log = every.where("ino > 1").select(F.col("dbn").alias("seq"), F.lit(0).alias("ts"), F.lit("WRITE").alias("op"), "fsid", "ino", "fbn", "dbn", "fp")
    log = log.unionByName(frame(spark, [entry(0, "WRITE", 3, 0, 77, fsid=2), entry(0, "PUNCH", 9, 0, 5)], LOG))
    c = hashlib.md5(b"c" * 10).hexdigest()
    known = dedupe.fpdb(every.where("ino = 1")).unionByName(frame(spark, [(c, 999)], "fp string, dbn long"))
    store = Store(spark, shared_folder(spark))
    return every, dedupe.opened(store, every.drop("data"), log, known, frame(spark, [(999,)], "dbn long")), files


def test_a_run_over_a_store(spark):
    every, store, files = small_store(spark)
    assert store.versions() == [1] and dedupe.run(store) == 3
    after = store.read("blockmap")
    assert rows(after, "ino", "fbn", "dbn") == [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 4), (3, 0, 2), (4, 0, 1)]
    assert rows(store.read("script"), "ino", "old_dbn", "new_dbn") == [(2, 3, 1), (3, 5, 2), (4, 6, 1)]
    assert rows(store.read("freed")) == [(3,), (5,), (6,)] and rows(store.read("refcounts"), "dbn", "n") == [(1, 3), (2, 2), (4, 1)]
    # the freed block's entry went, the block that has its content came
    base = dict(rows(store.read("fpdb"), "fp", "dbn"))
    assert base[hashlib.md5(b"c" * 10).hexdigest()] == 4 and len(base) == 3
    # invariants: sums of references, contents, an empty second script, one fingerprint for each block
    assert store.read("refcounts").agg(F.sum("n")).first()[0] == after.count()
    data = every.select("dbn", "data")
    whole = dict(rows(blocks.reassemble(after.select("ino", "fbn", "dbn").join(data, "dbn")), "ino", "fp"))
    assert whole == {r.ino: hashlib.md5(r.text.encode()).hexdigest() for r in files.collect()}
    assert dedupe.run(store) == 0 and after.groupBy("dbn").agg(F.countDistinct("fp").alias("n")).where("n > 1").count() == 0
    # old versions stay readable until they are dropped
    assert rows(store.read("blockmap", 1), "dbn") == [(i,) for i in range(1, 7)]
    assert store.drop_before(3) > 0 and store.read("blockmap").count() == 6 and store.read("clog").count() == 6


def test_a_run_that_leaves_shared_blocks_out(spark):
    every, store, _ = small_store(spark)
    dedupe.run(store)
    moved = store.read("blockmap")
    store.publish(blockmap=moved, refcounts=dedupe.refcount(moved), clog=moved.select(F.col("dbn").alias("seq"), F.lit(1).alias("ts"), F.lit("WRITE").alias("op"), "fsid", "ino", "fbn", "dbn", "fp"))
    store.publish(fpdb=frame(spark, [(f, 500) for (f,) in rows(moved, "fp")], "fp string, dbn long").distinct())
    assert dedupe.run(store, ignore_shared_=True) == 1 and rows(store.read("script"), "ino", "fbn") == [(2, 1)]


def test_tables_are_written_in_order(spark):
    _, store, _ = small_store(spark)
    dedupe.run(store)
    for name, keys in (("fpdb", ["dbn"]), ("script", ["fsid", "ino", "fbn"]), ("refcounts", ["dbn"])):
        got = [tuple(r[k] for k in keys) for r in store.read(name).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
        assert len(got) > 1 and got == sorted(got)


def test_an_unpublished_version_doesnt_exist(spark):
    _, store, _ = small_store(spark)
    store.read("blockmap").limit(1).write.parquet(f"{store.folder}/v=00000002/blockmap")  # what an ended job left
    assert store.versions() == [1] and store.read("blockmap").count() == 6
    assert dedupe.run(store) == 3 and store.read("blockmap").count() == 6
    with pytest.raises(KeyError):
        store.read("nothing")


def test_bounds_reach_the_scan(spark):
    for name, wanted in (("show_dbns", "EqualTo(ino,42)"), ("range_read", "GreaterThanOrEqual(fbn,2)"), ("auto_delete", "GreaterThan(o_orderdate")):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan and "Window" not in plan, name
    plan = registry.QUERIES["show_dbns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan.split("ReadSchema")[1]


# volumes

VOLUMES = "fsid int, name string, backing_fsid int"


def test_a_clone_of_a_clone_stays_as_it_was(spark):
    every = volumes.snapshot(frame(spark, [(1, "base", 0)], VOLUMES), 1, 2, "child", 10)
    every = volumes.snapshot(every, 2, 3, "grandchild", 20)
    log = [(1, 1, 7, 0, 100), (2, 1, 7, 1, 101)]
    schema = "seq long, fsid int, ino long, fbn long, dbn long"
    read = lambda more: {f: sorted((r.ino, r.fbn, r.dbn) for r in volumes.resolve(frame(spark, log + more, schema), every).collect() if r.fsid == f) for f in (1, 2, 3)}
    first = read([])
    assert first[1] == first[2] == first[3] == [(7, 0, 100), (7, 1, 101)]
    later = read([(11, 1, 7, 0, 110), (15, 2, 7, 1, 0), (21, 2, 7, 0, 121), (22, 3, 8, 0, 122)])
    assert later == {1: [(7, 0, 110), (7, 1, 101)], 2: [(7, 0, 121), (7, 1, 0)], 3: [(7, 0, 100), (7, 1, 0), (8, 0, 122)]}
    only = volumes.resolve(frame(spark, log, schema), every, frame(spark, [(3,)], "fsid int"))
    assert {r.fsid for r in only.collect()} == {3}
    seen = volumes.open_volume(frame(spark, log, schema), every, 3, "third")
    assert spark.table("third").count() == seen.count() == 2 and volumes.close_volume(every, "third") and not volumes.close_volume(every, "third")


def test_long_chains_and_cycles(spark, monkeypatch):
    chain = frame(spark, [(i, f"v{i}", i - 1) for i in range(1, 71)], VOLUMES)
    assert rows(volumes.ancestry(chain, frame(spark, [(70,)], "fsid int")), "ancestor", "depth") == [(70 - i, i) for i in range(69, -1, -1)]
    monkeypatch.setattr(volumes, "ROUNDS", 4)
    with pytest.raises(ValueError, match="cycle"):
        volumes.ancestry(frame(spark, [(1, "a", 2), (2, "b", 1)], VOLUMES))


def test_names_and_ids_are_taken_once(spark):
    there = frame(spark, [(1, "base", 0)], VOLUMES)
    new = frame(spark, [("x", 1, None), ("x", 1, None), ("base", 1, None), ("y", 9, None), ("z", 1, "c" * 1025), ("w", 1, "c" * 1024), ("", 1, None), (None, 1, None)], "name string, backing_fsid int, comments string")
    assert rows(volumes.valid_new(new, there), "name") == [("w",)]
    luns = frame(spark, [(1, 10), (1, 20), (2, 0), (3, 64 << 30), (4, (64 << 30) + 1), (5, 5)], "drive_id long, size long")
    assert rows(device.valid_new_luns(luns, frame(spark, [(5,)], "drive_id long")), "drive_id") == [(3,)]


def test_files_and_folders(spark):
    files = frame(spark, [(1, 1, "/a/b"), (1, 2, "/a/bc"), (1, 3, "/a/b/c"), (1, 4, None)], "fsid int, ino long, path string")
    assert rows(volumes.rename(files.where("ino < 4"), "/a/b", "x"), "path") == [("/a/bc",), ("/a/x",), ("/a/x/c",)]
    assert rows(volumes.remove(files, "/a/b"), "ino") == [(2,), (4,)]
    one = volumes.clone_directory(files.where("ino < 4"), "/a/", 1, "/d/")
    assert rows(one, "fsid", "src_ino", "path") == [(1, 1, "/d/b"), (1, 2, "/d/bc"), (1, 3, "/d/b/c")]
    same = volumes.clone_files(frame(spark, [(1, 9, 1, 1)], "fsid int, ino long, src_fsid int, src_ino long"), frame(spark, [(1, 1, 0, 5)], "fsid int, ino long, fbn long, dbn long"))
    assert rows(same) == [(1, 9, 0, 5)]


# space and backup


def test_a_total_is_told_from_a_volume(spark):
    cut = frame(spark, [(None, "f", 3), (1, "f", 3), (1, "g", 2)], "fsid int, fp string, len long")
    got = {(r.fsid, r.is_total): (r.logical, r.physical) for r in space.by_volume(cut).collect()}
    assert got == {(None, 0): (3, 3), (1, 0): (5, 5), (None, 1): (8, 5)}


def test_null_fingerprints(spark):
    last = frame(spark, [("a", None), ("b", "x"), ("c", None), ("e", "q")], "path string, fp string")
    now = frame(spark, [("a", None), ("b", None), ("d", None), ("e", "q")], "path string, fp string")
    assert rows(backup.compare(last, now)) == [("a", "same"), ("b", "changed"), ("c", "gone"), ("d", "new"), ("e", "same")]
    old, new = frame(spark, [(1, 0, None)], "ino long, fbn long, fp string"), frame(spark, [(1, 0, None), (1, 1, "x")], "ino long, fbn long, fp string")
    assert rows(backup.delta(old, new), "fbn") == [(0,), (1,)]


def test_jobs_end_and_can_be_aborted(spark):
    assert jobs.Job(spark, "quick", lambda: spark.range(5).count()).wait() == 5
    slow = jobs.Job(spark, "slow", lambda: spark.range(1 << 40, numPartitions=8).selectExpr("sum(id % 7)").collect())
    time.sleep(1)
    assert slow.state() == "running" and slow.abort() == "aborted"
    broken = jobs.Job(spark, "broken", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.wait()
    assert broken.state() == "failed" and threading.active_count() > 0


def test_containers():
    assert container.Container("/d", 8, "TB").bytes() == 8 << 40
    for wrong in (("", 1, "GB"), ("/d", 0, "GB"), ("/d", 9, "TB"), ("/d", 1, "MB")):
        with pytest.raises(ValueError):
            container.Container(*wrong)


# bytes


def test_integers_of_either_sign(spark):
    values = [0, 1, -1, -2, 258, (1 << 31) - 1, -(1 << 31)]
    df = frame(spark, [(v, v * (1 << 31) - 5) for v in values], "i int, l long")
    got = df.select("i", "l", wire.set_int(F.col("i")).alias("a"), wire.set_long(F.col("l")).alias("b")).select("*", wire.get_int(F.col("a"), 0).alias("j"), wire.get_long(F.col("b"), 0).alias("m")).collect()
    for r in got:
        assert bytes(r.a) == r.i.to_bytes(4, "little", signed=True) and bytes(r.b) == r.l.to_bytes(8, "little", signed=True) and (r.j, r.m) == (r.i, r.l)


def test_checksums_zeros_and_assertions(spark):
    one = frame(spark, [(bytearray(b"\0abc\0"), bytearray(3))], "x binary, z binary")
    r = one.select(wire.checksum(F.col("x"), 1, 3).alias("c"), wire.all_zero(F.col("x")).alias("a"), wire.all_zero(F.col("z")).alias("b"), wire.megabytes(F.lit((5 << 20) - 1)).alias("m")).first()
    assert r.c == hashlib.md5(b"abc").hexdigest().upper() and not r.a and r.b and r.m == 4
    assert one.select(wire.require(F.lit(True), "no")).count() == 1
    with pytest.raises(Exception, match="not so"):
        one.select(wire.require(F.lit(False), "not so").alias("x")).collect()


WRITES = "drive int, seq long, op string, offset long, size int, payload binary"


def test_writes_are_laid_over_each_other(spark):
    made = [(1, 1, "WRITE", 3, 10, bytearray(b"abcdefghij")), (1, 2, "PUNCH", 5, 4, None), (1, 3, "WRITE", 7, 3, bytearray(b"XYZ")), (1, 4, "WRITE", 30, 4, bytearray(b"q")), (2, 5, "WRITE", 0, 8, bytearray(b"12345678")), (1, 0, "WRITE", 0, 16, bytearray(b"old old old old!"))]
    made += [(3, 10 + i, "WRITE", 8, 8, bytearray(b"%08d" % i)) for i in range(200)] + [(3, 500, "WRITE", 9, 2, bytearray(b"zz"))]
    image = device.block_image(frame(spark, made, WRITES), 8)
    drive = bytearray(40)
    for _, _, op, at, n, data in sorted((w for w in made if w[0] == 1), key=lambda w: w[1]):
        drive[at : at + n] = bytes(n) if op == "PUNCH" else bytes(data).ljust(n, b"\0")
    asked = frame(spark, [(1, 1, 0, 40), (2, 1, 4, 9), (3, 1, 20, 5), (4, 2, 7, 3), (5, 9, 0, 4), (6, 3, 8, 8), (7, 1, 3, 0)], "req long, drive int, offset long, size int")
    got = {r.req: bytes(r.data) for r in device.read_bytes(asked, image, 8).collect()}
    assert got == {1: bytes(drive), 2: bytes(drive[4:13]), 3: bytes(5), 4: b"8\0\0", 5: bytes(4), 6: b"0zz00199", }
    sizes = frame(spark, [(1, 40), (2, 10)], "drive int, drive_size long")
    fine = device.read_checked(asked.where("req in (1, 4)"), image, sizes, 8).collect()
    assert {r.req: r.md5 for r in fine} == {1: hashlib.md5(bytes(drive)).hexdigest().upper(), 4: hashlib.md5(b"8\0\0").hexdigest().upper()}
    with pytest.raises(Exception, match="outside the drive"):
        device.read_checked(asked.where("req = 5"), image, sizes, 8).collect()


def test_stamps_and_order(spark):
    sent = frame(spark, [(5, 1, 10), (6, 1, 11), (9, 2, 12), (42, 1, 13)], "optype int, driveid int, ts long")
    sent = sent.select("*", F.lit(0).alias("payload_size"), F.lit(0).cast("long").alias("driveoffset"), F.lit(8).alias("datasize"))
    got = {r.ts: r for r in device.stamped(sent, "ts").collect()}
    assert [got[t].seq_num for t in (10, 11, 12, 13)] == [0, 1, 2, 3]
    assert any(got[10].header) and any(got[12].header) and not any(got[11].header) and not any(got[13].header)
    late = frame(spark, [(1, 1, 1, 5), (1, 2, 2, 4), (1, 3, 3, 6), (2, 1, 4, 1)], "driveid int, ts long, at long, seq_num long")
    assert rows(device.out_of_order(late), "seq_num", "prior") == [(4, 5)]


def test_block_device_source(spark, tmp_path):
    from blockloom.sources.device import BlockDevice

    spark.dataSource.register(BlockDevice)
    image = str(tmp_path / "image")
    made = frame(spark, [(i, bytearray(b"%d" % i * 3)) for i in range(20)] + [(30, None)], "blk long, data binary")
    made.write.format("blockdevice").option("path", image).option("blocksize", "16").mode("append").save()
    read = lambda **o: {r.blk: bytes(r.data).rstrip(b"\0") for r in spark.read.format("blockdevice").options(path=image, blocksize="16", range="4", **o).load().collect()}
    assert read() == {i: b"%d" % i * 3 for i in range(20)} and set(read(first="5", last="7")) == {5, 6, 7}
    frame(spark, [(6, None), (7, bytearray(b"new"))], "blk long, data binary").write.format("blockdevice").option("path", image).option("blocksize", "16").mode("append").save()
    assert 6 not in read() and read()[7] == b"new"


# stream


def test_stream_in_batches(spark, tmp_path):
    schema = "seq long, ts long, op string, ino long, fbn long, dbn long"
    made = [[(1, 1, "WRITE", 1, 0, 10), (2, 1, "WRITE", 2, 0, 11)], [(3, 2, "WRITE", 1, 0, 12)], [(4, 2, "PUNCH", 1, 0, 0), (0, 0, "WRITE", 2, 0, 9), (5, 3, "WRITE", 3, 1, 13)]]
    for batch in made:
        frame(spark, batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    folder = "file://" + str(tmp_path / "state")
    log = stream.source(spark, str(tmp_path / "in"), frame(spark, [], schema).schema, files=1)
    for _ in range(2):  # started again, it finds nothing new
        stream.keep_current(log, folder).awaitTermination()
        assert rows(stream.current(spark, folder, log.schema), "seq") == [(2,), (4,), (5,)]
    frame(spark, [(6, 9, "WRITE", 2, 0, 20)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream.keep_current(log, folder).awaitTermination()
    assert rows(stream.current(spark, folder, log.schema), "seq") == [(4,), (5,), (6,)]


# commands


def test_grammar():
    assert commands.parse("fs showdbns -inode 42") == ("fs showdbns", {"inode": 42})
    assert commands.parse("drive clone -backingdrivename 'my volume'") == ("drive clone", {"backingdrivename": "my volume"})
    for wrong in ("fs showdbns", "fs showdbns -inode 1 -path x", "fs status -type all", "fs nothing", "fs status -kind summary", "fs dumpinofile -fsid x"):
        with pytest.raises(ValueError):
            commands.parse(wrong)


def test_commands(spark):
    files = frame(spark, [(1, 1, "a" * 300), (1, 2, "a" * 300), (2, 3, "b")], FILES)
    run = commands.loaded(Store(spark, shared_folder(spark)), files, frame(spark, [(1, "one", 0), (2, "two", 1)], VOLUMES))
    assert run("fs status").first().logical == 601 and run("fs status -type verbose").count() == 3
    assert rows(run("fs showdbns -path /vol1/0/2"), "fbn", "dbn") == rows(run("fs showdbns -inode 2"), "fbn", "dbn") == [(0, 3), (1, 4)]
    assert run("fs inodeinfo -ino 3").first().size == 1 and run("fs dumpinofile -fsid 1").count() == 2
    new = run("drive clone -backingdrivename one")
    assert new == 3 and run(f"drive mount -fsid {new}") == "volume_3" and spark.table("volume_3").count() == 4 and run("drive unmount -fsid 3")
    assert not run("drive delete -drivename one") and run("drive delete -fsid 3")
    with pytest.raises(ValueError):
        run("drive mount -drivename three")
    run("tool file -op rename -source /vol1/0 -dest zero")
    run("tool file -op clone -source /vol1/zero/ -dest /copy/ -fsid 2")
    run("tool file -op delete -source /vol2")
    run("tool file -op newfolder -dest /vol1/empty")
    assert rows(run.store.read("inodes"), "fsid", "path") == [(1, "/vol1/zero/1"), (1, "/vol1/zero/2"), (2, "/copy/1"), (2, "/copy/2")]
    assert rows(run.store.read("folders")) == [("/vol1/empty",)]
    every = run.store.read("blockmap")
    run.store.publish(clog=registry.log_of(every), fpdb=every.select("fp", "dbn").limit(0), deletelog=every.select("dbn").limit(0), refcounts=dedupe.refcount(every))
    assert run("dedupe start -ignoreshared false") == 2 and run("fs showdbns -inode 2").first().dbn == 1
