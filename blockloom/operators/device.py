"""Raw devices: byte ranges over a block grid, write logs, holes, requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import wire
from blockloom.operators.dedupe import newest
from blockloom.operators.order import running

GRID = 4096


def messages_of(events: DataFrame) -> DataFrame:
    """Requests in events: driveid, driveoffset, datasize, seq_num, optype."""
    k = F.get_json_object("props", "$.k").cast("long")
    optype = F.when(F.col("event_type") == "error", 9).when(F.col("event_type") == "click", 7).otherwise(5)
    size = ((k % 4 + 1) * 512).cast("int")
    return events.select(optype.cast("int").alias("optype"), F.when(optype == 7, size).otherwise(F.lit(0)).cast("int").alias("payload_size"), F.col("user_id").cast("int").alias("driveid"), (k * GRID).alias("driveoffset"), size.alias("datasize"), F.col("event_id").alias("seq_num"))


def encode(messages: DataFrame) -> DataFrame:
    return messages.select("seq_num", wire.encode_header(**{n: F.col(n) for n, _, _ in wire.HEADER}).alias("header"))


def decode(headers: DataFrame) -> DataFrame:
    return headers.select(*wire.decode_header(F.col("header")))


def mismatched(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests whose reply is missing or has another size."""
    met = requests.join(replies.select("seq_num", F.col("datasize").alias("got")), "seq_num", "left")
    return met.where(F.col("got").isNull() | (F.col("got") != F.col("datasize"))).select("seq_num", "datasize", "got")


def read_range(blocks: DataFrame, offset: int, size: int, block: int) -> DataFrame:
    """ino and the text of [offset, offset + size) of each file. The bounds are literals on the bare column, so they reach a stored table's scan."""
    first, last = offset // block, (offset + size - 1) // block
    hit = blocks.where(F.col("fbn").between(first, last)).groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("fbn", "data"))).alias("parts"))
    return hit.select("ino", F.substring(F.array_join(F.col("parts.data"), ""), offset - first * block + 1, size).alias("data"))


def image(clog: DataFrame) -> DataFrame:
    """The current block of each place; a hole reads as dbn 0."""
    return newest(clog, "ino", "fbn").select("ino", "fbn", F.when(F.col("op") == "PUNCH", 0).otherwise(F.col("dbn")).alias("dbn"))


def scrubbed(data: Column) -> Column:
    """What a write of this block becomes when zero blocks are found: a hole, or a write."""
    return F.when(wire.all_zero(data.cast("binary")), "PUNCH").otherwise("WRITE")


def touched(ranges: DataFrame, block: int = GRID) -> DataFrame:
    """The blocks that each range (driveid, driveoffset, datasize) touches: an equi-join key instead of an overlap test."""
    span = F.sequence(F.floor(F.col("driveoffset") / block), F.floor((F.col("driveoffset") + F.col("datasize") - 1) / block))
    return ranges.where("datasize > 0").select("seq_num", "driveid", F.explode(span).alias("blk"))


def valid_new_luns(candidates: DataFrame, luns: DataFrame, most: int = 64 << 30) -> DataFrame:
    """New LUNs with an id not taken (of candidates with one id: none), and a size from 1 byte to 64 GB."""
    once = candidates.groupBy("drive_id").agg(F.count("*").alias("c")).where("c = 1")
    return candidates.where(F.col("size").between(1, most)).join(luns.select("drive_id"), "drive_id", "left_anti").join(once, "drive_id", "left_semi")


def stamped(messages: DataFrame, *order: str) -> DataFrame:
    """The messages with seq_num, counted up from 0 in the order of the columns, and header, which is zero for operations that no client sends."""
    made = running(messages.drop("seq_num"), list(order), name="seq_num")
    sent = F.coalesce(wire.op_name(F.col("optype")), F.lit("")).isin(*wire.CLIENT_OPS)
    zero = F.unhex(F.lit("00" * wire.HEADER_BYTES))
    return made.withColumn("header", F.when(sent, wire.encode_header(**{n: F.col(n) for n, _, _ in wire.HEADER})).otherwise(zero))


def out_of_order(messages: DataFrame) -> DataFrame:
    """Messages of a drive that don't come after the one before them (arrived in the order of ts, at), with that one's number."""
    own = Window.partitionBy("driveid").orderBy("ts", "at")
    return messages.withColumn("prior", F.lag("seq_num").over(own)).where("prior >= seq_num")


def pieces(writes: DataFrame, block: int = GRID) -> DataFrame:
    """The writes (drive, seq, op, offset, size, payload) cut at the grid: drive, blk, seq, at (in the block) and data.

    A hole is zero bytes, whatever its payload; a payload shorter than size is followed by zeros.
    """
    ends = F.col("offset") + F.col("size")
    span = F.sequence((F.floor(F.col("offset") / block)).cast("long"), F.floor((ends - 1) / block).cast("long"))
    cut = writes.where("size > 0").withColumn("blk", F.explode(span))
    low, high = F.greatest(F.col("blk") * block, F.col("offset")), F.least((F.col("blk") + 1) * block, ends)
    part = F.when(F.col("op") == "PUNCH", F.lit(b"")).otherwise(F.coalesce(F.substring("payload", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")), F.lit(b"")))
    return cut.select("drive", "blk", "seq", (low - F.col("blk") * block).cast("int").alias("at"), (high - low).cast("int").alias("n"), part.alias("part")).select(
        "drive", "blk", "seq", "at", "n", F.unhex(F.rpad(F.hex("part"), 2 * F.col("n"), F.lit("0"))).alias("data")
    )


def block_image(writes: DataFrame, block: int = GRID) -> DataFrame:
    """drive, blk and data of every block that was written or punched, byte by byte the last write's.

    Of writes at one place of a block only the last one counts, and nothing before the last one that covers the whole
    block: so what is laid over each other is bounded by the block's size, however often it was written.
    """
    last = pieces(writes, block).groupBy("drive", "blk", "at", "n").agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("data"))
    whole = F.max(F.when(F.col("n") == block, F.col("seq"))).over(Window.partitionBy("drive", "blk"))
    live = last.withColumn("whole", whole).where("whole is null or seq >= whole")
    parts = live.groupBy("drive", "blk").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "n", "data"))).alias("parts"))
    laid = f"aggregate(parts, unhex(repeat('00', {block})), (a, x) -> overlay(a placing x.data from x.at + 1 for x.n))"
    return parts.select("drive", "blk", F.expr(laid).alias("data"))


def read_bytes(requests: DataFrame, image_: DataFrame, block: int = GRID) -> DataFrame:
    """req, drive, data of each request (req, drive, offset, size): an equi-join with the blocks it touches; what was never written is zero."""
    ends = F.col("offset") + F.col("size")
    span = F.sequence(F.floor(F.col("offset") / block).cast("long"), F.floor((ends - 1) / block).cast("long"))
    asked = requests.where("size > 0").select("req", "drive", "offset", "size", F.explode(span).alias("blk"))
    low, high = F.greatest(F.col("blk") * block, F.col("offset")), F.least((F.col("blk") + 1) * block, ends)
    got = asked.join(image_, ["drive", "blk"], "left").select(
        "req", "drive", "blk", F.substring(F.coalesce("data", F.unhex(F.lit("00" * block))), (low - F.col("blk") * block + 1).cast("int"), (high - low).cast("int")).alias("data")
    )
    parts = got.groupBy("req", "drive").agg(F.array_sort(F.collect_list(F.struct("blk", "data"))).alias("parts"))
    return parts.select("req", "drive", F.expr("aggregate(parts, unhex(''), (a, x) -> concat(a, x.data))").alias("data"))


def read_checked(requests: DataFrame, image_: DataFrame, sizes: DataFrame, block: int = GRID) -> DataFrame:
    """read_bytes() with the MD5 of what was read; fails where a request passes the end of its drive (drive, drive_size) or there is no such drive."""
    known = requests.join(sizes, "drive", "left")
    inside = (F.col("drive_size").isNotNull()) & (F.col("offset") >= 0) & (F.col("offset") + F.col("size") <= F.col("drive_size"))
    sure = known.withColumn("size", F.when(inside, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("read outside the drive: request "), F.col("req").cast("string"))).cast("int")))
    return read_bytes(sure, image_, block).withColumn("md5", wire.checksum(F.col("data")))
