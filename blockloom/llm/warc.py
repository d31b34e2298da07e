"""Operator 4: WARC archives, written and read in parallel.

Writing: each task writes archives of gzip members, one record a member, through
pyarrow's file systems (local, HDFS, object stores), first under another name
and then moved into place, so a task that runs again replaces its own archive.
Equal payloads are found by their SHA-1 before writing: the row with the largest
page_id is the response, the others are revisit records without a payload.

Reading is splittable: archives are cut into byte ranges; each task scans its range
for the gzip magic, takes a place for a member only if what it decodes to begins
with a WARC version line, and owns the members that start inside its range (reading
on past the end for the last of them). From its first member on, each next one must
begin where the last ended, also the one after the range: what can't be read is an
error, never left out. A member may hold any number of records; headers may be of
any length, with names in any case, spaces or none after the colon, and folded
lines; payloads are decoded in pieces. round_trip() compares the records read with
the records written, archive by archive.

Defined results: null or empty html is an empty payload; a null page_id stays
null (and is the response only if no equal payload has an id); equal rows with
equal ids are written once each, all as responses; an empty table gives no
archive and no rows; other columns don't matter. The payload of a record is its
block, and for HTTP messages what follows the message's header.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, rows_of, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once.
STEP = 1 << 20
END = b"\r\n\r\n"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, at long"

MANIFEST = "archive string, bytes long, records long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the page whose record holds the same payload of at least least_bytes.

    One row for each payload comes from map-side maxima; it meets the pages in a
    join that Spark may split where many pages share a payload.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    first = page.where(large).groupBy("digest").agg(F.max("page_id").alias("first"))
    return page.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns archive, bytes and records of each, from a table in the folder itself."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _open(folder)
        task = TaskContext.get()
        name, records, out = f"part-{task.partitionId():06d}.warc.gz", 0, None
        draft = f"{base}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in rows_of(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(draft)
                out.write(record(page_id, url, html.encode("utf-8", "replace"), refers_to))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["archive", "bytes", "records"])

    made = plan(pages, least_bytes).mapInArrow(run, MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Tail:
    """Bytes of a file from a place on, read when they are wanted."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buf, self.used = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        part = self.file.read(STEP)
        self.buf, self.used = self.buf[self.used :] + part, 0
        return bool(part)

    def drop(self, n: int) -> None:
        self.used += n
        self.at += n

    def back(self, at: int) -> None:
        self.at, self.buf, self.used = at, b"", 0
        self.file.seek(at)

    def find(self, what: bytes) -> bool:
        """Stands at the next place of what; False at the end of the file."""
        while True:
            found = self.buf.find(what, self.used)
            if found >= 0:
                self.drop(found - self.used)
                return True
            self.drop(max(0, len(self.buf) - self.used - len(what) + 1))
            if not self.more():
                return False


class Member:
    """The decoded bytes of the gzip member that begins where a tail stands, in pieces of STEP at most."""

    def __init__(self, tail: Tail):
        self.tail, self.unpack, self.buf = tail, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decodes another piece; False at the member's end. A broken or cut member raises zlib.error."""
        while not self.unpack.eof:
            tail = self.tail
            if tail.used == len(tail.buf) and not tail.more():
                raise zlib.error("the file ends inside a member")
            piece = tail.buf[tail.used :] if tail.used else tail.buf
            data = self.unpack.decompress(piece, STEP)
            tail.drop(len(piece) - len(self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail))
            if data:
                self.buf += data
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        """The bytes before end, which is passed; None if it doesn't come."""
        at, parts = 0, bytearray()
        while True:
            found = self.buf.find(end)
            if found >= 0:
                out = bytes(parts) + self.buf[:found]
                self.buf = self.buf[found + len(end) :]
                return out
            keep = len(end) - 1
            at = max(0, len(self.buf) - keep)
            parts += self.buf[:at]
            self.buf = self.buf[at:]
            if not self.more():
                return None

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces; fewer if the member ends."""
        while n:
            if not self.buf and not self.more():
                return
            part, self.buf = self.buf[:n], self.buf[n:]
            n -= len(part)
            yield part

    def blank(self) -> bool:
        """Passes line ends; whether the member ends here."""
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            if self.buf or not self.more():
                return not self.buf


def fields_of(header: bytes) -> dict[str, str]:
    """Values by names in lower case, from the lines after the version line; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records_of(member: Member, at: int) -> Iterator[dict]:
    """Every record of a member, its payload digested in pieces."""
    while not member.blank():
        while len(member.buf) < 5 and member.more():
            pass
        if not member.buf.startswith(b"WARC/"):
            raise ValueError(f"member at {at}: no WARC version where a record should begin")
        header = member.until(END)
        if header is None:
            raise ValueError(f"member at {at}: a header without an end")
        fields = fields_of(header)
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"member at {at}: a record without Content-Length")
        left, sha, size = int(fields["content-length"]), hashlib.sha1(), 0
        http = b"" if fields.get("content-type", "").lower().startswith("application/http") else None
        for part in member.take(left):
            left -= len(part)
            if http is not None:  # still in the HTTP header, of which the last bytes are enough
                seen, _, part = (http + part).partition(END) if END in http + part else (http + part, b"", None)
                http = seen[-len(END) + 1 :] if part is None else None
                part = part or b""
            sha.update(part)
            size += len(part)
        if left:
            raise ValueError(f"member at {at}: a record of which {left} bytes are missing")
        yield fields | {"at": at, "sha1": base64.b32encode(sha.digest()).decode(), "size": size}


def _id(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def begins(tail: Tail) -> Member | None:
    """The member that begins where the tail stands, if it decodes to a WARC version; else the tail stands where it stood."""
    at, member = tail.at, Member(tail)
    try:
        while len(member.buf) < 5 and member.more():
            pass
    except zlib.error:
        pass
    if member.buf.startswith(b"WARC/"):
        return member
    tail.back(at)
    return None


def scan(file, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in [start, end)."""
    tail, sure = Tail(file, start), start == 0
    while tail.at < end:
        if not sure and (not tail.find(MAGIC) or tail.at >= end):
            return
        at = tail.at
        member = begins(tail)
        if member is None:
            if sure:
                if tail.used == len(tail.buf) and not tail.more():
                    return  # the file's end
                raise ValueError(f"no WARC member at {at}, where one should begin")
            tail.drop(1)
            continue
        try:
            yield from records_of(member, at)
            while member.more():
                pass
        except zlib.error as wrong:
            raise ValueError(f"the member at {at} can't be decoded") from wrong
        sure = True
    # the next range finds its first member by searching; that there is one where this one ended is known only here
    if sure and (tail.used < len(tail.buf) or tail.more()) and begins(tail) is None:
        raise ValueError(f"no WARC member at {tail.at}, where one should begin")


def read(spark: SparkSession, folder: str, manifest: DataFrame, split: int = 8 << 20) -> DataFrame:
    """Every record of the archives; ranges of split bytes are dealt out to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                with fs.open_input_file(posixpath.join(base, name)) as file:
                    for r in scan(file, start, end):
                        kind, said = r.get("warc-type"), r.get("warc-payload-digest", "").removeprefix("sha1:")
                        length = int(r.get("x-payload-length", r["size"]))
                        if kind == "response" and ((said or r["sha1"]) != r["sha1"] or length != r["size"]):
                            raise ValueError(f"{name} at {r['at']}: the payload isn't the one whose digest is recorded")
                        rows.append((_id(r.get("warc-record-id")), length, said or r["sha1"], kind, _id(r.get("warc-refers-to")), r.get("warc-target-uri"), name, r["at"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "at"],
                )

    ranges = manifest.where("bytes > 0").select(
        "archive", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(split)}L)")).alias("start")
    ).select("archive", "start", F.least(F.col("start") + split, "bytes").alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks).mapInArrow(run, RECORDS)


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records, written to the shared folder; fails if any archive gave more or fewer than were written into it."""
    found = materialise(records)
    counts = found.groupBy("archive").agg(F.count("*").alias("n"))
    wrong = manifest.join(counts, "archive", "full_outer").where(~F.col("records").eqNullSafe(F.col("n"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].archive}: {wrong[0].records} records written, {wrong[0].n} read")
    return found


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages into a new shared folder and reads the records back, all of them."""
    folder = shared_dir(pages.sparkSession)
    manifest = write(pages, folder, least_bytes)
    return complete(read(pages.sparkSession, folder, manifest), manifest)
