"""A raw image file as a Spark data source: blocks are read in parallel ranges, and written in place.

    spark.dataSource.register(BlockDevice)
    spark.read.format("blockdevice").option("path", image).option("first", 2).option("last", 9).load()
    df.write.format("blockdevice").option("path", image).mode("append").save()

Rows are blk and data. A block of zeros is a hole: it isn't returned. A write of a null block punches one. The path must
be one that all executors open (a shared file system). A repeated task writes the same bytes to the same places.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SIZE = 4096
#: Blocks of one read task.
RANGE = 4096


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.per = options["path"], int(options.get("blocksize", SIZE)), int(options.get("range", RANGE))
        end = -(-os.path.getsize(self.path) // self.size) - 1
        self.first, self.last = max(0, int(options.get("first", 0))), min(end, int(options.get("last", end)))

    def partitions(self) -> list[Blocks]:
        return [Blocks(at, min(at + self.per - 1, self.last)) for at in range(self.first, self.last + 1, self.per)] or [Blocks(0, -1)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        zero = bytes(self.size)
        with open(self.path, "rb") as file:
            file.seek(partition.first * self.size)
            for blk in range(partition.first, partition.last + 1):
                data = file.read(self.size).ljust(self.size, b"\0")
                if data != zero:
                    yield blk, data


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("blocksize", SIZE))
        if not os.path.exists(self.path):
            open(self.path, "ab").close()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with open(self.path, "r+b") as file:
            for blk, data in rows:
                data = data or b""
                if len(data) > self.size:
                    raise ValueError(f"block {blk} has {len(data)} bytes of {self.size}")
                file.seek(blk * self.size)
                file.write(bytes(data).ljust(self.size, b"\0"))
            file.flush()
            os.fsync(file.fileno())
        return WriterCommitMessage()


class BlockDevice(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockdevice"

    def schema(self) -> str:
        return "blk long, data binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)
