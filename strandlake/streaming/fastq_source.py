"""A stream of the records of growing FASTQ files, and of new ones.

Format "growing_fastq"; options path (a folder or a pattern), partitionBytes. The offset is, for each file, the byte behind
its last whole record: a record counts when its last line break has been written. A restarted query goes on from the
offsets of its checkpoint, so each record is read once.

The driver reads the last few lines of each file to find that byte, and executors read the ranges between. Where records
begin is told by the lines alone: a line that starts with @, two lines before one that starts with +. In a well-formed file
no other line is like that, since a sequence never starts with +, so a range of bytes finds its first record exactly. A file
that isn't well-formed is an error, as in FAILFAST mode. Files are plain, and only ever appended to.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.compressed import line_batches
from ..sources.fastq import reads_batch
from ..sources.framing import Framer
from ..sources.store import files, opened_anywhere

PARTITION_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
#: Bytes looked at first for a record's start, and at most.
LOOK, FARTHEST = 1 << 14, 1 << 28


def _first(lines: list[bytes]) -> int | None:
    """The line that begins the first record among whole lines."""
    return next((i for i in range(min(4, len(lines) - 2)) if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+")), None)


def _whole_lines(data: bytes) -> list[bytes]:
    return data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]


def end_of_records(f: BinaryIO, size: int) -> int:
    """The byte behind the last whole record of a file, from its last lines."""
    look = LOOK
    while True:
        begin = max(0, size - look)
        f.seek(begin)
        data = f.read(size - begin)
        skip = data.find(b"\n") + 1 if begin else 0
        lines = _whole_lines(data[skip:]) if skip or not begin else []
        first = _first(lines) if begin else 0
        if first is not None and len(lines) >= first + 4:
            whole = first + (len(lines) - first) // 4 * 4
            return begin + skip + sum(len(x) + 1 for x in lines[:whole])
        if not begin:
            return 0
        if look >= FARTHEST:
            raise ValueError(f"no record in the last {look} bytes")
        look *= 4


def record_at(f: BinaryIO, place: int, begin: int, end: int) -> int:
    """Where the first record at or after a place starts, in a range that begins and ends with records."""
    if place <= begin or place >= end:
        return begin if place <= begin else end
    look = LOOK
    while True:
        f.seek(place - 1)
        data = f.read(min(look, end - place + 1))
        skip = data.find(b"\n") + 1
        lines = _whole_lines(data[skip:]) if skip else []
        first = _first(lines)
        if first is not None:
            return place - 1 + skip + sum(len(x) + 1 for x in lines[:first])
        if place - 1 + len(data) >= end:
            return end  # what is left belongs to the record before
        if look >= FARTHEST:
            raise ValueError(f"no record in {look} bytes")
        look *= 4


class NewBytes(InputPartition):
    def __init__(self, path: str, low: int, high: int, begin: int, end: int):
        self.path, self.low, self.high, self.begin, self.end = path, low, high, begin, end


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for name, size in files(self.path):
            with opened_anywhere(name) as f:
                found[name] = end_of_records(f, size)
        return found

    def partitions(self, start: dict, end: dict) -> list[NewBytes]:
        new = [(name, int(start.get(name, 0)), int(last)) for name, last in sorted(end.items())]
        return [NewBytes(name, a, min(a + self.bytes, last), first, last) for name, first, last in new for a in range(first, last, self.bytes)]

    def read(self, partition: NewBytes) -> Iterator[pa.RecordBatch]:
        part, framer = partition, Framer("FAILFAST")
        with opened_anywhere(part.path) as f:
            low, high = (record_at(f, place, part.begin, part.end) for place in (part.low, part.high))
            f.seek(low)

            def pieces() -> Iterator[bytes]:
                left = high - low
                while left > 0 and (piece := f.read(min(PIECE_BYTES, left))):
                    left -= len(piece)
                    yield piece

            for lines in line_batches(pieces()):
                columns, first = framer.add(lines)
                if len(columns[0]):
                    yield reads_batch(columns, first, part.path, "FAILFAST", False)
        if framer.rest():
            raise ValueError(f"incomplete record before byte {high} of {part.path}")


class GrowingFastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_fastq"

    def schema(self) -> str:
        return "id string, sequence string, quality string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def stream_fastq(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(GrowingFastq)
    return spark.readStream.format("growing_fastq").option("partitionBytes", partition_bytes).load(path)
