"""BGZF: gzip in independent blocks, read in parallel by a stored index of the blocks.

The index is a table with one row for each block: its place (`block`, and `virtual_offset`, its BGZF address), its sizes,
and the line breaks in it and before it in the file. It is made by one pass over byte ranges: a task finds the first block
that starts in its range and counts to the range's end; the ranges before it are added as sums, one row for each range. An
index can be stored as Parquet and used again, also to fetch a few records by number.

Reading cuts the blocks into parts. Line k of a file belongs to the part that holds the break before it, and a record to the
part of its header line, so the lines in fours are those of the whole file whatever the parts are; a part reads on into the
next blocks until its last record is whole. FAILFAST raises at a bad record; DROPMALFORMED leaves out the four lines.
Files lie in any store that pyarrow opens (see store.py).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import READS
from ..storage import checkpointed
from .fastq import no_rest, reads_batch
from .framing import Framer
from .store import files, opened_anywhere

#: Bytes of a part; the longest block; inflated bytes of a block that is written.
PART_BYTES, LONGEST_BLOCK, FULL = 8 << 20, 1 << 16, 65280


def block_size(head: bytes) -> int | None:
    """The size of the block whose first bytes these are; None where no block begins."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, i = head[12 : 12 + struct.unpack("<H", head[10:12])[0]], 0
    while i + 4 <= len(extra):
        n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
        if extra[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(extra):
            return struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
        i += 4 + n
    return None


def _head(f: BinaryIO, at: int) -> bytes:
    f.seek(at)
    return f.read(1024)


def next_block(f: BinaryIO, at: int, size: int) -> int | None:
    """Where the first block at or after a place starts: a header that another block, or the end, follows."""
    f.seek(at)
    window, i = f.read(LONGEST_BLOCK + 1024), 0
    while (i := window.find(b"\x1f\x8b\x08\x04", i)) >= 0:
        length = block_size(window[i : i + 1024])
        if length and (at + i + length == size or block_size(_head(f, at + i + length))):
            return at + i
        i += 1
    return None


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block, 31)


def blocks(f: BinaryIO, at: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Place, size and text of each block from a place on, read as they are asked for."""
    while at < size:
        length = block_size(_head(f, at))
        if not length:
            raise ValueError(f"no BGZF block at {at}")
        f.seek(at)
        yield at, length, inflate(f.read(length))
        at += length


class Blocks:
    """Cuts a text that comes in pieces into compressed blocks; `end` adds the empty block that ends a file."""

    def __init__(self, full: int = FULL):
        self.full, self.held = full, b""

    def _block(self, part: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))

    def add(self, data: bytes) -> bytes:
        self.held += data
        whole = len(self.held) - len(self.held) % self.full
        out = b"".join(self._block(self.held[a : a + self.full]) for a in range(0, whole, self.full))
        self.held = self.held[whole:]
        return out

    def end(self) -> bytes:
        last = self._block(self.held) if self.held else b""
        self.held = b""
        return last + self._block(b"")


def deflate(data: bytes, full: int = FULL) -> bytes:
    """The BGZF bytes of some data."""
    made = Blocks(full)
    return made.add(data) + made.end()


_BLOCKS = "file string, range long, block long, size long, text long, lines long"


def index(spark: SparkSession, path: str, range_bytes: int = PART_BYTES) -> DataFrame:
    """file, block, virtual_offset, size, text (bytes inflated), lines (breaks), before (breaks before it in the file)."""
    found = files(path)
    ranges = spark.createDataFrame(found, "file string, length long").where("length > 0")
    cut = ranges.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("range"))
    tasks = max(1, min(sum(-(-n // range_bytes) for _, n in found), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened_anywhere(r["file"]) as f:
                    end = min(r["range"] + range_bytes, r["length"])
                    at, rows = 0 if not r["range"] else next_block(f, r["range"], r["length"]), []
                    if at is None or at >= end:
                        continue
                    for place, size, text in blocks(f, at, r["length"]):
                        if place >= end:
                            break
                        rows.append({"file": r["file"], "range": r["range"], "block": place, "size": size, "text": len(text), "lines": text.count(b"\n")})
                yield from pa.Table.from_pylist(rows).to_batches()

    # Both the rows and their sums come from here; the blocks are inflated once.
    each = checkpointed(cut.repartition(tasks, "file", "range").mapInArrow(run, _BLOCKS))
    inside = F.coalesce(F.sum("lines").over(W.partitionBy("file", "range").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = each.withColumn("inside", inside)
    sums = each.groupBy("file", "range").agg(F.sum("lines").alias("n")).select("file", "range", earlier.alias("earlier"))
    return rows.join(sums, ["file", "range"]).select("file", "block", (F.col("block") * 65536).alias("virtual_offset"), "size", "text", "lines", (F.col("earlier") + F.col("inside")).alias("before"))


def parts(found: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, block (the first), before, lines: one row for each part, from the rows of an index."""
    part = F.floor(F.col("block") / part_bytes)
    return found.groupBy("file", part.alias("_part")).agg(F.min("block").alias("block"), F.min("before").alias("before"), F.sum("lines").alias("lines"), F.max(F.col("block") + F.col("size")).alias("end")).drop("_part")


def _text_lines(f: BinaryIO, at: int, size: int) -> Iterator[pa.Array]:
    from .compressed import line_batches

    return line_batches(text for _, _, text in blocks(f, at, size) if text)


def part_records(file: str, at: int, before: int, lines: int, mode: str) -> Iterator[tuple[list[pa.Array], int]]:
    """The columns of the records of a part, and the first one's number; raises at one cut short in FAILFAST mode."""
    first = before + 1 if at else 0  # the first line of the part
    last = before + lines
    wanted = last // 4 * 4 + 4 - first  # up to the end of the record whose header is the last one of the part
    if last < first or wanted <= 0:
        return
    skip, framer = int(at > 0), Framer(mode, first % 4, first)
    with opened_anywhere(file) as f:
        for batch in _text_lines(f, at, f.size()):
            some = batch.slice(skip, max(0, min(len(batch) - skip, wanted)))
            skip -= min(skip, len(batch))
            wanted -= len(some)
            columns, number = framer.add(some)
            if len(columns[0]):
                yield columns, number
            if not wanted:
                return
    if framer.rest():
        no_rest(framer.rest(), framer.record, file, mode)


def read_parts(pieces: DataFrame, mode: str = "FAILFAST", validate: bool = False, numbered: bool = False) -> DataFrame:
    """The reads of parts; numbered adds file and record, the number of a record's four lines in its file."""
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError("mode must be FAILFAST or DROPMALFORMED")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for columns, first in part_records(r["file"], r["block"], r["before"], r["lines"], mode):
                    if not numbered:
                        yield reads_batch(columns, first, r["file"], mode, validate)
                        continue
                    for k in range(len(columns[0])):  # a few records, fetched by number
                        found = reads_batch([c.slice(k, 1) for c in columns], first + k, r["file"], mode, validate)
                        if found.num_rows:
                            yield pa.RecordBatch.from_arrays([*found.columns, pa.array([r["file"]]), pa.array([first + k])], ["id", "sequence", "quality", "file", "record"])

    tasks = pieces.repartition(max(1, min(100_000, pieces.count())), "file", "block").select("file", "block", "before", "lines")
    return tasks.mapInArrow(run, "id string, sequence string, quality string, file string, record long" if numbered else READS)


def read_bgzf(spark: SparkSession, path: str, mode: str = "FAILFAST", validate: bool = False, stored: DataFrame | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Reads of BGZF files, by a stored index or one made now."""
    return read_parts(checkpointed(parts(index(spark, path, part_bytes) if stored is None else stored, part_bytes)), mode, validate)


def fetch(stored: DataFrame, first: int, last: int, mode: str = "FAILFAST") -> DataFrame:
    """The records of numbers first to last of each file, with file and record; only blocks that hold their lines are read."""
    begins, ends = F.col("before"), F.col("before") + F.col("lines")
    held = stored.where((begins <= 4 * last) & (ends >= 4 * first))
    # A block is a part of its own here: few are read, and each knows its lines.
    pieces = held.select("file", "block", "before", "lines")
    return read_parts(pieces, mode, numbered=True).where(F.col("record").between(first, last))
