"""A Python data source for FASTQ files of any compression, which streams a file in its reader, and its writer.

Format "compressed_fastq". A compressed file can't be cut, so a task takes a file; it holds one piece of the inflated text
and the lines of an open record, whatever the file's size. Options: path; compression (gzip, zstd, bgzf or none; by
extension unless named); mode; validateQuality; pieceBytes (inflated bytes at a time).

Writing takes id, sequence, quality; a null quality is written as `?` for each base. A task writes files of names of its
own under `_staged`; only those of the attempts that Spark commits are moved to their place, so a task that runs again leaves
nothing twice.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .fastq import no_rest, reads_batch
from .framing import MODES, Framer
from .store import files, located, opened

PIECE_BYTES = 4 << 20
EXTENSIONS = {"gzip": ".fq.gz", "zstd": ".fq.zst", "bgzf": ".fq.bgz", "none": ".fq"}


def compression_of(path: str, named: str | None) -> str:
    """The named compression, or that of the file's extension; bgzf is read as gzip."""
    kind = named or ("zstd" if path.endswith(".zst") else "gzip" if path.endswith((".gz", ".bgz", ".bgzf")) else "none")
    if kind not in EXTENSIONS:
        raise ValueError(f"compression must be one of {sorted(EXTENSIONS)}")
    return kind


def _gunzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Inflates gzip members one after the other; zeros behind the last one are padding."""
    inflater, fed = zlib.decompressobj(31), False
    for piece in pieces:
        fed = True
        while piece:
            if inflater.eof:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
                inflater = zlib.decompressobj(31)
            yield inflater.decompress(piece, PIECE_BYTES)
            while inflater.unconsumed_tail:
                yield inflater.decompress(inflater.unconsumed_tail, PIECE_BYTES)
            piece = inflater.unused_data
    if fed and not inflater.eof:
        yield inflater.flush()
        if not inflater.eof:
            raise EOFError("the compressed file ends before its end mark")


def inflated(path: str, compression: str, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A file's text in pieces of bounded size."""
    with opened(path) as f:
        if compression == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as stream:
                while piece := stream.read(size):
                    yield piece
            return
        pieces = iter(lambda: f.read(size), b"")
        yield from pieces if compression == "none" else _gunzipped(pieces)


def lines_of(data: bytes) -> pa.Array:
    """The lines of a text that ends with a line break, without one Python object for each."""
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x == 10)
    offsets = np.r_[0, ends - np.arange(len(ends))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(x[x != 10].tobytes())).cast(pa.string())


def line_batches(pieces: Iterator[bytes]) -> Iterator[pa.Array]:
    """Whole lines of a text in pieces, as columns; a last line needs no line break."""
    held: list[bytes] = []
    for piece in pieces:
        cut = piece.rfind(b"\n") + 1
        if not cut:
            held.append(piece)
            continue
        yield lines_of(b"".join([*held, piece[:cut]]))
        held = [piece[cut:]]
    if any(held):
        yield lines_of(b"".join(held) + b"\n")


class WholeFile(InputPartition):
    def __init__(self, path: str, compression: str):
        self.path, self.compression = path, compression


class CompressedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.compression = options.get("compression")
        self.mode = options.get("mode", "FAILFAST")
        self.validate = str(options.get("validatequality", "false")).lower() == "true"
        self.piece = int(options.get("piecebytes", PIECE_BYTES))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def partitions(self) -> list[WholeFile]:
        return [WholeFile(name, compression_of(name, self.compression)) for name, _ in files(self.path)]

    def read(self, part: WholeFile) -> Iterator[pa.RecordBatch]:
        framer = Framer(self.mode)
        for lines in line_batches(inflated(part.path, part.compression, self.piece)):
            columns, first = framer.add(lines)
            if len(columns[0]):
                yield reads_batch(columns, first, part.path, self.mode, self.validate)
            if framer.stopped:
                return
        if framer.rest():
            no_rest(framer.rest(), framer.record, part.path, self.mode)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Deflater:
    """A compressor that takes texts in pieces."""

    def __init__(self, compression: str):
        if compression == "zstd":
            import zstandard

            self.inner = zstandard.ZstdCompressor(level=3).compressobj()
            self.add, self.end = self.inner.compress, self.inner.flush
        elif compression == "gzip":
            self.inner = zlib.compressobj(6, zlib.DEFLATED, 31)
            self.add, self.end = self.inner.compress, self.inner.flush
        elif compression == "bgzf":
            from .bgzf import Blocks

            self.inner = Blocks()
            self.add, self.end = self.inner.add, self.inner.end
        else:
            self.add, self.end = bytes, bytes


def fastq_bytes(batch: pa.RecordBatch) -> bytes:
    """The FASTQ text of a batch of id, sequence, quality."""
    ids, sequence, quality = batch.columns[:3]
    filled = pc.if_else(quality.is_valid(), quality, pc.binary_repeat("?", pc.utf8_length(sequence))) if quality.null_count else quality
    text = pc.binary_join_element_wise(pc.binary_join_element_wise("@", ids, ""), sequence, "+", filled, "\n")
    return b"".join(x + b"\n" for x in text.cast(pa.binary()).to_pylist())


class CompressedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.compression = compression_of("", options.get("compression", "gzip"))
        if overwrite:
            raise ValueError("compressed_fastq only appends")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        name, out, deflater = f"part-{uuid4().hex}{EXTENSIONS[self.compression]}", None, Deflater(self.compression)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{root}/_staged", recursive=True)
                out = store.open_output_stream(f"{root}/_staged/{name}", compression=None)
            out.write(deflater.add(fastq_bytes(batch)))
        if out is None:
            return Written(None)
        out.write(deflater.end())
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(posixpath.join(root, "_staged", m.name), posixpath.join(root, m.name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What is left under `_staged` belongs to attempts that count for nothing."""
        from pyarrow import fs

        store, root = located(self.path)
        if store.get_file_info(f"{root}/_staged").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_staged")


class CompressedFastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "compressed_fastq"

    def schema(self) -> str:
        return "id string, sequence string, quality string"

    def reader(self, schema) -> CompressedReader:
        return CompressedReader(self.options)

    def writer(self, schema, overwrite: bool) -> CompressedWriter:
        return CompressedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CompressedFastq)


def write_compressed(df, path: str, compression: str = "zstd") -> None:
    """Reads as FASTQ files of a folder, one for each task."""
    register(df.sparkSession)
    df.select("id", "sequence", "quality").write.format("compressed_fastq").mode("append").option("compression", compression).save(path)
