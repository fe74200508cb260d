"""Validation reports of reads and files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import issues
from ..storage import checkpointed
from .compressed import compression_of, inflated, line_batches
from .fastq import checks
from .framing import LINES, Framer, framed_files, plain, runs, text_lines
from .store import files

#: Fields of a report.
REPORT = "file_format string, num_records long, min_length long, max_length long, mean_length double, num_issues long"
_RECORDS = "file string, record long, length long, issues array<string>"


def issue_rows(df: DataFrame, validate_quality: bool = True) -> DataFrame:
    """A row for every problem of every read."""
    return df.select("id", F.explode(issues(checks(validate_quality))).alias("issue"))


def report(df: DataFrame, file_format: str = "fastq") -> DataFrame:
    """Records, lengths and number of issues in one row, from one scan. Lengths are null without records."""
    n = F.length("sequence").cast("long")
    return _report(df.select(n.alias("n"), F.size(issues(checks(file_format == "fastq"))).alias("i")), file_format)


def _report(found: DataFrame, file_format: str) -> DataFrame:
    return found.agg(
        F.lit(file_format).alias("file_format"), F.count("*").alias("num_records"), F.min("n").alias("min_length"), F.max("n").alias("max_length"),
        F.try_divide(F.sum("n").cast("double"), F.count("n")).alias("mean_length"), F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("num_issues"),
    )


def _fastq_issues(columns: list[pa.Array]) -> pa.Array:
    """The names of what is wrong with each four lines, as an array column."""
    header, sequence, plus, quality = columns
    checks = {
        "header": pc.starts_with(header, "@"), "empty_id": pc.greater(pc.utf8_length(header), 1), "alphabet": pc.match_substring_regex(sequence, "^[ACGTNacgtn]*$"), "plus": pc.starts_with(plus, "+"),
        "length_mismatch": pc.equal(pc.utf8_length(sequence), pc.utf8_length(quality)), "quality_range": pc.invert(pc.match_substring_regex(quality, r"[^\x21-\x7E]")),
    }
    wrong = np.stack([~ok.to_numpy(zero_copy_only=False) for ok in checks.values()], 1)
    names = np.array(list(checks))[np.nonzero(wrong)[1]]
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(wrong.sum(1))].astype(np.int32), pa.array(names.tolist(), pa.string()))


def _records(columns: list[pa.Array], first: int, file: str) -> pa.RecordBatch:
    n = len(columns[0])
    numbers = pa.array(np.arange(first + 1, first + 1 + n))
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), numbers, pc.utf8_length(columns[1]).cast(pa.int64()), _fastq_issues(columns)], _NAMES)


def _truncated(lines: list[str], record: int, file: str) -> pa.RecordBatch | None:
    """The row of a last record that is not whole; none where its lines are empty."""
    return _batch([(file, record + 1, len(lines[1]) if len(lines) > 1 else 0, ["truncated"])]) if any(lines) else None


def _fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """Framed in splits by line numbers, in the mode that drops nothing before its check."""
    inside, edges = framed_files(spark, path, "DROPMALFORMED", _records, _RECORDS, _truncated)
    if edges is None:
        return inside

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = [row[c] for c in LINES if row[c] is not None]
                if len(lines) == 4:
                    yield _records([pa.array([x]) for x in lines], row["record"], row["file"])
                elif (last := _truncated(lines, row["record"], row["file"])) is not None:
                    yield last

    return inside.unionByName(edges.select("file", "record", *LINES).mapInArrow(join, _RECORDS))


class _Fasta:
    """Sums up the records of a file's lines, or of a split's: (number, length, whether its letters are good, header).

    Number 0, without a header, is what stands before the first header.
    """

    def __init__(self):
        self.number, self.length, self.good, self.header = 0, 0, True, None

    def row(self) -> tuple:
        return self.number, self.length, self.good, self.header

    def add(self, texts: pa.Array) -> list[tuple]:
        """The records that end in these lines."""
        begins = pc.starts_with(texts, ">").to_numpy(zero_copy_only=False)
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        good = pc.match_substring_regex(texts, "^[ACGTNacgtn]*$").to_numpy(zero_copy_only=False)
        out, cuts = [], np.unique(np.r_[0, np.flatnonzero(begins), len(texts)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < len(texts) and begins[a]:
                out.append(self.row())
                self.number, self.length, self.good, self.header = self.number + 1, 0, True, texts[a].as_py()[1:].strip()
                a += 1
            self.length += int(sizes[a:b].sum())
            self.good = self.good and bool(good[a:b].all())
        return out


_SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("length", pa.int64()), ("letters", pa.bool_()), ("header", pa.string())])
_SUMS_DDL = "file string, block long, number long, length long, letters boolean, header string"


def _sums(file: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([([file, block, *r])[k] for r in rows], f.type) for k, f in enumerate(_SUMS)], schema=_SUMS)


def _fasta_records(spark: SparkSession, path: str, compression: str | None) -> DataFrame:
    """Records by counting headers: in each split, and in the splits before it.

    A task sums up each record of its split; the parts of a record that goes over splits, of any length, are added up.
    Lines before the first header are a record without one.
    """

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fasta, key = None, ("", 0)
        for piece, fresh in runs(batches):
            if fresh:
                if fasta:
                    yield _sums(*key, [fasta.row()])
                fasta, key = _Fasta(), (piece.column(2)[0].as_py(), piece.column(3)[0].as_py())
            yield _sums(*key, fasta.add(plain(piece.column(0))))
        if fasta:
            yield _sums(*key, [fasta.row()])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fasta = _Fasta()
                for lines in line_batches(inflated(file, compression_of(file, compression))):
                    yield _sums(file, 0, fasta.add(plain(lines)))
                yield _sums(file, 0, [fasta.row()])

    if _streamed(path, compression):
        found = _file_names(spark, path).mapInArrow(streams, _SUMS_DDL)
    else:
        found = text_lines(spark, path).select("value", "split", "file", "block").mapInArrow(splits, _SUMS_DDL)
    found = checkpointed(found)
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = found.groupBy("file", "block").agg(F.max("number").alias("n")).select("file", "block", before.alias("before"))
    # Number 0 of a split goes on with the record that is open.
    placed = found.join(F.broadcast(counts), ["file", "block"]).groupBy("file", (F.col("before") + F.col("number")).alias("number"))
    whole = placed.agg(F.sum("length").alias("length"), F.every("letters").alias("letters"), F.max("header").alias("header")).where("header is not null or length > 0")
    failed = issues({"header": F.col("header").isNotNull(), "empty_id": F.col("header").isNull() | (F.col("header") != ""), "no_sequence": F.col("length") > 0, "alphabet": F.col("letters")})
    # A file whose first lines belong to no header counts them as record 1: one row for each file.
    headless = whole.where("number = 0").select("file", F.lit(1).alias("_more"))
    return whole.join(F.broadcast(headless), "file", "left").select("file", (F.col("number") + F.coalesce("_more", F.lit(0))).alias("record"), "length", failed.alias("issues"))


def _streamed(path: str, compression: str | None) -> bool:
    """Whether Spark's reader doesn't know the compression by the file's name."""
    return compression is not None or path.endswith(".zst")


def _file_names(spark: SparkSession, path: str) -> DataFrame:
    """The names of the files, one to a task."""
    names = files(path)
    return spark.createDataFrame(names, "file string, size long").select("file").repartition(max(1, min(10_000, len(names))), "file")


def _streamed_records(spark: SparkSession, path: str, compression: str | None) -> DataFrame:
    """One task a file, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                framer = Framer("DROPMALFORMED")
                for lines in line_batches(inflated(file, compression_of(file, compression))):
                    columns, first = framer.add(lines)
                    if len(columns[0]):
                        yield _records(columns, first, file)
                if framer.rest() and (last := _truncated(framer.rest(), framer.record, file)) is not None:
                    yield last

    return _file_names(spark, path).mapInArrow(run, _RECORDS)


def file_records(spark: SparkSession, path: str, file_format: str = "fastq", compression: str | None = None) -> DataFrame:
    """file, record (from 1), length and issues of every record of the files as they are, good or bad.

    Plain files are followed in splits, which know what is before them; gzip files, a compression that the name doesn't
    tell, and zstd as streams, by one task each.
    """
    if file_format not in ("fastq", "fasta"):
        raise ValueError("file_format must be fastq or fasta")
    if file_format == "fasta":
        return _fasta_records(spark, path, compression)
    return _streamed_records(spark, path, compression) if _streamed(path, compression) else _fastq_records(spark, path)


_NAMES = ["file", "record", "length", "issues"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _NAMES)


def file_report(records: DataFrame, file_format: str = "fastq") -> DataFrame:
    """The report of file records in one row."""
    return _report(records.select(F.col("length").alias("n"), F.size("issues").alias("i")), file_format)


def file_issues(records: DataFrame) -> DataFrame:
    """A row for every issue: file, record, issue."""
    return records.select("file", "record", F.explode("issues").alias("issue"))


def report_json(report: DataFrame) -> DataFrame:
    """The report as one JSON object a row, in a text column `value`; nulls are kept, so every report has every field."""
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as a folder of one JSON file; replaces the one before."""
    report_json(report).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def require_records(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no records")
    return df
