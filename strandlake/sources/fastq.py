"""FASTQ and FASTA tables from files, and back.

Plain and gzip files are read by Spark's text reader, from any store Spark reads. A plain file is split like any text, and
every mode gives the same records at every split size (see framing.py). Gzip files, which can't be split, are framed in the
same pass that reads them, by one task each, as a stream. Zstd, and a compression that the name doesn't tell, have a Python
data source that streams a file (see compressed.py); BGZF files have a stored index of their blocks (see bgzf.py).

Modes: FAILFAST raises at a bad record; DROPMALFORMED leaves it out; PERMISSIVE takes four lines as they are until an
empty header; RESYNC skips one line where a header should be.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import with_default_quality
from ..schema import READS
from .framing import LINES, MODES, framed_files

Record = tuple[str, str, str]


def problem(lines: list[str], validate: bool = False) -> str | None:
    """What is wrong with four lines, if anything."""
    if len(lines) < 4:
        return "incomplete record"
    if not lines[0].startswith("@"):
        return "header does not start with @"
    if not lines[2].startswith("+"):
        return "third line does not start with +"
    if len(lines[1].strip()) != len(lines[3].strip()):
        return "sequence and quality differ in length"
    if validate and not all(33 <= ord(c) <= 126 for c in lines[3].strip()):
        return "quality outside 33..126"
    return None


def _record(lines: list[str]) -> Record:
    return lines[0][1:].strip(), lines[1].strip(), lines[3].strip()


def parse(lines: Iterable[str], mode: str = "FAILFAST", validate: bool = False) -> Iterator[Record]:
    """Records of one file's lines."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    held: list[str] = []
    for line in lines:
        if mode == "RESYNC" and not held and not line.startswith("@"):
            continue
        if mode == "PERMISSIVE" and not held and not line:
            return
        held.append(line)
        if len(held) < 4:
            continue
        wrong = problem(held, validate) if mode in ("FAILFAST", "DROPMALFORMED") else None
        if wrong and mode == "FAILFAST":
            raise ValueError(f"{wrong}: {held[0][:80]}")
        if not wrong:
            yield (held[0].removeprefix("@"), held[1], held[3]) if mode == "PERMISSIVE" else _record(held)
        held = []
    if held and mode == "FAILFAST" and any(held):
        raise ValueError(f"incomplete record: {held[0][:80]}")


COLUMNS = ["id", "sequence", "quality"]


def framed(lines: pa.Array, mode: str, validate: bool) -> list[pa.Array]:
    """id, sequence and quality of lines that are whole records."""
    return checked([lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4)], mode, validate)


def checked(columns: list[pa.Array], mode: str, validate: bool) -> list[pa.Array]:
    """id, sequence and quality of the four lines of records, checked as `problem` does; PERMISSIVE leaves them as they are."""
    header, sequence, plus, quality = columns
    if mode == "PERMISSIVE":
        return [pc.if_else(pc.starts_with(header, "@"), pc.utf8_slice_codeunits(header, 1), header), sequence, quality]
    sequence, quality = pc.utf8_trim_whitespace(sequence), pc.utf8_trim_whitespace(quality)
    found = [pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(header, 1)), sequence, quality]
    if mode == "RESYNC":
        return found
    good = pc.and_(pc.and_(pc.starts_with(header, "@"), pc.starts_with(plus, "+")), pc.equal(pc.utf8_length(sequence), pc.utf8_length(quality)))
    if validate:
        good = pc.and_(good, pc.invert(pc.match_substring_regex(quality, r"[^\x21-\x7E]")))
    if pc.all(good).as_py() in (True, None):
        return found
    if mode == "FAILFAST":
        i = good.to_pylist().index(False)
        raise ValueError(f"{problem([c[i].as_py() for c in columns], validate)}: {header[i].as_py()[:80]}")
    return [c.filter(good) for c in found]


def reads_batch(columns: list[pa.Array], first: int, file: str, mode: str, validate: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(checked(columns, mode, validate), COLUMNS)


def no_rest(lines: list[str], record: int, file: str, mode: str) -> None:
    """What becomes of a last record that is not whole: an error in FAILFAST mode, unless its lines are empty."""
    if mode == "FAILFAST" and any(lines):
        raise ValueError(f"incomplete record at the end of {file}: {lines[0][:80]}")


def read_fastq(spark: SparkSession, path: str, mode: str = "FAILFAST", validate_quality: bool = False, compression: str | None = None) -> DataFrame:
    """Reads of one or many FASTQ files; compression is none, gzip or zstd, by extension unless named."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    by_name = compression is None or (compression == "gzip") == path.endswith(".gz")
    if compression == "zstd" or (compression is None and path.endswith(".zst")) or not by_name:
        from .compressed import register

        register(spark)
        options = {"mode": mode, "validateQuality": validate_quality, **({"compression": compression} if compression else {})}
        return spark.read.format("compressed_fastq").options(**options).load(path)
    finish = partial(reads_batch, mode=mode, validate=validate_quality)
    inside, edges = framed_files(spark, path, mode, finish, "id string, sequence string, quality string", partial(no_rest, mode=mode))
    if edges is None:
        return inside

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(3).is_null()
            for row in batch.filter(short).to_pylist():
                no_rest([x for x in list(row.values())[:4] if x is not None], 0, row["file"], mode)
            yield reads_batch(batch.filter(pc.invert(short)).columns[:4], 0, "", mode, validate_quality)

    return inside.unionByName(edges.select(*LINES, "file").mapInArrow(join, READS))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTA files, wrapped lines joined and blank ones skipped; quality is null."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    header = F.substring_index("v", "\n", 1)
    rest = F.when(F.contains("v", F.lit("\n")), F.expr("substring(v, instr(v, '\n') + 1)")).otherwise("")
    return text.select(F.trim(F.regexp_replace(header, "\r", "")).alias("id"), F.regexp_replace(rest, r"\s", "").alias("sequence"), F.lit(None).cast("string").alias("quality"))


def fastq_text(df: DataFrame) -> DataFrame:
    """One text row for each read, of four lines."""
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "sequence", F.lit("+"), "quality").alias("value"))


def fasta_text(df: DataFrame, width: int = 60) -> DataFrame:
    wrapped = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), "id", F.lit("\n"), wrapped).alias("value"))


def write_fastq(df: DataFrame, path: str, compression: str = "gzip") -> None:
    with_default_quality(df).transform(fastq_text).write.option("compression", compression).text(path)


def write_fasta(df: DataFrame, path: str, compression: str = "none") -> None:
    fasta_text(df).write.option("compression", compression).text(path)


def checks(validate_quality: bool = False) -> dict[str, Column]:
    """What holds for a good record, by the name of the issue."""
    found = {
        "empty_id": F.length("id") > 0,
        "alphabet": F.col("sequence").rlike("^[ACGTNacgtn]*$"),
        "length_mismatch": F.col("quality").isNull() | (F.length("sequence") == F.length("quality")),
    }
    if validate_quality:
        found["quality_range"] = F.col("quality").isNull() | F.col("quality").rlike("^[\\x21-\\x7E]*$")
    return found


def round_trip(df: DataFrame, validate_quality: bool = False) -> DataFrame:
    """Records written as FASTQ text and parsed again, bad ones left out; the text stays in the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "\n".join(batch.column(0).to_pylist())
            lines = pa.array(text.split("\n") if text else [], pa.string())
            lines = lines.slice(0, len(lines) - len(lines) % 4)  # a last record in part is no record
            yield pa.RecordBatch.from_arrays(framed(lines, "DROPMALFORMED", validate_quality), COLUMNS)

    return with_default_quality(df).transform(fastq_text).mapInArrow(run, READS)
