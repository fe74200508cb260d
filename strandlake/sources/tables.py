"""Readers of experiment files: delimited tables, TOML plans, power logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed
from .framing import runs, text_lines


def read_csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """A CSV file with a header; lines that start with the comment character are noise."""
    reader = spark.read.option("header", True).schema(schema)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_dimension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated lookup table with a header, all text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", "\t")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_plan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The arrays of tables of a TOML experiment plan, each as a table of text columns."""
    import json
    import tomllib

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = {}
    for name, rows in tomllib.loads(text).items():
        if isinstance(rows, list) and rows and isinstance(rows[0], dict):
            columns = list(dict.fromkeys(c for r in rows for c in r))
            plain = [tuple(None if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c]) for c in columns) for r in rows]
            found[name] = spark.createDataFrame(plain, ", ".join(f"`{c}` string" for c in columns))
    return found


#: Lines of a power log. Fixed values.
SAMPLE, READING = r"\*\*\* Sampled system activity \((?P<at>[^)]*)\)", r"CPU Power: (?P<mw>\d+) mW"


def read_power_log(spark: SparkSession, path: str) -> DataFrame:
    """Samples (timestamp, cpu_power_mw) of power logs: each reading gets the time of the last sample header before it.

    A log is read in splits. A task carries the last header along its split; readings before a split's first header take
    that of the splits before, which is looked up in one row for each split.
    """
    lines = text_lines(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for piece, fresh in runs(batches):
            now = None if fresh else now
            found = pc.extract_regex(piece.column(0), f"(?:{SAMPLE}|{READING})")
            keep = found.is_valid()
            rows = found.filter(keep)
            file, block = piece.column(2)[0].as_py(), piece.column(3)[0].as_py()
            out = []
            for r in rows.to_pylist():
                now = r["at"] or now
                out.append((file, block, len(out), now, float(r["mw"]) if r["mw"] else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["file", "block", "n", "at", "mw"])

    found = checkpointed(lines.select("value", "split", "file", "block").mapInArrow(run, "file string, block long, n long, at string, mw double"))
    last = found.groupBy("file", "block").agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.struct("n"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    filled = found.where("mw is not null").join(F.broadcast(last.select("file", "block", earlier.alias("_earlier"))), ["file", "block"])
    known = filled.select(F.coalesce("at", "_earlier").alias("at"), F.col("mw").alias("cpu_power_mw")).where("at is not null")
    return known.select(F.to_timestamp(F.regexp_replace("at", r"^\w+ +", ""), "MMM d HH:mm:ss yyyy Z").alias("timestamp"), "cpu_power_mw")


def write_results(df: DataFrame, path: str, file_format: str = "parquet", decimals: dict[str, int] | None = None) -> None:
    """Results as Parquet, JSON, or CSV with a header; decimals: columns of a CSV file written with so many places."""
    if file_format == "csv":
        fixed = [F.format_string(f"%.{decimals[c]}f", F.col(c)) if decimals and c in decimals else F.col(c) for c in df.columns]
        shown = df.select(*[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(df.columns, fixed, strict=True)])
        shown.write.option("header", True).csv(path)
    else:
        df.write.format(file_format).save(path)
