"""Structured Streaming: stateless read pipelines and running totals."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import sequence as S
from ..operators.quality import quality_filter_rows
from ..operators.transforms import with_default_quality
from ..sources.fastq import fastq_text


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, else beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{root}/streams/{uuid4().hex}"


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files under a path, which may be a glob; the schema is that of the files now there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def filter_pipeline(reads: DataFrame, path: str, checkpoint: str, least: float = 20.0, file_format: str = "parquet") -> StreamingQuery:
    """Keeps reads of sufficient mean quality and appends them to a folder; takes what is there and ends."""
    kept = quality_filter_rows(reads, least)
    return kept.writeStream.format(file_format).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def fastq_pipeline(reads: DataFrame, path: str, checkpoint: str, least: float = 20.0, compression: str = "gzip") -> StreamingQuery:
    """As `filter_pipeline`, with FASTQ files as its sink."""
    kept = fastq_text(with_default_quality(quality_filter_rows(reads, least)))
    return kept.writeStream.format("text").option("compression", compression).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def running_counts(reads: DataFrame) -> DataFrame:
    """Totals that add up over any split of the stream; the state is one row for each key."""
    s = F.col("sequence")
    return reads.groupBy(F.length(s).alias("length")).agg(F.count("*").alias("num_sequences"), F.sum(S.total_bases(s)).alias("total_bases"), F.sum(S.count_of(s, "GC")).alias("count_gc"), F.sum(S.count_of(s, "N")).alias("count_n"))


def complete_to(df: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Writes the whole aggregate after each batch, replacing the last."""

    def put(batch: DataFrame, _: int) -> None:
        shape(batch).write.mode("overwrite").parquet(path)

    return df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
