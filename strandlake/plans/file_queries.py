"""Registered queries over FASTQ files of every kind: written from the reads, in files that tasks share, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks
from ..sources import bgzf, compressed, fastq, tables, validation
from ..sources.store import files
from ..storage import new_folder
from ..streaming import fastq_source, pipelines
from .read_queries import QUERIES, SQL, query
from .reads import MIXED_SQL, mixed, table

#: Least bytes of a split, of a BGZF part and of a stream's range, so that the smallest tables have several.
SPLIT = 60_000
#: Splits of larger files, until each has the bytes that its reader takes unless told otherwise.
SPLITS = 256
_MOST_BYTES = 128 << 20
#: Folders of files in which the place of a read follows from its key.
FOLDERS = 4

_FILLED = f"WITH {MIXED_SQL} SELECT id, sequence, coalesce(quality, repeat('?', length(sequence))) AS quality FROM reads"


def _ordered_files(df: DataFrame, extra) -> str:
    """Reads as plain FASTQ, in files by key modulo FOLDERS, in order of the key; extra(df) is a text after a read, or null."""
    path = new_folder(df.sparkSession, "reads")
    text = F.concat_ws("\n", F.concat(F.lit("@"), "id"), "sequence", F.lit("+"), F.coalesce("quality", F.expr("repeat('?', length(sequence))")), extra)
    rows = df.select((F.col("ord") % FOLDERS).alias("part"), "ord", text.alias("value"))
    rows.repartition(FOLDERS, "part").sortWithinPartitions("part", "ord").select("part", "value").write.partitionBy("part").text(path)
    return path


def split_bytes(total: int, most: int) -> int:
    """Bytes of a split of files that hold `total` bytes: their number grows with them only beyond SPLITS of the most bytes."""
    return min(most, max(SPLIT, -(-total // SPLITS)))


def _folder_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a folder's files, from their names and sizes alone."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _small_splits(spark: SparkSession, path: str) -> SparkSession:
    """A session whose splits of a folder are small, for a small folder."""
    own = spark.newSession()
    size = split_bytes(_folder_bytes(spark, path), _MOST_BYTES)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


def _in_splits(df: DataFrame, path: str, mode: str) -> DataFrame:
    return fastq.read_fastq(_small_splits(df.sparkSession, path), path, mode=mode)


_stray = lambda: F.when(F.col("ord") % 97 < 2, F.concat(F.lit("#"), "id"))

#: Lines in fours without looking for headers again: one stray line spoils all records up to the fourth stray line.
_FOURS = f"""WITH {MIXED_SQL}, l AS (
  SELECT ord, unnest(range(0, 5)) AS k, unnest([concat('@', id), sequence, '+', coalesce(quality, repeat('?', length(sequence))), CASE WHEN ord % 97 < 2 THEN concat('#', id) END]) AS line FROM reads
), n AS (SELECT ord % {FOLDERS} AS part, line, row_number() OVER (PARTITION BY ord % {FOLDERS} ORDER BY ord, k) - 1 AS i FROM l WHERE line IS NOT NULL),
g AS (SELECT part, i // 4 AS g, max(line) FILTER (i % 4 = 0) AS a, max(line) FILTER (i % 4 = 1) AS b, max(line) FILTER (i % 4 = 2) AS c, max(line) FILTER (i % 4 = 3) AS d FROM n GROUP BY ALL HAVING count(*) = 4)
"""
query("fastq_stray_lines", _FOURS + "SELECT trim(substring(a, 2)) AS id, b AS sequence, d AS quality FROM g WHERE starts_with(a, '@') AND starts_with(c, '+') AND length(b) = length(d)", mixed)(lambda df: _in_splits(df, _ordered_files(df, _stray()), "DROPMALFORMED"))
query("fastq_stray_permissive", _FOURS + "SELECT CASE WHEN starts_with(a, '@') THEN substring(a, 2) ELSE a END AS id, b AS sequence, d AS quality FROM g", mixed)(lambda df: _in_splits(df, _ordered_files(df, _stray()), "PERMISSIVE"))
query("fastq_stray_resync", _FILLED, mixed)(lambda df: _in_splits(df, _ordered_files(df, _stray()), "RESYNC"))


def _written(df: DataFrame, compression: str) -> str:
    path = new_folder(df.sparkSession, "reads")
    compressed.write_compressed(df, path, compression)
    return path


query("fastq_zstd_files", _FILLED, mixed)(lambda df: fastq.read_fastq(df.sparkSession, _written(df, "zstd"), compression="zstd"))
query("fastq_named_gzip_files", _FILLED, mixed)(lambda df: fastq.read_fastq(df.sparkSession, _written(df, "gzip"), compression="gzip"))

#: Every third read has a quality longer than its sequence.
_bad = lambda df: df.withColumn("quality", F.when(F.col("ord") % 3 == 0, F.concat("sequence", F.lit("!"))).otherwise(F.col("quality")))


def _stored_index(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, new_folder(df.sparkSession, "index")
    written = _written(df, "bgzf")
    bgzf.index(spark, written, split_bytes(sum(n for _, n in files(written)), bgzf.PART_BYTES)).write.parquet(path)
    return spark.read.parquet(path)


def _read_parts(stored: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    total = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return bgzf.read_bgzf(stored.sparkSession, "", mode, stored=stored, part_bytes=split_bytes(total, bgzf.PART_BYTES))


query("bgzf_malformed_files", f"{_FILLED} WHERE ord % 3 <> 0", mixed)(lambda df: _read_parts(_stored_index(_bad(df)), "DROPMALFORMED"))
query("bgzf_files", _FILLED, mixed)(lambda df: _read_parts(_stored_index(df)))
query("bgzf_index_totals", f"WITH {MIXED_SQL} SELECT (4 * count(*))::BIGINT AS lines, sum(strlen(id) + 2 * strlen(sequence) + 6)::BIGINT AS bytes FROM reads", mixed)(
    lambda df: _stored_index(df).agg(F.sum("lines").alias("lines"), F.sum("text").alias("bytes"))
)
query("validation_report_file", SQL["validate_fastq"], mixed)(lambda df: _report_file(df))


def _report_file(df: DataFrame) -> DataFrame:
    """The report written as a JSON file and read again."""
    path = new_folder(df.sparkSession, "report")
    validation.write_report(validation.report(df), path)
    return validation.read_report(df.sparkSession, path)


_SIZES = [1, 1000, 10_000]
_BLOCK_ROW = "SELECT {n}::BIGINT AS size, ceil(count(*) / {n}.0)::BIGINT AS blocks, (CASE WHEN count(*) % {n} = 0 THEN least({n}, count(*)) ELSE count(*) % {n} END)::BIGINT AS least, least({n}, count(*))::BIGINT AS greatest, count(*)::BIGINT AS reads, sum(strlen(sequence))::BIGINT AS total_bases, sum(length(sequence) - length(translate(sequence, 'GCgc', '')))::BIGINT AS count_gc FROM reads"
query("block_sizes", f"WITH {MIXED_SQL} " + " UNION ALL ".join(_BLOCK_ROW.format(n=n) for n in _SIZES), mixed)(lambda df: blocks.block_sizes(df, _SIZES))


def _power_logs(df: DataFrame) -> DataFrame:
    """Logs of events in order, a header before every third, read back in splits: readings by the time that they got."""
    path = new_folder(df.sparkSession, "logs")
    header = F.concat(F.lit("*** Sampled system activity ("), F.date_format(F.col("ts").cast("timestamp"), "EEE MMM d HH:mm:ss yyyy Z"), F.lit(")"))
    reading = F.concat(F.lit("CPU Power: "), F.floor(F.abs("value") * 10).cast("string"), F.lit(" mW"))
    lines = df.select((F.col("event_id") % FOLDERS).alias("part"), "event_id", F.concat_ws("\n", F.when(F.col("event_id") % 3 == 0, header), F.lit("noise"), reading).alias("value"))
    lines.repartition(FOLDERS, "part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    read = tables.read_power_log(_small_splits(df.sparkSession, path), path)
    return read.groupBy(F.unix_timestamp("timestamp").alias("moment")).agg(F.count("*").alias("n"), F.sum("cpu_power_mw").cast("long").alias("mw"))


query(
    "power_log_files",
    f"WITH e AS (SELECT event_id, event_id % {FOLDERS} AS part, CASE WHEN event_id % 3 = 0 THEN floor(epoch(ts))::BIGINT END AS moment, floor(abs(value) * 10)::BIGINT AS mw FROM events), "
    "f AS (SELECT mw, last_value(moment IGNORE NULLS) OVER (PARTITION BY part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moment FROM e) "
    "SELECT moment, count(mw) AS n, sum(mw)::BIGINT AS mw FROM f WHERE moment IS NOT NULL AND mw IS NOT NULL GROUP BY moment",
    lambda spark, sf_dir: table(spark, sf_dir, "events"),
)(_power_logs)


def stream_fastq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ in, filtered, FASTQ out, as a stream that runs twice: files appear between the runs, the second goes on from the first."""
    df, root = mixed(spark, sf_dir), new_folder(spark, "streams")
    for half in range(2):
        compressed.write_compressed(df.where(F.col("ord") % 2 == half), f"{root}/in", "none")
        size = split_bytes(sum(n for _, n in files(f"{root}/in")), fastq_source.PARTITION_BYTES)
        pipelines.fastq_pipeline(fastq_source.stream_fastq(spark, f"{root}/in", size), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return fastq.read_fastq(spark, f"{root}/out/*.gz")


_MEAN = "list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c)))::DOUBLE / length(quality)"
QUERIES["stream_fastq_filter"] = stream_fastq_filter
SQL["stream_fastq_filter"] = f"WITH f AS ({_FILLED}) SELECT id, sequence, quality FROM f WHERE {_MEAN} - 33 >= 20"
