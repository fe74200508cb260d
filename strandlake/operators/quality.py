"""Quality operators. Values are raw bytes unless offset 33 asks for Phred scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.vectors import byte_counts, count_among, mean_byte, position_counts
from ..schema import MIN_LENGTH, MIN_QUALITY


def quality_aggregation(df: DataFrame, offset: int = 0) -> DataFrame:
    """Least, greatest, sum and mean over all bases with quality; without any, 255, 0, 0 and 0.0."""
    value = F.greatest(F.col("byte") - offset, F.lit(0))
    t = byte_counts(df, "quality").agg(
        F.coalesce(F.min(value), F.lit(255)).cast("int").alias("min_quality"), F.coalesce(F.max(value), F.lit(0)).cast("int").alias("max_quality"),
        F.coalesce(F.sum(value * F.col("n")), F.lit(0)).cast("long").alias("total_quality"), count_among(None).alias("num_bases"),
    )
    return t.withColumn("mean_quality", S.mean(F.col("total_quality"), F.col("num_bases")))


def quality_statistics(df: DataFrame) -> DataFrame:
    """Mean, median, quartiles and count of each 0-based position.

    Positions and byte values are counted first (at most 256 rows for each position), and the percentiles use these
    counts as frequencies, so the second shuffle doesn't depend on the number of reads.
    """
    counted = position_counts(df.where("quality is not null"), "quality").groupBy("pos", "q").agg(F.sum("n").alias("n"))
    t = counted.groupBy("pos").agg(F.sum(F.col("q") * F.col("n")).alias("total"), F.sum("n").alias("count"), F.expr("percentile(q, array(0.25, 0.5, 0.75), n)").alias("p"))
    return t.select("pos", S.mean(F.col("total"), F.col("count")).alias("mean"), F.col("p")[1].alias("median"), F.col("p")[0].alias("q1"), F.col("p")[2].alias("q3"), "count")


def require_quality(df: DataFrame) -> DataFrame:
    """The same rows, or an error where no row has quality."""
    if df.where("quality is not null").isEmpty():
        raise ValueError("no read has quality")
    return df


def overall_mean(stats: DataFrame) -> DataFrame:
    """Unweighted mean of the positions' means."""
    return stats.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall_mean"))


def low_quality_positions(stats: DataFrame, below: float) -> DataFrame:
    return stats.where(F.col("mean") < below).select("pos")


def position(stats: DataFrame, pos: int) -> DataFrame:
    return stats.where(F.col("pos") == pos)


def _passed(df: DataFrame, passed, failed) -> DataFrame:
    t = df.agg(F.count("*").alias("total_sequences"), F.count_if(passed).alias("passed_sequences"), F.count_if(failed).alias("filtered_sequences"))
    return t.withColumn("pass_rate", S.percent(F.col("passed_sequences"), F.col("total_sequences")))


def quality_filter(df: DataFrame, least: int = MIN_QUALITY) -> DataFrame:
    """Counts by mean byte value; a read without quality counts in the total only."""
    q = F.col("_q")
    return _passed(df.select(mean_byte(F.col("quality")).alias("_q")), q >= least, q < least)


def quality_filter_rows(df: DataFrame, least: float = 20.0, offset: int = 33) -> DataFrame:
    """The reads whose mean quality reaches the threshold."""
    return df.where(mean_byte(F.col("quality")) - offset >= least)


def quality_mask(df: DataFrame, least: int = MIN_QUALITY) -> DataFrame:
    """Every read with a flag: 1 where its mean byte value reaches the threshold."""
    return df.withColumn("passes", F.coalesce(mean_byte(F.col("quality")) >= least, F.lit(False)).cast("int"))


def length_filter(df: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    n = S.total_bases(F.col("sequence"))
    return _passed(df, n >= least, n < least)


def length_range(df: DataFrame, least: int, most: int) -> DataFrame:
    """The reads whose length is in the closed range."""
    return df.where(S.total_bases(F.col("sequence")).between(least, most))
