"""Read operators over packed two-bit sequences: a column of structs (data, length); results as those over letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions import sequence as S


def packed(df: DataFrame, column: str = "packed") -> DataFrame:
    """Reads with their sequence packed."""
    return df.withColumn(column, P.encode(F.col("sequence"))).drop("sequence", "quality")


def _sums(df: DataFrame, column: str) -> DataFrame:
    """a, c, g, t and total over all reads, from packed bytes."""
    found = df.select(P.letter_counts(F.col(column)).alias("n"), F.col(f"{column}.length").cast("long").alias("total"))
    return found.agg(*[F.coalesce(F.sum(f"n.{x}"), F.lit(0)).alias(x) for x in "acgt"], F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def base_counting(df: DataFrame, column: str = "packed") -> DataFrame:
    """count_a to count_t, count_n (always 0: packing keeps four letters), total."""
    return _sums(df, column).select(*[F.col(x).alias(f"count_{x}") for x in "acgt"], F.lit(0).cast("long").alias("count_n"), "total")


def gc_content(df: DataFrame, column: str = "packed") -> DataFrame:
    t = _sums(df, column).withColumn("gc", F.col("g") + F.col("c"))
    return t.select(F.col("gc").alias("count_gc"), F.col("total").alias("total_bases"), S.percent(F.col("gc"), F.col("total")).alias("gc_percent"))


def at_content(df: DataFrame, column: str = "packed") -> DataFrame:
    t = _sums(df, column).withColumn("at", F.col("a") + F.col("t"))
    return t.select(F.col("at").alias("at_count"), F.col("total").alias("total_bases"), S.percent(F.col("at"), F.col("total")).alias("at_percent"))


def sequence_length(df: DataFrame, column: str = "packed") -> DataFrame:
    """Lengths from the structs; the bytes are not read."""
    n = F.col(f"{column}.length").cast("long")
    t = df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_length"), F.count("*").alias("num_sequences"), F.coalesce(F.min(n), F.lit((1 << 63) - 1)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"))
    return t.withColumn("mean_length", S.mean(F.col("total_length"), F.col("num_sequences")))


def reverse_complement(df: DataFrame, column: str = "packed") -> DataFrame:
    """Ids end in _revcomp; the sequence stays packed."""
    return df.select(F.concat("id", F.lit("_revcomp")).alias("id"), P.reverse_complement(F.col(column)).alias(column))
