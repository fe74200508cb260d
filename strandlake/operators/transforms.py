"""Operators that return reads: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import vectors as V
from ..schema import ADAPTER, ADAPTER_OVERLAP, MASK_BELOW


def reverse_complement(df: DataFrame) -> DataFrame:
    """Ids end in _revcomp; quality is dropped."""
    return df.select(F.concat("id", F.lit("_revcomp")).alias("id"), V.reverse_complement(F.col("sequence")).alias("sequence"), F.lit(None).cast("string").alias("quality"))


def sequence_masking(df: DataFrame, below: int = MASK_BELOW) -> DataFrame:
    """N where the quality byte is below the threshold; a quality of another length than the sequence is an error."""
    return df.select("id", V.masked(F.col("sequence"), F.col("quality"), below).alias("sequence"), "quality")


def masking_stats(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Bases that became N; masked holds the same reads after masking, in any order and with any ids.

    Masking turns letters into N and never back, so these are the N that masking has added: one sum over each table, and
    no join, in which a repeated id would meet itself.
    """
    n = F.length("sequence") - F.length(F.replace("sequence", F.lit("N"), F.lit("")))
    sums = lambda df: df.agg(F.coalesce(F.sum(S.total_bases(F.col("sequence"))), F.lit(0)).alias("total_bases"), F.coalesce(F.sum(n), F.lit(0)).alias("_n"))
    before, after = sums(original), sums(masked).select(F.col("_n").alias("_after"))
    t = before.join(F.broadcast(after)).select("total_bases", (F.col("_after") - F.col("_n")).alias("masked_bases"))
    return t.withColumn("masked_percentage", S.percent(F.col("masked_bases"), F.col("total_bases")))


def adapter_trimming(df: DataFrame, adapter: str = ADAPTER, overlap: int = ADAPTER_OVERLAP, least: int = 0) -> DataFrame:
    """Cuts a read at the first occurrence, anywhere, of the adapter's first `overlap` letters.

    Cut reads shorter than `least` are dropped; others pass whatever their length.
    """
    if not 3 <= overlap <= len(adapter):
        raise ValueError("overlap must be from 3 to the adapter's length")
    at = df.withColumn("_at", S.trim_position(F.col("sequence"), adapter, overlap)).where((F.col("_at") == 0) | (F.col("_at") - 1 >= least))
    cut = lambda c: F.when(F.col("_at") > 0, F.substring(c, F.lit(1), F.col("_at") - 1)).otherwise(F.col(c)).alias(c)
    return at.select(F.when(F.col("_at") > 0, F.concat("id", F.lit("_trimmed"))).otherwise(F.col("id")).alias("id"), cut("sequence"), cut("quality"))


def translation(df: DataFrame, frame: int = 0, least: int = 1) -> DataFrame:
    """Protein of one forward frame up to the first stop; ids end in _frame<f>; quality is dropped."""
    if frame not in (0, 1, 2):
        raise ValueError("frame must be 0, 1 or 2")
    proteins = df.select(F.concat("id", F.lit(f"_frame{frame}")).alias("id"), V.translated(F.col("sequence"), frame).alias("sequence"), F.lit(None).cast("string").alias("quality"))
    return proteins.where(F.length("sequence") >= least)


def with_default_quality(df: DataFrame) -> DataFrame:
    """`?` for every base of a read without quality."""
    return df.withColumn("quality", F.coalesce("quality", F.expr("repeat('?', length(sequence))")))
