"""Element-wise counting: one projection and one partial/final aggregation; several operators share a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.vectors import byte_counts, complexity, count_among, read_sums


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def _parts(prefix: str = "") -> dict[str, Column]:
    s = F.col("sequence")
    return {prefix + k: v for k, v in {
        "a": S.count_of(s, "A"), "c": S.count_of(s, "C"), "g": S.count_of(s, "G"), "t": S.count_of(s, "T"), "n": S.count_of(s, "N"),
        "iupac": S.count_of(s, S.AMBIGUOUS), "total": S.total_bases(s),
    }.items()}


_CLASSES = {"a": "A", "c": "C", "g": "G", "t": "T", "n": "N", "iupac": S.AMBIGUOUS, "total": None}


def _sums(df: DataFrame, *names: str) -> DataFrame:
    """Totals over all reads, from one pass over the bytes of each batch."""
    return byte_counts(df, "sequence").agg(*[count_among(_CLASSES[n]).alias(n) for n in names])


def base_counting(df: DataFrame) -> DataFrame:
    """Counts of A, C, G, T, N in either case, and of all bytes."""
    t = _sums(df, "a", "c", "g", "t", "n", "total")
    return t.select(*[F.col(x).alias(f"count_{x}") for x in "acgtn"], "total")


def gc_content(df: DataFrame) -> DataFrame:
    """The percentage leaves N, and only N, out of the denominator."""
    t = _sums(df, "a", "c", "g", "t", "n", "total").withColumn("gc", F.col("g") + F.col("c"))
    return t.select(
        F.col("g").alias("count_g"), F.col("c").alias("count_c"), F.col("gc").alias("count_gc"), (F.col("a") + F.col("t")).alias("count_at"),
        F.col("n").alias("count_n"), F.col("total").alias("total_bases"), S.percent(F.col("gc"), F.col("total") - F.col("n")).alias("gc_percent"),
    )


def at_content(df: DataFrame) -> DataFrame:
    """The percentage is of all bytes."""
    t = _sums(df, "a", "t", "total").withColumn("at", F.col("a") + F.col("t"))
    return t.select(F.col("at").alias("at_count"), F.col("total").alias("total_bases"), S.percent(F.col("at"), F.col("total")).alias("at_percent"))


def n_content(df: DataFrame) -> DataFrame:
    t = _sums(df, "a", "c", "g", "t", "n", "iupac", "total").withColumn("acgt", F.col("a") + F.col("c") + F.col("g") + F.col("t"))
    return t.select(
        F.col("n").alias("count_n"), F.col("acgt").alias("count_acgt"), F.col("iupac").alias("count_ambiguous"),
        (F.col("total") - F.col("n") - F.col("acgt") - F.col("iupac")).alias("count_other"), F.col("total").alias("total_bases"),
        S.percent(F.col("n"), F.col("total")).alias("n_percent"),
    )


#: Least length of no reads at all.
NO_MINIMUM = (1 << 63) - 1


def sequence_length(df: DataFrame) -> DataFrame:
    """Without reads, min_length is the largest BIGINT and max_length 0."""
    n = S.total_bases(F.col("sequence"))
    t = df.agg(_sum(n).alias("total_length"), F.count("*").alias("num_sequences"), F.coalesce(F.min(n), F.lit(NO_MINIMUM)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_length"))
    return t.withColumn("mean_length", S.mean(F.col("total_length"), F.col("num_sequences")))


def complexity_score(df: DataFrame) -> DataFrame:
    scored = df.select(complexity(F.col("sequence")).alias("x"))
    return scored.agg(
        F.count("*").alias("total_sequences"), F.count_if(F.col("x") < 0.4).alias("low_complexity_count"), F.count_if(F.col("x") > 0.7).alias("high_complexity_count"),
        F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean_complexity"),
    )


def per_read(df: DataFrame) -> DataFrame:
    """The counts of each read instead of their totals."""
    return df.select("id", *[v.alias(k) for k, v in _parts("n_").items()], S.complexity(F.col("sequence")).alias("complexity"))


def qc_report(df: DataFrame) -> DataFrame:
    """Base counts, GC, AT and N percentages, lengths, complexity and mean quality from one pass over each batch's bytes."""
    sums = read_sums(df, {k: v for k, v in _CLASSES.items() if k in "acgtn"})
    added = ("num_sequences", "total", "low", "q", "nq", *"acgtn")
    t = sums.agg(*[_sum(F.col(k)).alias(k) for k in added], F.coalesce(F.min("min_length"), F.lit(NO_MINIMUM)).alias("min_length"), F.coalesce(F.max("max_length"), F.lit(0)).cast("long").alias("max_length"))
    return t.select(
        "num_sequences", F.col("total").alias("total_bases"), *[F.col(x).alias(f"count_{x}") for x in "acgtn"], "min_length", "max_length", F.col("low").alias("low_complexity_count"),
        S.percent(F.col("g") + F.col("c"), F.col("total") - F.col("n")).alias("gc_percent"), S.percent(F.col("a") + F.col("t"), F.col("total")).alias("at_percent"),
        S.percent(F.col("n"), F.col("total")).alias("n_percent"), S.mean(F.col("q"), F.col("nq")).alias("mean_quality"),
    )


def dataset_characteristics(df: DataFrame) -> DataFrame:
    """Metadata of a reads table: size, lengths, format and size class."""
    n = S.total_bases(F.col("sequence"))
    t = df.agg(F.count("*").alias("num_sequences"), _sum(n).alias("total_bases"), F.count("quality").alias("q"))
    return t.select("num_sequences", "total_bases", F.when(F.col("q") > 0, "fastq").otherwise("fasta").alias("format"), S.scale_category(F.col("num_sequences")).alias("scale_category"))


#: Bytes that an encoding takes for a base. Fixed values.
BYTES_PER_BASE = {"ascii": 1.0, "two_bit": 0.25, "two_bit_extended": 0.25, "four_bit": 0.5}
