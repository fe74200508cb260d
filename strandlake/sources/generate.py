"""Synthetic reads. Every value is a hash of seed, read and position, so a task that runs again makes the same reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUALITIES = ("uniform_high", "degrading", "realistic", "uniform_range")


def _draw(*parts: Column | int | str) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def _normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(1 - _draw(*parts, "r"))) * F.cos(_draw(*parts, "a") * 6.283185307179586)


def _text(n: Column, letter) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), "")


def generate_reads(spark: SparkSession, n: int, mean: int = 150, deviation: float = 10.0, quality: str | None = "degrading", seed: int = 1, partitions: int | None = None) -> DataFrame:
    """ord and reads with lengths near mean (50 to 2 * mean), uniform bases and a quality model; None for FASTA."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    i = F.col("id")
    length = F.greatest(F.lit(50), F.least(F.lit(2 * mean), F.round(_normal(i, seed, "length") * deviation + mean))).cast("int")
    sized = rows.select(i.alias("ord"), F.concat(F.lit("seq_"), i.cast("string")).alias("id"), length.alias("_n"))
    o, size = F.col("ord"), F.col("_n")
    base = lambda p: F.substring(F.lit("ACGT"), F.floor(_draw(o, p, seed, "base") * 4).cast("int") + 1, F.lit(1))
    drop = lambda p: _draw(o, p, seed, "drop") < 0.05
    spread = lambda p, k: F.floor(_draw(o, p, seed, "quality") * k)
    code = {
        "uniform_high": lambda p: F.lit(73),
        "degrading": lambda p: F.floor(F.lit(40) - p * 20 / size) + 33,
        "realistic": lambda p: F.when(drop(p), spread(p, 10) + 53).otherwise(spread(p, 6) + 68),
        "uniform_range": lambda p: spread(p, 41) + 33,
    }
    if quality is None:
        values = F.lit(None).cast("string")
    else:
        values = _text(size, lambda p: F.chr(code[quality](p).cast("int")))
    return sized.select("ord", "id", _text(size, base).alias("sequence"), values.alias("quality"))


def generate_fixed(spark: SparkSession, n: int, length: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """ord and reads of one length, uniform bases, quality bytes from 33 to 73."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    o, size = F.col("id"), F.lit(length)
    base = lambda p: F.substring(F.lit("ACGT"), F.floor(_draw(o, p, seed, "base") * 4).cast("int") + 1, F.lit(1))
    code = lambda p: F.chr((F.floor(_draw(o, p, seed, "quality") * 41) + 33).cast("int"))
    return rows.select(o.alias("ord"), F.concat(F.lit("seq_"), o.cast("string")).alias("id"), _text(size, base).alias("sequence"), _text(size, code).alias("quality"))
