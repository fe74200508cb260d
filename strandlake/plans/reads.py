"""Deterministic reads derived from the orders table, equal in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
#: Letters that the hexadecimal digits of a checksum stand for. Fixed values.
CLEAN, MIXED, QUALITY = "ACGTACGTACGTACGN", "ACGTNRYSWKMacgtn", "!%)-159=AEIJ7;?3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(first: str, second: str, alphabet: str) -> Column:
    key = F.col("o_orderkey").cast("string")
    return F.translate(F.concat(F.md5(F.concat(F.lit(first), key)), F.md5(F.concat(F.lit(second), key))), HEX, alphabet)


def reads_of(orders: DataFrame) -> DataFrame:
    """ord and 64-letter reads with some N."""
    return orders.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("seq_"), F.col("o_orderkey").cast("string")).alias("id"),
        _letters("s", "t", CLEAN).alias("sequence"), _letters("q", "r", QUALITY).alias("quality"),
    )


def mixed_of(orders: DataFrame) -> DataFrame:
    """ord and reads of 1 to 64 letters, lower case and ambiguity codes among them; every tenth without quality."""
    size = (F.col("o_orderkey") % 64 + 1).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("seq_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.substring(_letters("s", "t", MIXED), F.lit(1), size).alias("sequence"),
        F.when(F.col("o_orderkey") % 10 != 0, F.substring(_letters("q", "r", QUALITY), F.lit(1), size)).alias("quality"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(table(spark, sf_dir, "orders"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_of(table(spark, sf_dir, "orders"))


def with_adapter(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    """Reads with an adapter spliced in after 1 to 40 letters; every third without."""
    at = (F.col("ord") % 40 + 1).cast("int")
    cut = F.concat(F.substring("sequence", F.lit(1), at), F.lit(adapter), F.substring("sequence", at + 1, F.lit(64)))
    return reads(spark, sf_dir).withColumn("sequence", F.when(F.col("ord") % 3 != 0, F.substring(cut, 1, 64)).otherwise(F.col("sequence")))


def _sql(first: str, second: str, alphabet: str) -> str:
    key = "cast(o_orderkey AS varchar)"
    return f"translate(concat(md5(concat('{first}', {key})), md5(concat('{second}', {key}))), '{HEX}', '{alphabet}')"


READS_SQL = f"reads AS (SELECT o_orderkey AS ord, concat('seq_', cast(o_orderkey AS varchar)) AS id, {_sql('s', 't', CLEAN)} AS sequence, {_sql('q', 'r', QUALITY)} AS quality FROM orders)"
MIXED_SQL = (
    "reads AS (SELECT o_orderkey AS ord, concat('seq_', cast(o_orderkey AS varchar)) AS id, "
    f"substring({_sql('s', 't', MIXED)}, 1, 1 + o_orderkey % 64) AS sequence, "
    f"CASE WHEN o_orderkey % 10 <> 0 THEN substring({_sql('q', 'r', QUALITY)}, 1, 1 + o_orderkey % 64) END AS quality FROM orders)"
)


def adapter_sql(adapter: str) -> str:
    return (
        READS_SQL.replace("reads AS", "plain AS", 1)
        + ", reads AS (SELECT ord, id, CASE WHEN ord % 3 <> 0 THEN substring(concat(substring(sequence, 1, 1 + ord % 40), "
        f"'{adapter}', substring(sequence, 2 + ord % 40, 64)), 1, 64) ELSE sequence END AS sequence, quality FROM plain)"
    )
