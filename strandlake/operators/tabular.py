"""Joins and groupings over experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import running


def experiments(operations: DataFrame, configs: DataFrame, scales: DataFrame) -> DataFrame:
    """Every implemented operation with every config and scale, numbered exp_000000 onwards.

    The tables are dimensions of a few rows; their product is the plan of a benchmark, not data.
    """
    every = operations.where("implemented").select("operation").crossJoin(configs).crossJoin(scales)
    number = F.row_number().over(W.orderBy("operation", *configs.columns, *scales.columns)) - 1
    return every.withColumn("experiment_id", F.concat(F.lit("exp_"), F.lpad(number.cast("string"), 6, "0")))


def pending(planned: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return planned.join(completed.select(key), key, "left_anti")


def save_checkpoint(completed: DataFrame, key: str, path: str) -> None:
    """The distinct keys of what is done, as JSON lines; replaces the checkpoint before."""
    completed.select(key).distinct().write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"{key} {kind}").json(path)


def lookup(facts: DataFrame, dimension: DataFrame, key: str, probe: str) -> DataFrame:
    """Facts with their dimension row; a fact without one is an error, raised when the row is read."""
    found = facts.join(dimension.withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn(probe, F.when(F.col("_found"), F.col(probe)).otherwise(F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(found.schema[probe].dataType))).drop("_found")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last")).select(*keys, "_last.*")


def baseline_ratio(df: DataFrame, groups: list[str], label: str, baseline: str, value: str, missing: float | None = 1.0) -> DataFrame:
    """Each row's value over its group's baseline row, by one window instead of a self-join.

    Without a baseline the ratio is `missing`; None lets such groups pass with a null ratio.
    """
    base = F.max(F.when(F.col(label) == baseline, F.col(value))).over(W.partitionBy(*groups))
    return df.withColumn("ratio", F.coalesce(F.try_divide(F.col(value), base), F.lit(missing).cast("double")))


def interval_join(samples: DataFrame, windows: DataFrame, time: str, start: str, seconds: str, key: str, value: str) -> DataFrame:
    """Mean and count of the samples in each window's closed range [start, start + seconds]; 0.0 and 0 without any.

    Samples and the windows' ends are put in one order of time, and a window's sums are those that run up to its end less
    those that run up to its start. So no sample meets a window: the work doesn't grow with what windows hold, and no
    moment, however crowded, has to fit into a task. Sums are exact: of integers, or of decimals with nine places.
    """
    end = F.col(start) + F.col(seconds)
    exact = "long" if samples.schema[value].dataType.typeName() in ("byte", "short", "integer", "long") else "decimal(28,9)"
    none = F.lit(None).cast(exact)
    real = windows.where((F.col(seconds) >= 0) & F.col(key).isNotNull())
    at = lambda c: c.cast("double").alias("_at")
    # A window's start comes before samples of its moment, its end after them.
    moments = (
        samples.select(at(F.col(time)), F.lit(1).alias("_kind"), F.lit(None).cast(windows.schema[key].dataType).alias("_key"), F.col(value).cast(exact).alias("_value"))
        .unionByName(real.select(at(F.col(start)), F.lit(0).alias("_kind"), F.col(key).alias("_key"), none.alias("_value")))
        .unionByName(real.select(at(end), F.lit(2).alias("_kind"), F.col(key).alias("_key"), none.alias("_value")))
        .where("_at is not null")
    )
    sample = (F.col("_kind") == 1).cast("long")
    sums = running(moments, [], ["_at", "_kind"], _n=sample, _valued=F.col("_value").isNotNull().cast("long"), _sum=F.coalesce(F.col("_value"), F.lit(0).cast(exact)))
    signed = lambda c: F.sum(F.when(F.col("_kind") == 2, F.col(c)).otherwise(-F.col(c)))
    met = sums.where("_kind <> 1").groupBy(F.col("_key").alias(key)).agg(F.try_divide(signed("_sum").cast("double"), signed("_valued")).alias("mean_value"), signed("_n").alias("num_samples"))
    return windows.join(met, key, "left").withColumn("mean_value", F.coalesce("mean_value", F.lit(0.0))).withColumn("num_samples", F.coalesce("num_samples", F.lit(0).cast("long")))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of two tables on the same keys, with their ratio; unmatched rows are dropped."""
    both = a.select(*keys, F.col(value).alias(f"{value}_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b")), keys)
    return both.withColumn("ratio", F.try_divide(F.col(f"{value}_a"), F.col(f"{value}_b")))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list[str], agg: Column) -> DataFrame:
    """One column for each named value, so that no job has to look for them."""
    return df.groupBy(*rows).pivot(column, values).agg(agg)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_by_group(df: DataFrame, groups: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def best_of(df: DataFrame, groups: list[str], label: str, value: str) -> DataFrame:
    """The label with the greatest value of each group, and that value."""
    return df.groupBy(*groups).agg(F.max_by(label, value).alias(f"best_{label}"), F.max(value).alias(f"best_{value}"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by a custom order of categories; unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def with_last_seen(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Fills a column with the last value that was present, within each group."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
