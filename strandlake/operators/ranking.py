"""Places in a total order, found without a task that holds all rows or all rows of a group.

Rows are sorted over ranges, each range numbers its own rows, and the rows of the ranges before it are added: one count
for each range. The sorted rows are checkpointed, so that numbers and counts come from the same ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Bits of `monotonically_increasing_id` below the number of the partition.
_LOW = 33


def ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in a total order over ranges, checkpointed, with `_range` and the place in it, `_in`, from 0.

    Equal rows may lie in several ranges: the last key of the order is the place in the input.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.orderBy(*order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    frozen = checkpointed(placed)
    return frozen.select(*df.columns, F.shiftright("_id", _LOW).cast("int").alias("_range"), F.col("_id").bitwiseAND((1 << _LOW) - 1).alias("_in"))


def on_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which nulls are equal, as they are in groups; the right side's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_on_{k}"]) for k in keys], F.lit(True))
    return left.join(named, condition, how).drop(*[f"_on_{k}" for k in keys])


def before(ranges: DataFrame, groups: list[str], **sums: Column) -> DataFrame:
    """For each group and range, the sums over the group's rows in the ranges before; a row for each group of a range."""
    parts = ranges.groupBy(*groups, "_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*groups, "_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums])


def running(df: DataFrame, groups: list[str], order: list[Column | str], **sums: Column) -> DataFrame:
    """Adds running sums, each row's own value included, in an order within groups; equal rows follow each other anyhow.

    A group of any size is spread over ranges: a window holds what one range has of a group.
    """
    ranges = ranged(df, [*groups, *order])
    own = W.partitionBy(*groups, "_range").orderBy("_in").rowsBetween(W.unboundedPreceding, 0)
    inside = ranges.select("*", *[F.sum(c).over(own).alias(f"_own_{k}") for k, c in sums.items()])
    starts = before(ranges, groups, **{f"_before_{k}": c for k, c in sums.items()})
    added = [(F.coalesce(f"_own_{k}", F.lit(0)) + F.col(f"_before_{k}")).alias(k) for k in sums]
    return on_groups(inside, starts, [*groups, "_range"]).select(*df.columns, *added)


def numbered(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in a total order of all rows. Rows with equal keys follow each other anyhow.

    The sort samples its input first, so an input that is dear to make should be checkpointed by the caller.
    """
    ranges = ranged(df, order)
    counts = before(ranges, [], _before=F.lit(1))
    return ranges.join(F.broadcast(counts), "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in the order in which the input gives its rows; they are not sorted or moved."""
    frozen = checkpointed(df.withColumn("_id", F.monotonically_increasing_id()))
    ranges = frozen.select(*df.columns, F.shiftright("_id", _LOW).cast("int").alias("_range"), F.col("_id").bitwiseAND((1 << _LOW) - 1).alias("_in"))
    counts = before(ranges, [], _before=F.lit(1))
    return ranges.join(F.broadcast(counts), "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))
