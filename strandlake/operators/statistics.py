"""Robust statistics, effect sizes, bounds and trends over measurement tables.

Statistics by index count the distinct values of a group first, and find an index in the running count over ranges (see
ranking.py); no group's values are ever collected into one row or one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import on_groups, running

#: Critical values of Student's t for 95 %, by least degrees of freedom. Fixed values.
T_CRITICAL = {0: 2.776, 5: 2.262, 10: 2.145, 15: 2.093, 20: 2.064, 25: 2.045, 30: 2.021, 40: 2.009, 50: 1.984, 100: 1.96}


def t_critical(df: Column, alpha: float = 0.05) -> Column:
    """A step table for alpha 0.05; 2.0 for any other."""
    if alpha != 0.05:
        return F.lit(2.0)
    bounds = sorted(T_CRITICAL)
    out = F.lit(T_CRITICAL[bounds[0]])
    for b in bounds[1:]:
        out = F.when(df >= b, T_CRITICAL[b]).otherwise(out)
    return out


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Groups, `_v` and `_n`: how often each value occurs; counted before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))


def at_ranks(counts: DataFrame, groups: list[str], **ranks: Column) -> DataFrame:
    """A row for each group of value counts: `_total`, and the values at 0-based indexes of the sorted values.

    An index is an expression over `_total`. A group's values are sorted over ranges, so no task has to hold a group.
    """
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    placed = on_groups(running(counts, groups, ["_v"], _end=F.col("_n")), totals, groups)
    return placed.groupBy(*groups).agg(F.first("_total").alias("_total"), *[F.min(F.when(F.col("_end") > r, F.col("_v"))).alias(k) for k, r in ranks.items()])


def rank_of(share: float) -> Column:
    """floor(n * share), the index that picks without interpolation."""
    return F.floor(F.col("_total") * F.lit(int(round(share * 100))) / 100)


def nearest_ranks(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The elements of each group's sorted values at floor(n * share)."""
    return at_ranks(value_counts(df, groups, value), groups, **{k: rank_of(s) for k, s in shares.items()}).drop("_total")


def without_outliers(counts: DataFrame, groups: list[str], threshold: float = 1.5) -> DataFrame:
    """Value counts within threshold * IQR of the quartiles by index, with `_all`; groups under four pass whole."""
    bounds = at_ranks(counts, groups, _low=rank_of(0.25), _high=rank_of(0.75))
    room = (F.col("_high") - F.col("_low")) * threshold
    inside = (F.col("_total") < 4) | ((F.col("_v") >= F.col("_low") - room) & (F.col("_v") <= F.col("_high") + room))
    return on_groups(counts, bounds, groups).where(inside).select(*groups, "_v", "_n", F.col("_total").alias("_all"), F.col("_low").alias("_shift"))


def summary(df: DataFrame, groups: list[str], value: str, threshold: float = 1.5) -> DataFrame:
    """Statistics of each group's values after outlier removal: centre, spread, quartiles by index and 95 % interval.

    A group with under three values left has null statistics.
    """
    kept = without_outliers(value_counts(df, groups, value), groups, threshold)
    half = F.floor(F.col("_total") / 2)
    ranks = at_ranks(kept, groups, _below=F.floor((F.col("_total") - 1) / 2), _above=half, q1=rank_of(0.25), q3=rank_of(0.75))
    # Deviations from a value of the group, so that the squares stay small.
    apart = F.col("_v") - F.col("_shift")
    sums = kept.groupBy(*groups).agg(
        F.sum("_n").alias("n_valid"), F.first("_all").alias("_all"), F.first("_shift").alias("_shift"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.sum(apart * F.col("_n")).alias("_s"), F.sum(apart * apart * F.col("_n")).alias("_ss"),
    )
    n = F.col("n_valid")
    full = on_groups(sums, ranks, groups).withColumn("mean", F.col("_shift") + F.col("_s") / n)
    full = full.withColumn("std_dev", F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("_ss") - F.col("_s") * F.col("_s") / n), n - 1)))
    full = full.withColumn("median", (F.col("_below") + F.col("_above")) / 2).withColumn("_margin", t_critical(n - 1) * F.col("std_dev") / F.sqrt(n))
    full = full.withColumn("ci_lower", F.col("mean") - F.col("_margin")).withColumn("ci_upper", F.col("mean") + F.col("_margin"))
    fields = ("median", "mean", "std_dev", "min", "max", "q1", "q3", "ci_lower", "ci_upper")
    return full.select(*groups, *[F.when(n >= 3, F.col(k)).alias(k) for k in fields], "n_valid", (F.col("_all") - n).alias("n_outliers"))


def trimmed_mean(df: DataFrame, groups: list[str], value: str, sigmas: float = 3.0) -> DataFrame:
    """Mean of the values within `sigmas` population deviations of the mean; the plain mean if none is."""
    centre = df.groupBy(*groups).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_spread"))
    marked = on_groups(df, centre, groups).withColumn("_near", F.abs(F.col(value) - F.col("_mean")) <= F.col("_spread") * sigmas)
    return marked.groupBy(*groups).agg(F.coalesce(F.avg(F.when(F.col("_near"), F.col(value))), F.avg(value)).alias("trimmed_mean"), F.count_if(F.col("_near")).alias("n_kept"))


def cohens_d(mean_a: Column, mean_b: Column, deviation: Column) -> Column:
    """Difference of means over one deviation; 0 where that is 0."""
    return F.coalesce(F.try_divide(mean_a - mean_b, deviation), F.lit(0.0))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def t_statistic(df: DataFrame, groups: list[str], value: str, expected: float = 1.0) -> DataFrame:
    """One-sample t of each group's mean against an expected value, and its two-sided p; null for under two values."""
    t = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_dev"), F.count(value).alias("n"))
    t = t.withColumn("t", F.try_divide((F.col("mean") - expected) * F.sqrt("n"), F.col("std_dev")))
    return t.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1))


def t_p_value(t: Column, degrees: Column) -> Column:
    """The two-sided p of a t: the regularised incomplete beta of degrees / (degrees + t^2); null without degrees."""
    x = degrees / (degrees + t * t)
    return F.when((degrees > 0) & t.isNotNull(), incomplete_beta(degrees.cast("double") / 2, F.lit(0.5), x))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction, a whole batch of rows at a time.

    The fraction converges fast for x under (a + 1) / (a + b + 2); beyond, that of 1 - x is taken, from 1.
    """

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, x: pa.Array) -> pa.Array:
        p, q, at = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in (a, b, x))
        with np.errstate(all="ignore"):
            swap = at > (p + 1) / (p + q + 2)
            p, q, at = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - at, at)
            log_beta = np.array([math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v) if u > 0 and v > 0 else np.nan for u, v in zip(p.tolist(), q.tolist(), strict=True)])
            front = np.exp(p * np.log(at) + q * np.log1p(-at) - log_beta) / p
            found = np.where(at <= 0, 0.0, front * beta_fraction(p, q, at))
        return pa.array(np.where(swap, 1 - found, found), mask=np.isnan(found))

    return run(a, b, x)


#: Terms of the fraction, and how near 1 the last factor has to be.
TERMS, NEAR = 10_000, 1e-15


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / (1 + d1 / (1 + d2 / ...)), from the front, with the ratios of successive numerators and denominators."""
    tiny = 1e-300

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    total = upper = np.ones_like(x)
    lower = 1 / safe(1 - (a + b) * x / (a + 1))
    total = lower.copy()
    for m in range(1, TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for d in (even, odd):
            lower, upper = 1 / safe(1 + d * lower), safe(1 + d / upper)
            factor = lower * upper
            total = total * factor
        if not np.any(np.abs(factor - 1) > NEAR):
            break
    return total


def amdahl_bound(serial_share: Column, factor: float = 20.0) -> Column:
    """Greatest total speedup when all but the serial share runs `factor` times faster."""
    return 1 / (serial_share + (1 - serial_share) / factor)


def overhead_percent(total: Column, part: Column) -> Column:
    return F.coalesce(F.try_divide((total - part) * 100, total), F.lit(0.0))


def expected_parallel(complexity: Column) -> Column:
    """Expected parallel speedup by complexity, a step function. Fixed values."""
    return F.when(complexity < 0.30, 2.0).when(complexity < 0.45, 3.5).otherwise(5.0)


def composition_ratio(actual: Column, single: Column, complexity: Column) -> Column:
    """Measured speedup over the product of the single-thread and the expected parallel speedup."""
    return F.try_divide(actual, single * expected_parallel(complexity))


def energy(milliwatts: Column, seconds: Column, reads: Column) -> Column:
    """Watts, watt-hours and microwatt-hours for each read, as a struct."""
    watts = milliwatts / 1000
    wh = watts * seconds / 3600
    return F.struct(watts.alias("watts"), wh.alias("energy_wh"), F.coalesce(F.try_divide(wh * 1e6, reads), F.lit(0.0)).alias("energy_per_seq_uwh"))


def efficiency(time_before: Column, time_after: Column, energy_before: Column, energy_after: Column) -> Column:
    """Time speedup, energy speedup and their ratio, as a struct; above 1 the gain in time costs less energy than it saves."""
    time, power = F.try_divide(time_before, time_after), F.try_divide(energy_before, energy_after)
    return F.struct(time.alias("time_speedup"), power.alias("energy_speedup"), F.try_divide(time, power).alias("efficiency"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation matrix as rows (a, b, correlation), from one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[(F.lit(1.0) if a == b else F.corr(a, b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("correlation")) for i, (a, b) in enumerate(pairs)])))


def mean_of_ratios(df: DataFrame, groups: list[str], label: str, above: str, below: str, value: str, within: list[str]) -> DataFrame:
    """The ratio of two labels' mean values in each of the finer groups (groups and within), then its mean in the groups."""
    side = lambda name: F.avg(F.when(F.col(label) == name, F.col(value)))
    ratios = df.groupBy(*groups, *within).agg(F.try_divide(side(above), side(below)).alias("_ratio"))
    return ratios.groupBy(*groups).agg(F.avg("_ratio").alias("mean_ratio"), F.count("_ratio").alias("n_ratios"))


def trend(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line, its R squared and the correlation."""
    return df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("correlation"), F.count("*").alias("n"))


def within_tolerance(error: Column, actual: Column, share: float) -> Column:
    """The fraction of rows whose absolute error is within a share of the actual value."""
    return F.avg((F.abs(error) <= F.abs(actual) * share).cast("int"))


def vector_effective(complexity: Column) -> Column:
    return complexity < 0.45


def gpu_candidate(complexity: Column) -> Column:
    return ~vector_effective(complexity) & (complexity > 0.55)


def prune(df: DataFrame, keys: list[str], order: str, speedup: str, least: float = 1.5) -> DataFrame:
    """Marks what an adaptive run would skip: all that follows the first measurement under the least speedup."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("pruned", F.coalesce(F.min(speedup).over(before) < least, F.lit(False)))


def prune_gains(df: DataFrame, keys: list[str], order: str, speedup: str, least: float = 1.3) -> DataFrame:
    """Marks the steps (more threads) after the first one that gained less than `least` over the step before it."""
    steps = W.partitionBy(*keys).orderBy(order)
    gained = df.withColumn("gain", F.try_divide(F.col(speedup), F.lag(speedup).over(steps)))
    return gained.withColumn("pruned", F.coalesce(F.min("gain").over(steps.rowsBetween(W.unboundedPreceding, -1)) < least, F.lit(False)))


def least_with_benefit(df: DataFrame, keys: list[str], order: str, speedup: str, least: float = 1.0) -> DataFrame:
    """For each key the smallest scale whose speedup is over `least`, and that speedup; null where none is."""
    useful = F.col(speedup) > least
    return df.groupBy(*keys).agg(F.min(F.when(useful, F.col(order))).alias(f"least_{order}"), F.min_by(F.when(useful, F.col(speedup)), F.when(useful, F.col(order))).alias("benefit"))
