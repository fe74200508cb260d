"""Registered queries of the tabular family and of streaming, each with the SQL that it is compared with.

The experiment tables of the operators are played by the driver's tables: a measurement is an order's price, an
operation its priority, a configuration its status, a scale its year, a power sample an event's value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as X
from ..operators import tabular as T
from ..sources import tables
from ..streaming import pipelines as P
from .reads import READS_SQL, reads_of, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda t: table(spark, sf_dir, t))
            return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def _fixed(x, places: int):
    """Rounds with the same arithmetic in both engines; ties, which exact fractions give, are moved off the edge."""
    scale = 10.0**places
    return F.floor(x * scale + 0.501) / scale


def _fixed_sql(x: str, places: int) -> str:
    return f"floor({x} * {10.0**places} + 0.501) / {10.0**places}"


def measurements(t) -> DataFrame:
    """(operation, config, scale, value), many rows for each key."""
    return t("orders").select(F.col("o_orderpriority").alias("operation"), F.col("o_orderstatus").alias("config"), F.year("o_orderdate").alias("scale"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("run"))


_M = "m AS (SELECT o_orderpriority AS operation, o_orderstatus AS config, year(o_orderdate)::INTEGER AS scale, o_totalprice AS value, o_orderkey AS run FROM orders)"


def _means(t) -> DataFrame:
    """One mean for each key, in cents, so that the order of summation doesn't matter."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return measurements(t).groupBy("operation", "config", "scale").agg((cents / F.count("*")).alias("value"))


_MEANS = f"{_M}, a AS (SELECT operation, config, scale, sum(round(value * 100)::BIGINT)::DOUBLE / count(*) AS value FROM m GROUP BY ALL)"

query("distinct_keys", f"WITH {_M} SELECT DISTINCT operation, config, scale FROM m")(lambda t: measurements(t).select("operation", "config", "scale").distinct())
query("group_counts", f"WITH {_M} SELECT operation, scale, count(*) AS n, min(value) AS min_value, max(value) AS max_value, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM m GROUP BY ALL")(
    lambda t: measurements(t).groupBy("operation", "scale").agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
)
query(
    "experiments_cross",
    f"WITH {_M}, o AS (SELECT operation, count(*) >= 10 AS implemented FROM m GROUP BY 1), c AS (SELECT DISTINCT config FROM m), s AS (SELECT DISTINCT scale FROM m) SELECT operation, config, scale, concat('exp_', lpad(cast(row_number() OVER (ORDER BY operation, config, scale) - 1 AS varchar), 6, '0')) AS experiment_id FROM o, c, s WHERE implemented",
)(lambda t: T.experiments(measurements(t).groupBy("operation").agg((F.count("*") >= 10).alias("implemented")), measurements(t).select("config").distinct(), measurements(t).select("scale").distinct()))
query("resume_anti", "SELECT o_orderkey AS run, o_custkey AS customer FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")(
    lambda t: T.pending(t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("customer")), t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("run")), "run")
)
query("lookup_join", "SELECT o_orderkey AS run, o_custkey AS customer, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda t: T.lookup(t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("customer")), t("customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name")), "customer", "name").select("run", "customer", "name")
)
query("last_duplicate", f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY operation, config, scale ORDER BY run DESC) AS k FROM m) SELECT operation, config, scale, value, run FROM r WHERE k = 1")(
    lambda t: T.last_of(measurements(t), ["operation", "config", "scale"], "run")
)
query("baseline_speedup", f"WITH {_MEANS}, b AS (SELECT *, max(value) FILTER (config = 'F') OVER (PARTITION BY operation, scale) AS base FROM a) SELECT operation, config, scale, round(value, 6) AS value, round(coalesce(value / nullif(base, 0), 1.0), 6) AS ratio FROM b")(
    lambda t: T.baseline_ratio(_means(t), ["operation", "scale"], "config", "F", "value")
)
query("baseline_pass_through", f"WITH {_MEANS}, b AS (SELECT *, max(value) FILTER (config = 'X') OVER (PARTITION BY operation, scale) AS base FROM a) SELECT operation, config, scale, round(value, 6) AS value, round(value / base, 6) AS ratio FROM b")(
    lambda t: T.baseline_ratio(_means(t), ["operation", "scale"], "config", "X", "value", None)
)
query("platform_join", f"WITH {_MEANS} SELECT x.operation, x.scale, round(x.value, 6) AS value_a, round(y.value, 6) AS value_b, round(x.value / y.value, 6) AS ratio FROM a x JOIN a y USING (operation, scale) WHERE x.config = 'F' AND y.config = 'O'")(
    lambda t: T.compare(_means(t).where("config = 'F'"), _means(t).where("config = 'O'"), ["operation", "scale"], "value")
)
query("merge_suffixes", f"WITH {_MEANS} SELECT x.operation, x.scale, round(x.value, 6) AS value_neon, round(y.value, 6) AS value_naive FROM a x JOIN a y ON x.operation = y.operation AND x.scale = y.scale WHERE x.config = 'F' AND y.config = 'P'")(
    lambda t: _means(t).where("config = 'F'").alias("x").join(_means(t).where("config = 'P'").alias("y"), ["operation", "scale"]).select("operation", "scale", F.col("x.value").alias("value_neon"), F.col("y.value").alias("value_naive"))
)
query("semi_join", "SELECT o_orderkey AS run, o_orderpriority AS operation FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda t: t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("operation"))
)


def _interval(t) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double")
    samples = t("events").select(seconds.alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    windows = t("events").select(F.col("event_id").alias("key"), seconds.alias("start"), (F.col("event_id") % 7 * 100 + 30).cast("double").alias("seconds"))
    return T.interval_join(samples, windows, "at", "start", "seconds", "key", "cents").select("key", "mean_value", "num_samples")


query(
    "interval_join",
    "WITH s AS (SELECT epoch_us(ts) / 1000000.0 AS moment, round(value * 100)::BIGINT AS cents FROM events), w AS (SELECT event_id AS key, epoch_us(ts) / 1000000.0 AS start, (event_id % 7 * 100 + 30)::DOUBLE AS seconds FROM events) SELECT key, round(coalesce(sum(cents)::DOUBLE / nullif(count(cents), 0), 0), 6) AS mean_value, count(cents) AS num_samples FROM w LEFT JOIN s ON moment >= start AND moment <= start + seconds GROUP BY key",
)(_interval)
query("pivot_speedup", f"WITH {_MEANS} SELECT operation, scale, " + ", ".join(f"round(max(value) FILTER (config = '{c}'), 6) AS \"{c}\"" for c in "FOP") + " FROM a GROUP BY operation, scale")(
    lambda t: T.pivoted(_means(t), ["operation", "scale"], "config", ["F", "O", "P"], F.first("value"))
)
query("union_batches", "SELECT 'orders' AS batch, o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'parts' AS batch, p_partkey AS key FROM part UNION ALL SELECT 'suppliers' AS batch, s_suppkey AS key FROM supplier")(
    lambda t: t("orders").where("o_orderstatus = 'F'").select(F.lit("orders").alias("batch"), F.col("o_orderkey").alias("key")).unionByName(t("part").select(F.lit("parts").alias("batch"), F.col("p_partkey").alias("key"))).unionByName(t("supplier").select(F.lit("suppliers").alias("batch"), F.col("s_suppkey").alias("key")))
)
query("top5", f"WITH {_M} SELECT run, value FROM m ORDER BY value DESC, run LIMIT 5")(lambda t: T.top(measurements(t).select("run", "value"), 5, F.desc("value"), F.asc("run")))
query("top_by_group", f"WITH {_M}, r AS (SELECT operation, run, value, row_number() OVER (PARTITION BY operation ORDER BY value DESC, run) AS rank FROM m) SELECT operation, run, value, rank::INTEGER AS rank FROM r WHERE rank <= 3")(
    lambda t: T.top_by_group(measurements(t).select("operation", "run", "value"), ["operation"], 3, F.desc("value"), F.asc("run"))
)
query("best_config", f"WITH {_MEANS} SELECT operation, scale, arg_max(config, value) AS best_config, round(max(value), 6) AS best_value FROM a GROUP BY ALL")(lambda t: T.best_of(_means(t), ["operation", "scale"], "config", "value"))
query("name_filter", "SELECT p_partkey AS key, p_name AS name FROM part WHERE contains(p_name, 'e') AND p_size IS NOT NULL")(lambda t: t("part").where(F.col("p_name").contains("e") & F.col("p_size").isNotNull()).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))
query("custom_order", f"WITH {_M} SELECT DISTINCT config, CASE config WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 4 END AS place FROM m")(
    lambda t: T.in_order(measurements(t).select("config").distinct(), "config", ["O", "P", "F"]).withColumn("place", F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, "OPF")), F.col("config")).cast("int"), F.lit(0)), F.lit(4)))
)
query("last_seen", "WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN event_id END AS seen FROM events) SELECT event_id, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM e")(
    lambda t: T.with_last_seen(t("events").select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("seen")), "event_id", "seen", ["user_id"]).select("event_id", "seen")
)

_SORTED = f"{_M}, s AS (SELECT operation, config, scale, list_sort(list(value)) AS v FROM m GROUP BY ALL), q AS (SELECT *, len(v) AS n, v[len(v) // 4 + 1] AS a, v[3 * len(v) // 4 + 1] AS b FROM s), k AS (SELECT operation, config, scale, n, CASE WHEN n < 4 THEN v ELSE list_filter(v, lambda x: x >= a - 1.5 * (b - a) AND x <= b + 1.5 * (b - a)) END AS v FROM q)"
query("iqr_outliers", f"WITH {_SORTED} SELECT operation, config, scale, len(v)::BIGINT AS n_valid, (n - len(v))::BIGINT AS n_outliers FROM k")(lambda t: X.summary(measurements(t), ["operation", "config", "scale"], "value").select("operation", "config", "scale", "n_valid", F.col("n_outliers").cast("long")))
_T95 = "CASE " + " ".join(f"WHEN len(v) - 1 >= {b} THEN {x}" for b, x in sorted(X.T_CRITICAL.items(), reverse=True)) + " END"
_CI = {"median": "list_median(v)", "mean": "list_avg(v)", "std_dev": "list_stddev_samp(v)", "ci_lower": f"(list_avg(v) - {_T95} * list_stddev_samp(v) / sqrt(len(v)))", "ci_upper": f"(list_avg(v) + {_T95} * list_stddev_samp(v) / sqrt(len(v)))"}
query("ci95", f"WITH {_SORTED} SELECT operation, config, scale, {', '.join(f'{_fixed_sql(x, 4)} AS {k}' for k, x in _CI.items())}, v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3 FROM k WHERE len(v) >= 3")(
    lambda t: X.summary(measurements(t), ["operation", "config", "scale"], "value").where("n_valid >= 3").select("operation", "config", "scale", *[_fixed(F.col(c), 4).alias(c) for c in _CI], "q1", "q3")
)
query("latency_index", f"WITH {_M}, s AS (SELECT operation, scale, list_sort(list(value)) AS v FROM m GROUP BY ALL) SELECT operation, scale, v[len(v) // 2 + 1] AS p50, v[len(v) * 99 // 100 + 1] AS p99 FROM s")(
    lambda t: X.nearest_ranks(measurements(t), ["operation", "scale"], "value", {"p50": 0.5, "p99": 0.99})
)
query("medians", f"WITH {_M} SELECT operation, scale, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std_dev FROM m GROUP BY ALL")(
    lambda t: measurements(t).groupBy("operation", "scale").agg(F.round(F.median("value"), 4).alias("median"), F.round(F.stddev_samp("value"), 4).alias("std_dev"))
)
query("trimmed_mean", f"WITH {_M}, w AS (SELECT *, avg(value) OVER (PARTITION BY operation) AS m, stddev_pop(value) OVER (PARTITION BY operation) AS s FROM m) SELECT operation, round(coalesce(avg(value) FILTER (abs(value - m) <= 1.5 * s), avg(value)), 3) AS trimmed_mean, count(*) FILTER (abs(value - m) <= 1.5 * s) AS n_kept FROM w GROUP BY operation")(
    lambda t: X.trimmed_mean(measurements(t), ["operation"], "value", 1.5).withColumn("trimmed_mean", F.round("trimmed_mean", 3))
)


def _effects(t) -> DataFrame:
    sides = measurements(t).where("config in ('F', 'O')").groupBy("operation", "scale").agg(
        F.avg(F.when(F.col("config") == "F", F.col("value"))).alias("a"), F.avg(F.when(F.col("config") == "O", F.col("value"))).alias("b"), F.stddev_samp(F.when(F.col("config") == "F", F.col("value"))).alias("s")
    )
    d = F.round(X.cohens_d(F.col("a"), F.col("b"), F.col("s")), 4)
    return sides.where("a is not null and b is not null and s is not null").select("operation", "scale", d.alias("d"), X.effect_label(d).alias("effect"))


query("cohens_d", f"WITH {_M}, s AS (SELECT operation, scale, avg(value) FILTER (config = 'F') AS a, avg(value) FILTER (config = 'O') AS b, stddev_samp(value) FILTER (config = 'F') AS s FROM m GROUP BY ALL), d AS (SELECT operation, scale, round(coalesce((a - b) / nullif(s, 0), 0), 4) AS d FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL) SELECT *, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d")(_effects)
def _t_tests(t) -> DataFrame:
    """Large groups and small ones, of even and of odd degrees of freedom."""
    lines = t("lineitem")
    value = (F.col("l_quantity") / 25.0).alias("value")
    rows = lines.select(F.col("l_returnflag").alias("operation"), value).unionByName(lines.select(F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("operation"), value))
    tested = X.t_statistic(rows, ["operation"], "value").where("t is not null")
    return tested.select("operation", "n", F.round("t", 4).alias("t"), "p")


#: p by the finite series of sines and cosines that whole degrees of freedom have, odd and even ones; no continued fraction.
_SERIES = "list_sum(list_transform(range(0, {n}), lambda j: exp({ratio} + {power} * ln(cos(theta)))))"
_ODD, _EVEN = "lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)", "lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)"
query(
    "t_test",
    f"""WITH m AS (
  SELECT l_returnflag AS operation, l_quantity / 25.0 AS value, 0 AS least FROM lineitem UNION ALL SELECT concat(l_suppkey, '/', l_linenumber), l_quantity / 25.0, 1 FROM lineitem
), s AS (SELECT operation, avg(value) AS a, stddev_samp(value) AS s, count(*) AS n, any_value(least) AS least FROM m GROUP BY 1),
t AS (SELECT operation, n, (a - 1) * sqrt(n) / s AS t, n - 1 AS v FROM s WHERE n > 1 AND s > 0), r AS (SELECT *, atan(abs(t) / sqrt(v)) AS theta FROM t),
p AS (SELECT operation, 1 - CASE WHEN v = 1 THEN 2 * theta / pi()
  WHEN v % 2 = 1 THEN 2 / pi() * (theta + sin(theta) * {_SERIES.format(n="(v - 1) // 2", ratio=_ODD, power="(2 * j + 1)")})
  ELSE sin(theta) * {_SERIES.format(n="v // 2", ratio=_EVEN, power="(2 * j)")} END AS p FROM r)
SELECT t.operation, t.n, round(t.t, 4) AS t, round(p.p, 6) AS p FROM t LEFT JOIN p USING (operation)""",
)(_t_tests)
query("amdahl", "SELECT l_orderkey AS run, l_linenumber AS step, round(1 / (l_discount + (1 - l_discount) / 20), 6) AS bound, round((l_extendedprice - l_quantity) * 100 / l_extendedprice, 6) AS overhead_pct FROM lineitem")(
    lambda t: t("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), X.amdahl_bound(F.col("l_discount")).alias("bound"), X.overhead_percent(F.col("l_extendedprice"), F.col("l_quantity")).alias("overhead_pct"))
)
query("composition_ratio", "SELECT l_orderkey AS run, l_linenumber AS step, floor(l_extendedprice / (l_quantity * CASE WHEN l_discount * 10 < 0.3 THEN 2.0 WHEN l_discount * 10 < 0.45 THEN 3.5 ELSE 5.0 END) * 1000000.0 + 0.501) / 1000000.0 AS ratio, l_discount * 10 < 0.45 AS vector_effective, l_discount * 10 >= 0.45 AND l_discount * 10 > 0.55 AS gpu_candidate FROM lineitem")(
    lambda t: t("lineitem").withColumn("c", F.col("l_discount") * 10).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), _fixed(X.composition_ratio(F.col("l_extendedprice"), F.col("l_quantity"), F.col("c")), 6).alias("ratio"), X.vector_effective(F.col("c")).alias("vector_effective"), X.gpu_candidate(F.col("c")).alias("gpu_candidate"))
)
_E = {"watts": "l_extendedprice / 1000", "energy_wh": "l_extendedprice / 1000 * l_quantity / 3600", "energy_per_seq_uwh": "l_extendedprice / 1000 * l_quantity / 3600 * 1000000.0 / 1000"}
query("energy", f"SELECT l_orderkey AS run, l_linenumber AS step, {', '.join(f'{_fixed_sql(x, 4)} AS {k}' for k, x in _E.items())} FROM lineitem")(
    lambda t: t("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), X.energy(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(1000)).alias("e")).select("run", "step", *[_fixed(F.col(f"e.{k}"), 4).alias(k) for k in _E])
)
query("regression_trend", "SELECT l_returnflag AS operation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS correlation, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda t: X.trend(t("lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), ["operation"], "x", "y").withColumn("slope", F.round("slope", 4)).withColumn("intercept", F.round("intercept", 3))
)
query("tolerance", "SELECT l_returnflag AS operation, round(avg(CASE WHEN abs(l_extendedprice - l_quantity * 1500) <= abs(l_extendedprice) * 0.2 THEN 1 ELSE 0 END), 6) AS within_20, round(avg(CASE WHEN abs(l_extendedprice - l_quantity * 1500) <= abs(l_extendedprice) * 0.5 THEN 1 ELSE 0 END), 6) AS within_50 FROM lineitem GROUP BY 1")(
    lambda t: t("lineitem").groupBy(F.col("l_returnflag").alias("operation")).agg(*[X.within_tolerance(F.col("l_extendedprice") - F.col("l_quantity") * 1500, F.col("l_extendedprice"), s / 100).alias(f"within_{s}") for s in (20, 50)])
)
query("pruning", f"WITH {_MEANS}, r AS (SELECT operation, config, scale, value / 15000000 AS speedup FROM a) SELECT operation, config, scale, coalesce(min(speedup) OVER (PARTITION BY operation, config ORDER BY scale ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1.0, false) AS pruned FROM r")(
    lambda t: X.prune(_means(t).withColumn("speedup", F.col("value") / 15000000), ["operation", "config"], "scale", "speedup", 1.0).select("operation", "config", "scale", "pruned")
)
query("registry_by_size", "SELECT p_brand AS category, p_partkey AS key, p_name AS name, count(*) OVER (PARTITION BY p_brand) AS n FROM part")(
    lambda t: t("part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name")).join(t("part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n")), "category")
)
query("ratio_then_mean", f"WITH {_M}, r AS (SELECT operation, scale, avg(value) FILTER (config = 'F') / avg(value) FILTER (config = 'O') AS ratio FROM m GROUP BY ALL) SELECT operation, round(avg(ratio), 6) AS mean_ratio, count(ratio) AS n_ratios FROM r GROUP BY 1")(
    lambda t: X.mean_of_ratios(measurements(t), ["operation"], "config", "F", "O", "value", ["scale"])
)
query("first_and_mean", f"WITH {_M} SELECT operation, config, arg_min(value, run) AS first_value, min(run) AS first_run, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(*), 6) AS mean_cents FROM m GROUP BY ALL")(
    lambda t: measurements(t).groupBy("operation", "config").agg(F.min_by("value", "run").alias("first_value"), F.min("run").alias("first_run"), (F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*")).alias("mean_cents"))
)
_MATRIX = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({x}, {y}), 6) AS correlation FROM lineitem" for a, x in _MATRIX.items() for b, y in _MATRIX.items() if a != b) + "".join(f" UNION ALL SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS correlation" for a in _MATRIX))(
    lambda t: X.correlations(t("lineitem").select(*[F.col(c).alias(k) for k, c in _MATRIX.items()]), list(_MATRIX))
)
_EFF = {"time_speedup": "l_quantity / (1 + l_tax * 100)", "energy_speedup": "(l_extendedprice * l_quantity) / (l_extendedprice * (1 - l_discount) * (1 + l_tax * 100))"}
query("energy_efficiency", f"SELECT l_orderkey AS run, l_linenumber AS step, {', '.join(f'{_fixed_sql(x, 4)} AS {k}' for k, x in _EFF.items())}, {_fixed_sql(f'(({_EFF["time_speedup"]}) / ({_EFF["energy_speedup"]}))', 4)} AS efficiency FROM lineitem")(
    lambda t: t("lineitem").withColumn("_after", 1 + F.col("l_tax") * 100).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), X.efficiency(F.col("l_quantity"), F.col("_after"), F.col("l_extendedprice") * F.col("l_quantity"), F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("_after")).alias("e")).select("run", "step", *[_fixed(F.col(f"e.{k}"), 4).alias(k) for k in (*_EFF, "efficiency")])
)
query("thread_gain", f"WITH {_MEANS}, g AS (SELECT operation, config, scale, value / lag(value) OVER (PARTITION BY operation, config ORDER BY scale) AS gain FROM a) SELECT operation, config, scale, round(gain, 6) AS gain, coalesce(min(gain) OVER (PARTITION BY operation, config ORDER BY scale ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.97, false) AS pruned FROM g")(
    lambda t: X.prune_gains(_means(t), ["operation", "config"], "scale", "value", 0.97).select("operation", "config", "scale", "gain", "pruned")
)
query("least_useful_scale", f"WITH {_MEANS}, r AS (SELECT operation, config, scale, value / 15000000 AS speedup FROM a) SELECT operation, config, min(scale) FILTER (speedup > 1.0) AS least_scale, round(arg_min(speedup, scale) FILTER (speedup > 1.0), 6) AS benefit FROM r GROUP BY ALL")(
    lambda t: X.least_with_benefit(_means(t).withColumn("speedup", F.col("value") / 15000000), ["operation", "config"], "scale", "speedup")
)


def _models(t) -> DataFrame:
    """Every kind of model with 5-fold cross-validation, over all orders' lines."""
    from ..operators.models import compared

    rows = t("lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price"))
    return compared(rows, ["quantity", "discount"], "price")


query("models_cv")(_models)


def _closed_form(t) -> DataFrame:
    """Two features, and one with its square; folds by order."""
    from ..operators.models import closed_form

    rows = t("lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price"))
    return closed_form(rows, {"linear": (["quantity", "discount"], 1), "quadratic": (["quantity"], 2)}, "price", F.col("fold"))


def _cramer(name: str, second: str) -> str:
    """The fit on two columns by Cramer's rule over covariances, for all rows (fold -1) and without each fold."""
    return f"""{name}_r AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity::DOUBLE AS x, ({second})::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem),
{name}_c AS (SELECT f, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM range(-1, 5) t(f) JOIN {name}_r ON fold <> f GROUP BY f),
{name}_w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM {name}_c),
{name}_e AS (SELECT f, y, y - my - a * (x - mx) - b * (z - mz) AS e FROM {name}_w JOIN {name}_r ON f = -1 OR fold = f),
{name}_s AS (SELECT f, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae FROM {name}_e GROUP BY f)"""


query(
    "models_closed_form",
    f"WITH {_cramer('linear', 'l_discount')}, {_cramer('quadratic', 'l_quantity * l_quantity')} "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(avg(r2) FILTER (f >= 0), 6) AS cv_r2, round(max(r2) FILTER (f = -1), 6) AS r2, round(max(mae) FILTER (f = -1), 3) AS mae FROM {k}_s" for k in ("linear", "quadratic")),
)(lambda t: _closed_form(t).withColumn("mae", F.round("mae", 3)))


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that was broken off still has to do: its checkpoint is written, read again and taken away."""
    path = f"{P.shared_folder(spark)}/completed"
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("run"))
    T.save_checkpoint(done, "run", path)
    return T.pending(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("customer")), T.load_checkpoint(spark, path, "run"), "run")


def _results(file_format: str):
    """Results written to files and read again, CSV with fixed decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, path = measurements(lambda t: table(spark, sf_dir, t)), f"{P.shared_folder(spark)}/results"
        tables.write_results(df, path, file_format, {"value": 2} if file_format == "csv" else None)
        schema = "operation string, config string, scale int, value double, run long"
        return tables.read_csv(spark, path, schema, "[") if file_format == "csv" else spark.read.schema(schema).format(file_format).load(path)

    return run


for _format in ("csv", "json", "parquet"):
    QUERIES[f"results_{_format}"] = _results(_format)
    SQL[f"results_{_format}"] = f"WITH {_M} SELECT operation, config, scale, value, run FROM m"
QUERIES["resume_checkpoint"] = _resumed
SQL["resume_checkpoint"] = SQL["resume_anti"]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(P.stream_parquet(spark, f"{sf_dir}/orders.parque[t]"))


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that pass the quality filter of a stateless stream, read back from its sink."""
    root = P.shared_folder(spark)
    P.filter_pipeline(_stream(spark, sf_dir), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", "sequence", "quality")


def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals kept over a stream, as the last batch left them."""
    root = P.shared_folder(spark)
    P.complete_to(P.running_counts(_stream(spark, sf_dir)), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


QUERIES |= {"stream_filter": stream_filter, "stream_running_counts": stream_running_counts}
SQL |= {
    "stream_filter": f"WITH {READS_SQL} SELECT id, sequence, quality FROM reads WHERE list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c)))::DOUBLE / length(quality) - 33 >= 20",
    "stream_running_counts": f"WITH {READS_SQL} SELECT length(sequence)::INTEGER AS length, count(*) AS num_sequences, sum(strlen(sequence))::BIGINT AS total_bases, sum(length(sequence) - length(translate(sequence, 'GC', '')))::BIGINT AS count_gc, sum(length(sequence) - length(translate(sequence, 'N', '')))::BIGINT AS count_n FROM reads GROUP BY 1",
}
