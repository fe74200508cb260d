"""The catalogue of read operators: name, category, complexity and function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting, kmers, pairwise, quality, transforms
from .statistics import gpu_candidate, vector_effective


@dataclass(frozen=True)
class Operator:
    name: str
    category: str
    complexity: float
    apply: Callable[..., DataFrame]


def _parsing(df: DataFrame, **options) -> DataFrame:
    from ..sources.fastq import round_trip

    return round_trip(df, **options)


#: Names, categories and complexity scores. Fixed values.
_BUILT_IN = (
    Operator("base_counting", "element_wise", 0.40, counting.base_counting),
    Operator("gc_content", "element_wise", 0.315, counting.gc_content),
    Operator("at_content", "element_wise", 0.35, counting.at_content),
    Operator("sequence_length", "element_wise", 0.20, counting.sequence_length),
    Operator("complexity_score", "aggregation", 0.61, counting.complexity_score),
    Operator("n_content", "element_wise", 0.38, counting.n_content),
    Operator("reverse_complement", "element_wise", 0.45, transforms.reverse_complement),
    Operator("quality_filter", "filter", 0.55, quality.quality_filter),
    Operator("length_filter", "filter", 0.25, quality.length_filter),
    Operator("sequence_masking", "filter", 0.30, transforms.sequence_masking),
    Operator("adapter_trimming", "filter", 0.55, transforms.adapter_trimming),
    Operator("quality_aggregation", "aggregation", 0.50, quality.quality_aggregation),
    Operator("quality_statistics", "aggregation", 0.38, quality.quality_statistics),
    Operator("minhash_sketching", "aggregation", 0.48, kmers.minhash_sketching),
    Operator("hamming_distance", "pairwise", 0.35, pairwise.hamming_distance),
    Operator("edit_distance", "pairwise", 0.70, pairwise.edit_distance),
    Operator("kmer_counting", "search", 0.45, kmers.kmer_counting),
    Operator("kmer_extraction", "search", 0.35, kmers.kmer_extraction),
    Operator("translation", "element_wise", 0.40, transforms.translation),
    Operator("fastq_parsing", "io", 0.25, _parsing),
)

_operators = {o.name: o for o in _BUILT_IN}


def register(operator: Operator) -> None:
    if operator.name in _operators:
        raise ValueError(f"{operator.name} is registered already")
    _operators[operator.name] = operator


def get(name: str) -> Operator:
    if name not in _operators:
        raise KeyError(f"no operator {name}")
    return _operators[name]


def names(category: str | None = None) -> list[str]:
    return sorted(o.name for o in _operators.values() if category in (None, o.category))


def table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, with the rules that predict which hardware suits an operator."""
    rows = spark.createDataFrame([(o.name, o.category, o.complexity) for o in _operators.values()], "name string, category string, complexity double")
    c = F.col("complexity")
    return rows.withColumn("vector_effective", vector_effective(c)).withColumn("gpu_candidate", gpu_candidate(c))


def by_category(spark: SparkSession) -> DataFrame:
    return table(spark).groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
