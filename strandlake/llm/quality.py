"""Quality classifier: a sparse rule ensemble.

Statistics of the whole text (shares of character kinds, word and line counts, repetition) feed a small forest on a
bounded sample of labelled rows; every path from a root to a node becomes a conjunctive rule. A lasso logistic regression
over the rules keeps few of them, and the kept rules are compiled into one Spark column expression over the statistics.
Sampling bound: about TRAIN_ROWS labelled rows, chosen by a hash of doc_id; only their ids are broadcast.

Defined results: a null text counts as empty and is scored like one; without labels of both classes every score is the
share of label 1, or 0.5 without any; repeated rows are scored alike; labels that are null don't count, and of several
labels for one document the lowest does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, documents
from .langid import held_out

TRAIN_ROWS = 8000
TREES, DEPTH, LASSO = 12, 3, 0.002
THRESHOLD = 0.7

STATISTICS = ("log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "punctuation", "symbol", "bang", "bar", "blank", "non_ascii", "distinct_words", "words_a_line", "repeated_lines")

Rule = tuple[tuple[str, bool, float], ...]


def _group(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


_UPPER, _DIGIT = _group("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _group("0123456789")
_PUNCTUATION, _SYMBOL = _group(".,;:'\"()?-"), _group("#$%&*@^~+=<>{}[]\\/_`")


def statistics_of(text: bytes) -> tuple[float, ...]:
    """One number for each name in STATISTICS."""
    n = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    return (
        math.log1p(len(text)),
        math.log1p(len(words)),
        sum(map(len, words)) / k,
        math.log1p(max(map(len, words), default=0)),
        seen[_UPPER].sum() / n,
        seen[_DIGIT].sum() / n,
        seen[_PUNCTUATION].sum() / n,
        seen[_SYMBOL].sum() / n,
        seen[33] / n,
        seen[124] / n,
        seen[32] / n,
        seen[128:].sum() / n,
        len(set(words)) / k,
        math.log1p(len(words) / len(lines)),
        1 - len(set(lines)) / len(lines),
    )


def statistics(text: Column) -> Column:
    """A struct column with a field for each name in STATISTICS."""

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(texts: pa.Array) -> pa.Array:
        data, at = buffer_of(texts)
        rows = np.array([statistics_of(data[at[i] : at[i + 1]].tobytes()) for i in range(len(texts))], np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], list(STATISTICS))

    return run(text)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and a column for each statistic."""
    return df.withColumn("_q", statistics(F.col(text))).select(*keep, *[F.col(f"_q.{s}").alias(f"_{s}") for s in STATISTICS])


def compiled(rule: Rule) -> Column:
    """A conjunctive rule as a boolean column."""
    return reduce(lambda a, b: a & b, [F.col(f"_{s}") <= t if low else F.col(f"_{s}") > t for s, low, t in rule])


def tree_rules(forest) -> list[Rule]:
    """The distinct paths from the roots of a forest to each of its nodes."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, True, threshold)))
            walk(node.rightChild(), (*path, (name, False, threshold)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


class RuleEnsemble:
    """Weighted rules; score() is a column expression."""

    def __init__(self, weights: dict[Rule, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(compiled(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights.items()], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fits the ensemble to labels (doc_id, quality) of documents (doc_id, text)."""
    labelled = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("_label"))
    total = labelled.count()
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < min(1.0, rows / max(1, total)) * (1 << 20))
    train = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["_label"]).persist()
    try:
        seen = train.agg(F.count("*").alias("n"), F.avg("_label").alias("p")).first()
        if not seen["n"] or seen["p"] in (0.0, 1.0):
            p = min(max(0.5 if seen["p"] is None else seen["p"], 1e-6), 1 - 1e-6)
            return RuleEnsemble({}, math.log(p / (1 - p)))
        grown = VectorAssembler(inputCols=[f"_{s}" for s in STATISTICS], outputCol="_x").transform(train)
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, bootstrap=False, featureSubsetStrategy="onethird", seed=7).fit(grown)
        rules = tree_rules(forest)
        fired = train.select("_label", *[compiled(r).cast("double").alias(f"_r{i}") for i, r in enumerate(rules)])
        design = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_x").transform(fired)
        lasso = LogisticRegression(featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=True).fit(design.select("_x", "_label"))
        return RuleEnsemble({r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w}, float(lasso.intercept))
    finally:
        train.unpersist()


def scored(docs: DataFrame, model: RuleEnsemble, keep: list[str]) -> DataFrame:
    """The kept columns, score and predicted."""
    score = with_statistics(docs, keep).select(*keep, model.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return scored(docs, learn(docs, labels), ["doc_id", "held_out"])
