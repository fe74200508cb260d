"""Regression models over experiment tables: least squares in closed form from one aggregation, trees on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("linear", "quadratic", "random_forest", "gradient_boosting")
#: Rows whose cells are summed up at once, cells of a partition, and fits on cells that run beside each other.
_ROWS, _CELLS, _FITS = 1 << 17, 10_000, 4


def regression(kind: str, features: list[str], target: str, seed: int = 42) -> Pipeline:
    """An unfitted pipeline of one of KINDS."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    column = "_x"
    if kind == "quadratic":
        stages.append(PolynomialExpansion(degree=2, inputCol="_x", outputCol="_x2"))
        column = "_x2"
    model = {
        "linear": lambda: LinearRegression(featuresCol=column, labelCol=target),
        "quadratic": lambda: LinearRegression(featuresCol=column, labelCol=target, regParam=1e-6),
        "random_forest": lambda: RandomForestRegressor(featuresCol=column, labelCol=target, seed=seed),
        "gradient_boosting": lambda: GBTRegressor(featuresCol=column, labelCol=target, seed=seed),
    }[kind]()
    return Pipeline(stages=[*stages, model])


def trained(df: DataFrame, kind: str, features: list[str], target: str, seed: int = 42) -> PipelineModel:
    """A fitted pipeline of one of KINDS.

    Boosted trees pass over their rows for each level of each tree, and ask each cell of equal features only for the number,
    and the sum of the residuals, of its rows. They get one row for each cell, with the mean target and the number as its
    weight: the squared errors inside a cell are the same for every split, so the best ones are those of all rows.
    """
    pipeline = regression(kind, features, target, seed)
    if kind != "gradient_boosting":
        return pipeline.fit(df)
    *before, model = pipeline.getStages()
    scaled = Pipeline(stages=before).fit(df)
    mean = F.when(F.count(target) == F.count("*"), F.avg(target))  # null, an error, where a target is
    cells = df.groupBy(*features).agg(mean.alias(target), F.count("*").cast("double").alias("_n"))
    return PipelineModel([*scaled.stages, model.setWeightCol("_n").fit(scaled.transform(cells))])


def _dealt(df: DataFrame, features: list[str], target: str, folds: int, seed: int) -> DataFrame:
    """The columns that models need, with a random fold, spread over all cores (a file may be one task) and kept."""
    rows = df.select(*features, target).repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
    return _folded(rows, folds, seed).persist()


def _folded(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    return rows.withColumn("_fold", F.least(F.floor(F.rand(seed) * folds), F.lit(folds - 1)).cast("int"))


def cross_validated(df: DataFrame, kind: str, features: list[str], target: str, folds: int = 5, seed: int = 42) -> dict[str, float]:
    """R squared of the folds, and R squared and mean absolute error of the model fitted to all rows."""
    return _scores(df, (kind,), features, target, folds, seed)[kind]


def compared(df: DataFrame, features: list[str], target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """A row for each of KINDS: kind, cv_r2, r2, mae."""
    found = [(kind, *s.values()) for kind, s in _scores(df, KINDS, features, target, folds, seed).items()]
    return df.sparkSession.createDataFrame(found, "kind string, cv_r2 double, r2 double, mae double")


def _summed(trees: int) -> list[str]:
    return ["_n", "_s", "_q", *[f"_{c}{t}" for t in range(trees) for c in ("w", "v")]]


def _cells(rows: DataFrame, features: list[str], target: str, centre: float, trees: int, seed: int) -> DataFrame:
    """A row for each fold and cell of equal features: rows, sum and squares of the target less `centre`, and for each tree
    the rows, and the sum, that a bootstrap of the rows draws: each row's number is a Poisson of its own."""
    names = ["_fold", *features, *_summed(trees)]

    def cells(x: np.ndarray, y: np.ndarray, fold: np.ndarray, draws: np.random.Generator) -> pa.RecordBatch:
        keys, cell = _distinct(fold, x)
        add = lambda v=None: np.bincount(cell, v, len(keys)).astype(np.float64)
        sums = [add(), add(y), add(y * y)]
        for _ in range(trees):
            drawn = draws.poisson(1.0, len(y)).astype(np.float64)
            sums += [add(drawn), add(drawn * y)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys.T, *sums)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, n = [], 0

        def done() -> pa.RecordBatch:
            columns = np.concatenate(held, axis=1)
            return cells(columns[1:-1].T, columns[-1] - centre, columns[0], draws)

        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a feature or the target is null")
            held.append(np.array([c.to_numpy() for c in batch.columns], np.float64))
            n += batch.num_rows
            if n >= _ROWS:
                yield done()
                held, n = [], 0
        if n:
            yield done()

    known = rows.select("_fold", *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    return known.mapInArrow(run, ", ".join(f"`{c}` double" for c in names)).groupBy("_fold", *features).agg(*[F.sum(c).alias(c) for c in _summed(trees)])


def _distinct(fold: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of fold and features, and each row's number among them."""
    cell = fold.astype(np.int64)
    for column in x.T:
        values, at = np.unique(column, return_inverse=True)
        _, first, cell = np.unique(cell * len(values) + at, return_index=True, return_inverse=True)
    return np.column_stack([fold, x])[first], cell


def _vectors(cells: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """`rows` with the vectors _x, standardized by the cells as their rows would be, and _x2, their products."""
    n = F.sum("_n")
    means = cells.agg(*[(F.sum(F.col(c) * F.col("_n")) / n).alias(c) for c in features]).first()
    spread = cells.agg(*[F.sqrt(F.sum((F.col(c) - F.lit(means[c])) ** 2 * F.col("_n")) / (n - 1)).alias(c) for c in features]).first()
    scaled = rows.select("*", *[((F.col(c) - F.lit(means[c])) / F.lit(spread[c]) if spread[c] else F.lit(0.0)).alias(f"_z_{c}") for c in features])
    one = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_x").transform(scaled)
    return PolynomialExpansion(degree=2, inputCol="_x", outputCol="_x2").transform(one)


def _fitted(cells: DataFrame, kind: str, tree: int | None, features: list[str], target: str, centre: float, seed: int) -> Model:
    """A model fitted to cells, each as heavy as its rows, by their mean target: all that a fit asks of a cell but for the
    errors inside it, which no model changes. A tree of a forest gets what its bootstrap drew from each cell."""
    model = regression(kind, features, target, seed).getStages()[-1]
    weight, total = ("_n", "_s") if tree is None else (f"_w{tree}", f"_v{tree}")
    if tree is not None:
        model = model.setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("onethird").setSeed(seed + tree)
    data = cells.where(F.col(weight) > 0).select(model.getFeaturesCol(), F.col(weight).alias("_weight"), (F.col(total) / F.col(weight) + centre).alias(target))
    return model.setWeightCol("_weight").fit(data)


def _scores(df: DataFrame, kinds: tuple[str, ...], features: list[str], target: str, folds: int, seed: int) -> dict[str, dict[str, float]]:
    """For each kind R squared of the folds, and R squared and mean absolute error of the model fitted to all rows.

    All fits come from the cells of each fold, which one pass over the rows sums up, bootstraps of forests included; the cells
    are as many as there are different features. R squared comes from the cells too; absolute errors take one more pass.
    """
    trees = regression("random_forest", features, target, seed).getStages()[-1].getNumTrees() if "random_forest" in kinds else 0
    centre = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    spread = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    rows = _dealt(df, features, target, folds, seed) if spread else _folded(df.select(*features, target), folds, seed)
    kept = [rows]

    def keep(some: DataFrame) -> DataFrame:
        kept.append(some.persist())
        return kept[-1]

    try:
        cells = keep(_cells(rows, features, target, centre, trees, seed))
        cells = keep(cells.repartition(-(-cells.count() // _CELLS) or 1, *features))  # fits pass over them many times
        total = lambda some: some.groupBy(*features).agg(*[F.sum(c).alias(c) for c in _summed(trees)])
        known = {k: total(cells.where(F.col("_fold") != k)) for k in (*range(folds), folds)}  # no fold has the number `folds`: all rows
        known = {k: keep(c) for k, c in known.items()}
        known = {k: keep(_vectors(c, c, features)) for k, c in known.items()}
        asked = [(k, kind, t) for k in known for kind in kinds for t in (range(trees) if kind == "random_forest" else (None,))]
        with ThreadPool(_FITS) as pool:
            models = dict(zip(asked, pool.map(inheritable_thread_target(df.sparkSession)(lambda a: _fitted(known[a[0]], *a[1:], features, target, centre, seed)), asked, chunksize=1), strict=True))

        def predicted(k: int) -> DataFrame:
            out = _vectors(known[k], known[folds].select(*features), features)
            for kind in kinds:
                own = [m for (a, b, _), m in models.items() if (a, b) == (k, kind)]
                for i, m in enumerate(own):
                    out = m.setPredictionCol(f"_p{i}").transform(out)
                out = out.withColumn(f"_of_{kind}", sum(F.col(f"_p{i}") for i in range(len(own))) / len(own)).drop(*[f"_p{i}" for i in range(len(own))])
            return out.select(*features, *[f"_of_{kind}" for kind in kinds])

        def r2(kind: str) -> Column:
            off = F.col(f"_of_{kind}") - centre
            errors = F.sum(F.col("_q") - 2 * off * F.col("_s") + off * off * F.col("_n"))
            return 1 - errors / (F.sum("_q") - F.sum("_s") ** 2 / F.sum("_n"))

        own = {}
        for k in known:
            by = keep(predicted(k))
            some = cells.where(F.col("_fold") == k) if k < folds else cells
            own[k] = some.join(by, features).agg(*[r2(kind).alias(kind) for kind in kinds]).first()
        exact = rows.select(*[F.col(c).cast("double").alias(c) for c in (*features, target)])
        errors = exact.join(by, features).agg(*[F.avg(F.abs(F.col(target) - F.col(f"_of_{kind}"))).alias(kind) for kind in kinds]).first()
    finally:
        for some in kept:
            some.unpersist()
    return {kind: {"cv_r2": sum(own[k][kind] for k in range(folds)) / folds, "r2": own[folds][kind], "mae": errors[kind]} for kind in kinds}


@dataclass
class Fit:
    """A least-squares fit of terms (products of features, each a tuple of names; () is the constant)."""

    terms: list[tuple[str, ...]]
    weights: list[float]
    r2: float
    fold_r2: list[float]

    @property
    def cv_r2(self) -> float:
        return sum(self.fold_r2) / len(self.fold_r2) if self.fold_r2 else float("nan")

    def predict(self) -> Column:
        """The fitted value as an expression over the features."""
        return sum((F.lit(w) * product(t) for t, w in zip(self.terms, self.weights, strict=True)), F.lit(0.0))


def product(term: tuple[str, ...]) -> Column:
    out = F.lit(1.0)
    for name in term:
        out = out * F.col(name)
    return out


def polynomial(features: list[str], degree: int) -> list[tuple[str, ...]]:
    """All products of up to `degree` features, the constant first."""
    return [t for d in range(degree + 1) for t in combinations_with_replacement(features, d)]


def gram(df: DataFrame, columns: list[Column], fold: Column) -> dict[int, tuple[float, np.ndarray]]:
    """For each fold the rows and the sums of all products of the columns, in one aggregation; one row for each fold."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = df.select(fold.cast("int").alias("_fold"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna()
    sums = rows.groupBy("_fold").agg(F.count("*").alias("_n"), *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in pairs])
    found = {}
    for r in sums.collect():
        table = np.zeros((n, n))
        for i, j in pairs:
            table[i, j] = table[j, i] = r[f"_s{i}_{j}"]
        found[r["_fold"]] = (r["_n"], table)
    return found


def _solved(table: np.ndarray) -> np.ndarray:
    """Weights of all columns but the last, which is the target, from sums of products; scaled first, as powers differ in size."""
    x = table[:-1, :-1]
    scale = 1 / np.sqrt(np.where(np.diag(x) > 0, np.diag(x), 1.0))
    return scale * np.linalg.lstsq(x * scale[:, None] * scale[None, :], table[:-1, -1] * scale, rcond=1e-13)[0]


def _r2(weights: np.ndarray, table: np.ndarray, n: float, mean: float) -> float:
    """R squared on the rows summed up, from the sums alone; the first column is the constant."""
    own = np.r_[weights, -1.0]
    spread = table[-1, -1] - 2 * mean * table[0, -1] + mean * mean * n
    return float(1 - own @ table @ own / spread) if spread > 0 else float("nan")


def least_squares(df: DataFrame, features: list[str], target: str, fold: Column, degree: int = 1) -> Fit:
    """A polynomial fitted to all rows, and its R squared on each fold, fitted to the other folds.

    Sums of products say all about a least-squares fit: those of the other folds are all folds' less the fold's own. So
    every fit of a cross-validation comes from one scan and one aggregation, whatever the rows; the driver solves systems of
    as many unknowns as terms. Features and target are taken from their means first, for exactness, by a first
    aggregation, and the weights are those of the features as they are. Rows with a null are left out.
    """
    means = df.select(*[F.col(c).cast("double").alias(c) for c in (*features, target)]).dropna().agg(*[F.avg(c).alias(c) for c in (*features, target)]).first().asDict()
    centre = {c: m or 0.0 for c, m in means.items()}
    moved = {c: F.col(c) - F.lit(centre[c]) for c in (*features, target)}
    terms = polynomial(features, degree)

    def shifted(term: tuple[str, ...]) -> Column:
        out = F.lit(1.0)
        for name in term:
            out = out * moved[name]
        return out

    parts = gram(df, [*map(shifted, terms), moved[target]], fold)
    if not parts:
        return Fit(terms, [0.0] * len(terms), float("nan"), [])
    n = sum(k for k, _ in parts.values())
    whole = sum(t for _, t in parts.values())
    weights = _solved(whole)
    folds = []
    for _, (k, own) in sorted(parts.items()):
        folds.append(_r2(_solved(whole - own), own, k, own[0, -1] / k))
    return Fit(terms, _unmoved(terms, weights, centre, centre[target]), _r2(weights, whole, n, whole[0, -1] / n), folds)


def _unmoved(terms: list[tuple[str, ...]], weights: np.ndarray, centre: dict[str, float], target: float) -> list[float]:
    """Weights over the features as they are, of weights over features less their means: the products multiplied out."""
    place = {t: i for i, t in enumerate(terms)}
    out = [0.0] * len(terms)
    for term, w in zip(terms, weights.tolist(), strict=True):
        for kept in range(1 << len(term)):
            inside = tuple(c for i, c in enumerate(term) if kept >> i & 1)
            rest = [c for i, c in enumerate(term) if not kept >> i & 1]
            out[place[inside]] += w * float(np.prod([-centre[c] for c in rest]))
    out[0] += target
    return out


def closed_form(df: DataFrame, models: dict[str, tuple[list[str], int]], target: str, fold: Column) -> DataFrame:
    """A row for each named model (its features and degree): kind, cv_r2, r2, mae. Errors take one more aggregation."""
    fits = {k: least_squares(df, f, target, fold, d) for k, (f, d) in models.items()}
    errors = df.dropna(subset=[target, *{f for fs, _ in models.values() for f in fs}]).agg(*[F.avg(F.abs(F.col(target) - fit.predict())).alias(k) for k, fit in fits.items()]).first()
    return df.sparkSession.createDataFrame([(k, fit.cv_r2, fit.r2, errors[k]) for k, fit in fits.items()], "kind string, cv_r2 double, r2 double, mae double")
