"""Regressors, fold training and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import SparkContext
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import settle, swept
from ..settings import BOOST_PRESETS, STOP_CHUNK, STOP_ROUNDS, BoostPreset
from .folds import train_rows, valid_rows

# Bytes that linear fits side by side may hold on the driver, and arrays that one of them holds: ten steps, ten gradients, and sums.
DRIVER_BYTES, HELD = 256 << 20, 32


def boosted(preset: BoostPreset | str, features: str = "features", label: str = "target", **changes) -> GBTRegressor:
    """Gradient-boosted trees with squared loss from a preset; keyword arguments change single settings.

    Trees grow by level, so the leaf limit becomes the depth that can hold as many leaves.
    """
    preset = BOOST_PRESETS[preset] if isinstance(preset, str) else preset
    preset = replace(preset, **changes)
    return GBTRegressor(
        featuresCol=features,
        labelCol=label,
        maxIter=preset.trees,
        stepSize=preset.rate,
        maxDepth=preset.depth,
        maxBins=preset.bins,
        minInstancesPerNode=preset.min_rows,
        subsamplingRate=preset.row_share,
        featureSubsetStrategy="all" if preset.feature_share >= 1 else str(preset.feature_share),
        seed=preset.seed,
        lossType="squared",
    )


def linear(features: str = "features", label: str = "target", ridge: float = 0.0) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, regParam=ridge)


LEARNERS: Mapping[str, Callable[..., Estimator]] = {
    "lr": linear,
    "xgb": lambda **kw: boosted("xgb", **kw),
    "cat": lambda **kw: boosted("cat", **kw),
    "lgbm": lambda **kw: boosted("lgbm", **kw),
}


def best_round(losses: Sequence[float], rounds: int = STOP_ROUNDS) -> int:
    """Trees to keep: training stops once ``rounds`` trees in a row bring no lower loss."""
    best, kept = float("inf"), 0
    for i, loss in enumerate(losses, start=1):
        if loss < best:
            best, kept = loss, i
        elif i - kept >= rounds:
            break
    return max(kept, 1)


@dataclass
class TrimmedBoost:
    """Boosted trees up to the best round. ``fitted`` trees were grown until the rule ended the training."""

    model: GBTRegressionModel
    kept: int
    fitted: int

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.model.copy({self.model.predictionCol: out}).transform(df)


def ensemble(trees: Sequence[RandomForestRegressionModel], weights: Sequence[float], features: str) -> GBTRegressionModel:
    """Trees as one model, which scores a row in one function whatever their number."""
    gateway, jvm = SparkContext._active_spark_context._gateway, SparkContext._active_spark_context._jvm
    own = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    share = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        own[i], share[i] = tree._java_obj.trees()[0], float(weight)
    java = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{trees[0].uid}_boosted", own, share, trees[0].numFeatures)
    return GBTRegressionModel(java).setFeaturesCol(features)


def has_stopped(losses: Sequence[float], rounds: int = STOP_ROUNDS) -> bool:
    """Whether ``rounds`` trees in a row brought no lower loss than the best one before them."""
    return best_round(losses, rounds) + rounds <= len(losses)


def one_tree(estimator: GBTRegressor) -> RandomForestRegressor:
    """A single tree with the settings of a boosted learner's trees."""
    return RandomForestRegressor(
        featuresCol=estimator.getFeaturesCol(),
        labelCol="__residual",
        predictionCol="__tree",
        numTrees=1,
        bootstrap=False,
        maxDepth=estimator.getMaxDepth(),
        maxBins=estimator.getMaxBins(),
        minInstancesPerNode=estimator.getMinInstancesPerNode(),
        minInfoGain=estimator.getMinInfoGain(),
        subsamplingRate=estimator.getSubsamplingRate(),
        featureSubsetStrategy=estimator.getFeatureSubsetStrategy(),
    )


def fit_early_stopped(
    estimator: GBTRegressor, train: DataFrame, valid: DataFrame, rounds: int = STOP_ROUNDS, chunk: int = STOP_CHUNK
) -> tuple[TrimmedBoost, list[float]]:
    """Grow trees until ``rounds`` of them in a row bring no lower valid loss, and keep the best round.

    Trees come ``chunk`` at a time: each is fitted on what the trees before it leave over, exactly as the estimator's own next
    tree would be (the first one on the target itself, with weight one; then on twice the residual, by the learning rate).
    After a chunk the scores so far are settled, one pass reads its valid losses, and the rule decides whether to go on. So no
    more than the kept trees, ``rounds`` and a chunk are fitted, whatever the number of trees asked for.
    """
    features, label, rate, most = estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getStepSize(), estimator.getMaxIter()
    one, so_far = one_tree(estimator), F.lit(0.0).alias("__so_far")
    train, valid = (settle(df.select(features, F.col(label).cast("double").alias(label), so_far)) for df in (train, valid))
    trees: list[RandomForestRegressionModel] = []
    losses: list[float] = []
    while len(trees) < most and not has_stopped(losses, rounds):
        names = []
        for _ in range(min(chunk, most - len(trees))):
            residual = F.col(label) if not trees else 2 * (F.col(label) - F.col("__so_far"))
            tree = one.copy({one.seed: estimator.getSeed() + len(trees)}).fit(train.withColumn("__residual", residual))
            grown = F.col("__so_far") + F.col("__tree") * (rate if trees else 1.0)
            train, valid = (tree.transform(df).withColumn("__so_far", grown).drop("__tree") for df in (train, valid))
            trees.append(tree)
            names.append(f"__f{len(trees)}")
            valid = valid.withColumn(names[-1], F.col("__so_far"))
        train, valid = settle(train), settle(valid)
        found = valid.agg(*[F.avg(F.pow(F.col(label) - F.col(n), 2)).alias(n) for n in names]).first()
        losses += [float("nan") if x is None else x for x in found]
        valid = valid.drop(*names)
    kept = best_round(losses, rounds)
    model = ensemble(trees[:kept], [1.0] + [rate] * (kept - 1), features)
    return TrimmedBoost(model, kept, len(trees)), losses


def predict(model, df: DataFrame, out: str = "pred") -> DataFrame:
    if isinstance(model, TrimmedBoost):
        return model.transform(df, out)
    return model.copy({model.predictionCol: out}).transform(df)


def side_by_side(fit: Callable, tasks: Sequence, parallelism: int) -> list:
    """``fit`` of every task, ``parallelism`` of them at a time; the cluster shares its cores between their jobs."""
    if parallelism <= 1:
        return [fit(t) for t in tasks]
    # A task that itself runs tasks side by side has no active session of its own.
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(session)(fit), tasks))


def fits_together(estimator: Estimator, train: DataFrame, parallelism: int) -> int:
    """Fits that go side by side: as many as asked for, or fewer linear ones, each of which keeps its last steps, gradients and
    sums on the driver, arrays as wide as the features."""
    if parallelism <= 1 or not isinstance(estimator, LinearRegression):
        return parallelism
    some = train.select(estimator.getFeaturesCol()).first()
    width = len(some[0]) if some and some[0] is not None else 1
    return max(1, min(parallelism, DRIVER_BYTES // (8 * HELD * max(1, width))))


def fit_folds(
    features: DataFrame | Callable[[int], tuple[DataFrame, DataFrame]],
    estimator: Estimator,
    folds: int,
    early_stopping: bool = False,
    rounds: int = STOP_ROUNDS,
    parallelism: int = 1,
) -> dict[int, Model | TrimmedBoost]:
    """One independent model per fold, each fitted on the rows outside its fold.

    ``features`` is one table with a ``fold`` column or, where features depend on
    the fold, a function from fold to its (train, valid) tables.
    """

    def tables(f: int) -> tuple[DataFrame, DataFrame]:
        return features(f) if callable(features) else (train_rows(features, f), valid_rows(features, f))

    def fit(f: int):
        train, valid = tables(f)
        if early_stopping and hasattr(estimator, "fit_stopped"):
            return estimator.fit_stopped(train, valid, rounds)
        if early_stopping:
            return fit_early_stopped(estimator, train, valid, rounds)[0]
        return estimator.fit(train)

    together = fits_together(estimator, tables(0)[0], parallelism) if folds else 1
    with swept(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()):
        return dict(zip(range(folds), side_by_side(fit, range(folds), together)))


def score_folds(features, models: Mapping[int, object], roles: Sequence[str] = ("valid",), out: str = "pred") -> DataFrame:
    """Each fold's model on its valid rows (every row once) and, if asked, on its train rows."""
    parts = []
    for f, model in models.items():
        train, valid = features(f) if callable(features) else (train_rows(features, f), valid_rows(features, f))
        for role, rows in (("valid", valid), ("train", train)):
            if role in roles:
                scored = predict(model, rows.withColumn("fold", F.lit(f)), out)
                parts.append(scored.withColumn("role", F.lit(role)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def score_models(df: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """One prediction column per named model; models that share features score in one narrow stage."""
    for name, model in models.items():
        df = predict(model, df, name)
    return df


def score_holdout(df: DataFrame, models: Mapping[int, object], out: str = "rank") -> DataFrame:
    """Negated mean of all fold models on rows outside the folds, without a shuffle."""
    names = {f: f"__p{f}" for f in models}
    scored = score_models(df, {names[f]: m for f, m in models.items()})
    total = sum((F.col(n) for n in names.values()), F.lit(0.0))
    return scored.withColumn(out, -(total / F.lit(float(len(names))))).drop(*names.values())
