"""Fold training, evaluation and hold-out ranking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blend as B
from ..operators import learners as M
from ..operators.folds import fold_count
from ..operators.metrics import average_scores, cv_mean, fold_report, mse
from ..operators.ranking import mean_ndcg, ndcg
from ..session import packed, settle
from ..settings import STOP_ROUNDS

FoldTables = Callable[[int], tuple[DataFrame, DataFrame]]
_COLUMNS = ["context_id", "reply_id", "target", "fold", "role", "pred"]


@dataclass
class Trained:
    """What a training run leaves: models, per-fold report, its mean, and ranked hold-out rows."""

    models: dict[int, object]
    predictions: DataFrame
    report: DataFrame
    mean: DataFrame
    ranked: DataFrame | None


def holdout_scores(models: Mapping[int, object], holdout: DataFrame | Callable[[int], DataFrame]) -> DataFrame:
    """``(context_id, reply_id, rank)``: all fold models, averaged and negated.

    One feature table is scored by all models in one narrow stage; features that
    differ by fold are scored fold by fold and averaged by key.
    """
    if not callable(holdout):
        return M.score_holdout(holdout, models).select("context_id", "reply_id", "rank")
    parts = None
    for f, model in models.items():
        part = M.predict(model, holdout(f)).select("context_id", "reply_id", "pred")
        parts = part if parts is None else parts.unionByName(part)
    return average_scores(parts, ["context_id", "reply_id"], "pred")


def train_and_rank(
    features: DataFrame | FoldTables,
    estimator: Estimator,
    folds: int,
    holdout: DataFrame | Callable[[int], DataFrame] | None = None,
    gain: str | None = "target",
    early_stopping: bool = False,
    rounds: int = STOP_ROUNDS,
    parallelism: int = 1,
) -> Trained:
    """One model per fold, its errors and NDCG, and the averaged ranking of the hold-out rows.

    Each row is scored once per model; all metrics read those settled scores.
    """
    models = M.fit_folds(features, estimator, folds, early_stopping, rounds, parallelism)
    scored = settle(packed(M.score_folds(features, models, ("valid", "train")).select(*_COLUMNS)))
    report = settle(fold_report(scored, "target", "pred", "context_id", "reply_id", gain))
    ranked = None if holdout is None else holdout_scores(models, holdout)
    return Trained(models, scored, report, cv_mean(report, ["ndcg", "mse", "mae"]), ranked)


def fold_number(train: DataFrame, holdout: DataFrame, least: int = 2) -> int:
    """Folds of a job from the sizes of its tables: train over hold-out, rounded half to even, ``least`` at any rate."""
    return max(least, fold_count(train, holdout).first()["folds"] or 0)


@dataclass
class Blended:
    models: dict[int, dict[str, object]]
    predictions: DataFrame
    report: DataFrame
    choices: DataFrame
    loss: DataFrame
    ranked: DataFrame | None


def learner_report(preds: DataFrame, names: Sequence[str], k: int = 3) -> DataFrame:
    """``(fold, model, ndcg, mse)`` of every learner on its valid rows, NDCG cut at ``k``."""
    out = None
    for name in names:
        scores = mean_ndcg(ndcg(preds, ["fold", "context_id"], "target", name, "reply_id", k), ["fold"])
        loss = preds.groupBy("fold").agg(mse("target", name).alias("mse"))
        part = scores.join(loss, "fold").select("fold", F.lit(name).alias("model"), F.col("mean_ndcg").alias("ndcg"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


def blend_and_rank(
    features: FoldTables,
    estimators: Mapping[str, Estimator],
    folds: int,
    holdout: Callable[[int], DataFrame] | None = None,
    lower_is_better: bool = True,
    early_stopping: bool = False,
    rounds: int = STOP_ROUNDS,
    parallelism: int = 1,
) -> Blended:
    """Several learners per fold, the best single model or blend by valid loss, and its hold-out ranking.

    Learners with early stopping are the boosted ones; the linear one is fitted as it is. Learners of all folds are
    fitted side by side, ``parallelism`` at a time.
    """
    names = list(estimators)
    models: dict[int, dict[str, object]] = {f: {} for f in range(folds)}

    def fit(task: tuple[int, str]) -> object:
        train, valid = features(task[0])
        estimator = estimators[task[1]]
        if early_stopping and hasattr(estimator, "getMaxDepth"):
            return M.fit_early_stopped(estimator, train, valid, rounds)[0]
        return estimator.fit(train)

    tasks = [(f, name) for f in range(folds) for name in names]
    for (f, name), model in zip(tasks, M.side_by_side(fit, tasks, parallelism)):
        models[f][name] = model
    parts = None
    for f in range(folds):
        valid = features(f)[1]
        scored = M.score_models(valid, models[f]).select("context_id", "reply_id", "target", F.lit(f).alias("fold"), *names)
        parts = scored if parts is None else parts.unionByName(scored)
    preds = settle(parts)
    report = learner_report(preds, names)
    choices = settle(B.best_choice(preds, "target", names, ["fold"], lower_is_better))
    ranked = None
    if holdout is not None:
        rows = None
        for f in range(folds):
            part = M.score_models(holdout(f), models[f]).select("context_id", "reply_id", F.lit(f).alias("fold"), *names)
            rows = part if rows is None else rows.unionByName(part)
        ranked = B.blended_holdout(rows, choices, ["context_id", "reply_id"], names)
    return Blended(models, preds, report, choices, choices.agg(F.avg("loss").alias("cv_loss")), ranked)
