"""Blends of several models' scores.

Predictions are wide, one column per model, so every combination is an
expression on the row: losses need one map-side aggregate and no row is
repeated or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import WAYS, blend

# Loss columns aggregated in one pass.
_PER_PASS = 120


def model_combinations(models: Sequence[str], max_size: int | None = None) -> list[tuple[str, ...]]:
    """Subsets of 2 … n-1 models, by size, in model order."""
    top = len(models) - 1 if max_size is None else max_size
    return [c for size in range(2, top + 1) for c in combinations(models, size)]


def combo_name(members: Sequence[str]) -> str:
    return "_".join(members)


def wide_predictions(long: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One column per model from ``(keys, model, pred)`` rows."""
    return long.groupBy(*keys).pivot("model", list(models)).agg(F.first("pred"))


def blend_scores(preds: DataFrame, keys: Sequence[str], models: Sequence[str], max_size: int | None = None) -> DataFrame:
    """``(keys, combo, mean, geom, harmonic)`` for every combination."""
    entries = [
        F.struct(
            F.lit(combo_name(c)).alias("combo"),
            *[blend([F.col(m) for m in c], way).alias(way) for way in WAYS],
        )
        for c in model_combinations(models, max_size)
    ]
    return preds.select(*keys, F.inline(F.array(*entries)))


def _losses(preds: DataFrame, y: str, named: Sequence[tuple], by: Sequence[str]) -> DataFrame:
    """Long ``(by, label…, loss)`` from (label struct, prediction) pairs."""
    parts = []
    for start in range(0, len(named), _PER_PASS):
        chunk = named[start : start + _PER_PASS]
        cols = [f"l{start + i}" for i in range(len(chunk))]
        sums = preds.groupBy(*by).agg(
            *[F.avg(F.pow(F.col(y) - pred, F.lit(2.0))).alias(c) for c, (_, pred) in zip(cols, chunk)]
        )
        rows = [F.struct(*label, F.col(c).alias("loss")) for c, (label, _) in zip(cols, chunk)]
        parts.append(sums.select(*by, F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blend_losses(
    preds: DataFrame, y: str, models: Sequence[str], by: Sequence[str] = (), max_size: int | None = None
) -> DataFrame:
    """MSE of every (combination, way), with the ordinals that break ties."""
    named = [
        (
            (
                F.lit(combo_name(c)).alias("combo"),
                F.array(*[F.lit(m) for m in c]).alias("members"),
                F.lit(way).alias("way"),
                F.lit(len(WAYS) * i + j).alias("ordinal"),
            ),
            blend([F.col(m) for m in c], way),
        )
        for i, c in enumerate(model_combinations(models, max_size))
        for j, way in enumerate(WAYS)
    ]
    return _losses(preds, y, named, by)


def model_losses(preds: DataFrame, y: str, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    named = [((F.lit(m).alias("model"), F.lit(i).alias("ordinal")), F.col(m)) for i, m in enumerate(models)]
    return _losses(preds, y, named, by)


def _first_best(df: DataFrame, by: Sequence[str], cols: Sequence[str], lower_is_better: bool) -> DataFrame:
    """Row with the best loss per group; the lowest ordinal wins a tie, a missing loss never wins."""
    known = df.where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    key = F.col("loss") if lower_is_better else -F.col("loss")
    pick = F.min_by(F.struct(*cols, "loss"), F.struct(key, F.col("ordinal"))).alias("__pick")
    return known.groupBy(*by).agg(pick).select(*by, "__pick.*")


def best_blend(losses: DataFrame, by: Sequence[str] = (), lower_is_better: bool = True) -> DataFrame:
    """The best combination by its best way."""
    return _first_best(losses, by, ["combo", "members", "way"], lower_is_better)


def best_choice(
    preds: DataFrame, y: str, models: Sequence[str], by: Sequence[str] = (), lower_is_better: bool = True
) -> DataFrame:
    """Best of the single models and of the best blend, per group.

    ``best`` is a model name or ``averaged``; ``way`` and ``members`` tell how to score with it.
    """
    blended = best_blend(blend_losses(preds, y, models, by), by, lower_is_better).select(
        *by, F.lit("averaged").alias("best"), "way", "members", "loss", F.lit(len(models)).alias("ordinal")
    )
    single = model_losses(preds, y, models, by).select(
        *by,
        F.col("model").alias("best"),
        F.lit(None).cast("string").alias("way"),
        F.array("model").alias("members"),
        "loss",
        "ordinal",
    )
    return _first_best(single.unionByName(blended), by, ["best", "way", "members"], lower_is_better)


def chosen_score(models: Sequence[str], max_size: int | None = None):
    """Score of a row under the choice in its ``way`` and ``members`` columns."""
    out = F.lit(None).cast("double")
    for c in model_combinations(models, max_size):
        same = F.concat_ws("_", "members") == combo_name(c)
        for way in WAYS:
            out = F.when(same & (F.col("way") == way), blend([F.col(m) for m in c], way)).otherwise(out)
    for m in models:
        out = F.when(F.col("way").isNull() & (F.col("members")[0] == m), F.col(m)).otherwise(out)
    return out


def blended_holdout(
    preds: DataFrame, choices: DataFrame, keys: Sequence[str], models: Sequence[str], out: str = "rank"
) -> DataFrame:
    """Hold-out rows scored by each fold's choice, averaged over folds and negated.

    ``preds`` is ``(fold, keys, one column per model)``; ``choices`` has one row per
    fold, hence the broadcast.
    """
    scored = preds.join(F.broadcast(choices.select("fold", "way", "members")), "fold")
    scored = scored.select(*keys, chosen_score(models).alias("__score"))
    return scored.groupBy(*keys).agg((-F.avg("__score")).alias(out))
