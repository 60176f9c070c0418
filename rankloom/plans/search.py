"""Search for settings over shared fold features (2.12)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from math import ceil

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learners as M
from ..operators.folds import train_rows, valid_rows
from ..operators.ranking import ndcg
from ..session import settle

Loss = Callable[[DataFrame, Sequence[str]], list[float]]


def grid(options: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the options, the last one changing fastest."""
    return [dict(zip(options, values)) for values in product(*options.values())]


def squared_loss(target: str = "target") -> Loss:
    """Mean squared error of each column of scores, all in one pass."""

    def losses(scored: DataFrame, names: Sequence[str]) -> list[float]:
        return list(scored.agg(*[F.avg(F.pow(F.col(target) - F.col(n), 2)).alias(n) for n in names]).first())

    return losses


def ranking_loss(context: Sequence[str] = ("context_id",), tie: str = "reply_id", gain: str = "target", k: int = 3) -> Loss:
    """One less the mean NDCG at ``k`` over the contexts."""

    def losses(scored: DataFrame, names: Sequence[str]) -> list[float]:
        return [1 - ndcg(scored, context, gain, n, tie, k).agg({"ndcg": "avg"}).first()[0] for n in names]

    return losses


@dataclass(frozen=True)
class Trial:
    """A setting, the folds it was tried on, its mean loss over them, and the rung in which it was last tried."""

    setting: dict
    folds: int
    loss: float
    rung: int


def rung_folds(folds: int, settings: int, halving: bool = True, keep: float = 0.5) -> list[tuple[int, int]]:
    """(settings, folds) of each rung: folds double from one on while the better settings go on; the last rung has all folds."""
    if not halving:
        return [(settings, folds)]
    out, n = [], 1
    while True:
        out.append((settings, n))
        if n >= folds:
            return out
        n, settings = min(folds, 2 * n), max(1, ceil(settings * keep))


def search(
    features: DataFrame | Callable[[int], tuple[DataFrame, DataFrame]],
    make: Callable[..., Estimator],
    settings: Sequence[dict],
    folds: int,
    loss: Loss | None = None,
    halving: bool = True,
    keep: float = 0.5,
    parallelism: int = 1,
) -> list[Trial]:
    """Losses of the settings, best first; those that went further come first.

    All settings of a fold read the same features, are fitted side by side, and score its valid rows in one narrow stage,
    one column each. With ``halving`` the first fold ranks all settings, and each further rung tries the better part of them
    on folds not seen yet; a loss is the mean over all folds seen. Rows are never sampled: a setting that is left out was
    tried on whole folds. Equal losses go by the order of the settings.
    """
    loss = loss or squared_loss()
    seen: dict[int, list[float]] = {i: [] for i in range(len(settings))}
    alive, done, last = list(seen), 0, {}
    mean = lambda i: sum(seen[i]) / len(seen[i])
    for rung, (count, upto) in enumerate(rung_folds(folds, len(settings), halving, keep)):
        alive = sorted(alive, key=lambda i: (mean(i), i))[:count] if rung else alive
        new = {f: features(f) if callable(features) else (train_rows(features, f), valid_rows(features, f)) for f in range(done, upto)}
        tasks = [(f, i) for f in new for i in alive]
        models = dict(zip(tasks, M.side_by_side(lambda t: make(**settings[t[1]]).fit(new[t[0]][0]), tasks, parallelism)))
        for f, (_, valid) in new.items():
            names = {i: f"__s{i}" for i in alive}
            scored = settle(M.score_models(valid, {names[i]: models[f, i] for i in alive}))
            for i, value in zip(alive, loss(scored, list(names.values()))):
                seen[i].append(value)
        last.update({i: rung for i in alive})
        done = upto
    return [Trial(settings[i], len(seen[i]), mean(i), last[i]) for i in sorted(seen, key=lambda i: (-last[i], mean(i), i))]
