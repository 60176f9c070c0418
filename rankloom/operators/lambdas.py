"""A ranking objective for boosted trees: pairwise gradients of NDCG within a context (2.12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import discounted
from ..session import BROADCAST_BYTES, settle, table_bytes
from ..settings import RANK_POSITIONS, STOP_CHUNK, STOP_ROUNDS
from .learners import TrimmedBoost, best_round, ensemble, has_stopped, one_tree
from .numbering import HOT_ROWS, same_keys, split_hot
from .ranking import best_first, ndcg, top_k

# Largest step a row asks of one tree, before the learning rate.
MOST_STEP = 10.0
# Bytes of one entry of a context's head, the sums owed to it included.
_ENTRY_BYTES = 96


@dataclass(frozen=True)
class RankTask:
    """What is ranked: candidates told apart by ``tie`` within ``context``, by ``gain``, up to place ``k``."""

    context: tuple[str, ...] = ("context_id",)
    tie: str = "reply_id"
    gain: str = "target"
    k: int = RANK_POSITIONS
    method: int = 1


def _beside_context(rows: DataFrame, heads: DataFrame, context: Sequence[str], marks: Sequence[str], k: int, hot_rows: int, limit: int) -> DataFrame:
    """Rows beside the one row of their context: sent whole while small, else by shuffle with hot contexts apart."""
    on = same_keys(context, marks)
    if table_bytes(heads, k * _ENTRY_BYTES) <= limit:
        return rows.join(F.broadcast(heads), on, "left").drop(*marks)
    cold, hot = split_hot(rows, context, hot_rows)
    out = cold.join(heads, on, "left").drop(*marks)
    if hot is None:
        return out
    # At most rows / hot_rows contexts are hot, and each has one row of k entries.
    names = [f"__n{i}" for i in range(len(context))]
    few = hot.groupBy(*[F.col(c).alias(n) for c, n in zip(context, names)]).agg(F.count("*").alias("__rows")).drop("__rows")
    few = heads.join(few, same_keys(marks, names), "left_semi")
    return out.unionByName(hot.join(F.broadcast(few), on, "left").drop(*marks))


def rank_gradients(
    df: DataFrame, task: RankTask, score: str, hot_rows: int = HOT_ROWS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with ``gradient`` and ``curvature``: how far each score should move to raise NDCG at ``k``.

    A pair of candidates with different gains counts by what their exchange would change in the NDCG, times the
    chance, by their scores, that the lower gain stands first. An exchange of two candidates behind place ``k``
    changes nothing, so a row meets the first ``k`` rows of its context alone: work grows with rows times ``k``, and no
    pair becomes a row. What the rows behind owe the first ``k`` are sums per context, added in the map tasks.

    A null gain or score counts as 0; contexts without positive gains, or with equal ones, have no gradient.
    """
    context, k = list(task.context), task.k
    marks, others = [f"__c{i}" for i in range(len(context))], [f"__o{i}" for i in range(len(context))]
    number = {"__t": F.col(task.tie), "__g": F.coalesce(F.col(task.gain).cast("double"), F.lit(0.0)), "__s": F.coalesce(F.col(score).cast("double"), F.lit(0.0))}
    rows = df.withColumns(number)
    lean = rows.select(*context, *number)
    worth = discounted(F.lit(1.0), F.col("__at"), task.method)
    entry = F.struct("__at", F.col("__t").alias("t"), F.col("__g").alias("g"), F.col("__s").alias("s"), worth.alias("d"))
    first = top_k(lean, context, best_first("__s", "__t"), k, "__at").groupBy(*[F.col(c).alias(m) for c, m in zip(context, marks)])
    heads = first.agg(F.sort_array(F.collect_list(entry)).alias("__head"))
    best = top_k(lean, context, best_first("__g", "__t"), k, "__at").groupBy(*[F.col(c).alias(o) for c, o in zip(context, others)])
    ideal = best.agg(F.sum(F.col("__g") * worth).alias("__ideal")).where("__ideal > 0")
    heads = settle(heads.join(ideal, same_keys(marks, others)).drop(*others))

    def pair(h: Column) -> Column:
        side = F.signum(F.col("__g") - h["g"])
        chance = 1 / (1 + F.exp(side * (F.col("__s") - h["s"])))
        change = F.abs(F.col("__g") - h["g"]) * F.abs(F.col("__d") - h["d"]) / F.col("__ideal")
        return F.struct((side * chance * change).alias("g"), (chance * (1 - chance) * change).alias("c"))

    def met(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Rows with their pairs and, for those in the head, their own entry."""
        rows = _beside_context(rows, heads, context, marks, k, hot_rows, broadcast_bytes)
        own = F.try_element_at(F.filter("__head", lambda h: h["t"].eqNullSafe(F.col("__t"))), F.lit(1))
        rows = rows.withColumn("__own", own).withColumn("__d", F.coalesce(F.col("__own")["d"], F.lit(0.0)))
        return rows.withColumn("__pairs", F.transform("__head", pair))

    behind = met(lean, heads).where("__own is null and __head is not null")
    owed = behind.groupBy(*[F.col(c).alias(o) for c, o in zip(context, others)]).agg(
        *[F.sum(F.try_element_at("__pairs", F.lit(i + 1))[p]).alias(f"__{p}{i}") for p in "gc" for i in range(k)]
    )
    listed = [F.array(*[F.coalesce(F.col(f"__{p}{i}"), F.lit(0.0)) for i in range(k)]).alias(f"__owed_{p}") for p in "gc"]
    heads = settle(heads.join(owed.select(*others, *listed), same_keys(marks, others), "left").drop(*others))

    at = F.coalesce(F.col("__own")["__at"].cast("int"), F.lit(k + 1))

    def total(part: str, sign: int) -> Column:
        mine = F.aggregate("__pairs", F.lit(0.0), lambda a, p: a + p[part])
        theirs = F.coalesce(F.try_element_at(f"__owed_{part}", at), F.lit(0.0))
        return F.coalesce(mine + sign * theirs, F.lit(0.0))

    return met(rows, heads).select(*df.columns, total("g", -1).alias("gradient"), total("c", 1).alias("curvature"))


def fit_ranked(
    estimator: GBTRegressor,
    train: DataFrame,
    task: RankTask,
    valid: DataFrame | None = None,
    rounds: int = STOP_ROUNDS,
    chunk: int = STOP_CHUNK,
) -> tuple[TrimmedBoost, list[float]]:
    """Trees that raise NDCG at ``task.k``; with ``valid``, until ``rounds`` of them in a row do not, and the best round.

    A tree is fitted on gradient over curvature, weighted by curvature, so that a leaf takes the Newton step of its rows. Rows
    without a gradient tell a tree nothing and stay out; once none has one, training ends, and without any all scores are 0. Losses are one less mean NDCG.
    """
    features, rate, most = estimator.getFeaturesCol(), estimator.getStepSize(), estimator.getMaxIter()
    keep = list(dict.fromkeys([*task.context, task.tie, task.gain, features]))
    one = one_tree(estimator).setWeightCol("__weight")
    tables = [settle(df.select(*keep, F.lit(0.0).alias("__so_far"))) for df in (train, valid) if df is not None]
    trees: list[RandomForestRegressionModel] = []
    losses: list[float] = []
    ended = False
    while len(trees) < most and not ended and not has_stopped(losses, rounds):
        names = []
        for _ in range(min(chunk, most - len(trees))):
            steps = rank_gradients(tables[0], task, "__so_far")
            weight = F.greatest("curvature", F.abs("gradient") / MOST_STEP)
            steps = steps.withColumn("__weight", weight).where("__weight > 0")
            steps = settle(steps.select(features, "__weight", (F.col("gradient") / F.col("__weight")).alias("__residual")))
            if steps.isEmpty():
                ended = True
                break
            tree = one.copy({one.seed: estimator.getSeed() + len(trees)}).fit(steps)
            grown = F.col("__so_far") + rate * F.col("__tree")
            tables = [tree.transform(df).withColumn("__so_far", grown).drop("__tree") for df in tables]
            trees.append(tree)
            if valid is not None:
                names.append(f"__f{len(trees)}")
                tables[1] = tables[1].withColumn(names[-1], F.col("__so_far"))
        tables = [settle(df) for df in tables]
        for name in names:
            scores = ndcg(tables[1], task.context, task.gain, name, task.tie, task.k, task.method)
            losses.append(1 - (scores.agg({"ndcg": "avg"}).first()[0] or 0.0))
        if names:
            tables[1] = tables[1].drop(*names)
    if not trees:
        # No context holds different gains: one tree without a split scores all rows alike.
        trees = [one.fit(tables[0].select(features, F.lit(1.0).alias("__weight"), F.lit(0.0).alias("__residual")))]
    kept = best_round(losses, rounds) if valid is not None else len(trees)
    return TrimmedBoost(ensemble(trees[:kept], [rate] * kept, features), kept, len(trees)), losses


@dataclass(frozen=True)
class RankBoost:
    """A boosted learner with the ranking objective, to be used where a regressor is."""

    estimator: GBTRegressor
    task: RankTask = RankTask()

    def fit(self, train: DataFrame) -> TrimmedBoost:
        return fit_ranked(self.estimator, train, self.task)[0]

    def fit_stopped(self, train: DataFrame, valid: DataFrame, rounds: int = STOP_ROUNDS) -> TrimmedBoost:
        return fit_ranked(self.estimator, train, self.task, valid, rounds)[0]
