"""Random forest whose bootstrap is a row hash, with out-of-bag scores as a table (2.12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, exp

from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle, swept
from ..settings import FOREST_TREES, SEED
from .learners import TrimmedBoost, ensemble, side_by_side

# Trees whose scores are added to a table before its lineage is cut.
SCORE_CHUNK = 25
# Bytes of shuffled sums that the trees of one fit may leave on disk side by side, and those of a cell (row, feature) of a level.
SUM_BYTES, CELL_BYTES = 1 << 30, 12


def poisson_steps(most: int = 15) -> list[float]:
    """Chances that a Poisson number of mean one is at most 0, 1, ...: a draw above the i-th step counts i + 1 times or more."""
    steps, term, total = [], exp(-1.0), 0.0
    for i in range(most):
        total += term
        steps.append(total)
        term /= i + 1
    return steps


def bootstrap_count(keys: Sequence[str], tree: int, seed: int = SEED) -> Column:
    """How often a tree draws a row: a Poisson number of mean one, read off a hash of key, seed and tree.

    Drawing with replacement from n rows gives each row about such a number, and this one needs no count of rows, no
    order and no shuffle, and comes out the same after a lost executor. A null in a key counts as an empty string.
    """
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", *shown, F.lit(str(seed)), F.lit(str(tree))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return sum((F.when(draw >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))


def bootstrap_counts(keys: Sequence[str], trees: int, seed: int = SEED) -> Column:
    """`bootstrap_count` of each of the first ``trees`` trees, as an array: one hash for each tree and row.

    A draw is at or above a step if its hexadecimal digits are at or above those of the step, as text.
    """
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    marks = [f"{m:013x}" for m in (ceil(s * (1 << 52)) for s in poisson_steps()) if m < 1 << 52]
    steps = F.array(*[F.lit(m) for m in marks])
    numbers = F.array(*[F.lit(str(i)) for i in range(trees)])
    digests = F.transform(numbers, lambda i: F.md5(F.concat_ws("|", *shown, F.lit(str(seed)), i).cast("binary")))
    return F.transform(digests, lambda d: F.size(F.filter(steps, lambda m: d >= m)).cast("byte"))


@dataclass
class Forest:
    """Trees of a forest and, as one model, their mean."""

    trees: list[RandomForestRegressionModel]
    keys: tuple[str, ...]
    seed: int
    features: str

    @property
    def mean(self) -> TrimmedBoost:
        n = len(self.trees)
        return TrimmedBoost(ensemble(self.trees, [1.0 / n] * n, self.features), n, n)

    def out_of_bag(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """``df`` with ``trees_out``, the trees that never drew the row, and their mean score (null if there are none).

        ``df`` must hold the rows of the fit under their keys. Scores stay on the row: no shuffle.
        """
        df = df.withColumns({"__draws": bootstrap_counts(self.keys, len(self.trees), self.seed), "trees_out": F.lit(0), "__sum": F.lit(0.0)})
        for start in range(0, len(self.trees), SCORE_CHUNK):
            for i, tree in enumerate(self.trees[start : start + SCORE_CHUNK], start):
                scored = tree.copy({tree.predictionCol: "__tree"}).transform(df)
                left_out = F.get("__draws", F.lit(i)) == 0
                df = scored.withColumns({
                    "trees_out": F.col("trees_out") + F.when(left_out, 1).otherwise(0),
                    "__sum": F.col("__sum") + F.when(left_out, F.col("__tree")).otherwise(0.0),
                }).drop("__tree")
            df = settle(df)
        mean = F.when(F.col("trees_out") > 0, F.col("__sum") / F.greatest("trees_out", F.lit(1)))
        return df.withColumn(out, mean).drop("__sum", "__draws")


@dataclass(frozen=True)
class BootstrapForest:
    """Independent trees on bootstrapped rows, to be used where a regressor is.

    A tree grows on the rows its hash draws, weighted by how often. Trees are fitted side by side, each by tasks over all
    partitions. Depth is bounded, since a tree that grows by level until every leaf is pure would be as large as the table.
    """

    trees: int = FOREST_TREES
    depth: int = 10
    min_rows: int = 1
    bins: int = 256
    feature_share: float = 1.0
    seed: int = SEED
    keys: tuple[str, ...] = ("context_id", "reply_id")
    features: str = "features"
    label: str = "target"
    parallelism: int = 8

    def side_by_side(self, rows: int, parts: int, width: int) -> int:
        """Trees to be fitted at a time. A level of a tree shuffles sums per part, node, feature and bin, as many as there are
        cells at most: few trees of a large table go side by side, which keeps the cores busy alone, and many of a small one."""
        cells = sum(min(rows, parts * self.bins << level) for level in range(self.depth)) * width
        return max(1, min(self.parallelism, SUM_BYTES // max(1, cells * CELL_BYTES)))

    def fit_trees(self, train: DataFrame) -> Forest:
        draws = bootstrap_counts(self.keys, self.trees, self.seed).alias("__draws")
        train = settle(train.select(self.features, self.label, draws))
        one = RandomForestRegressor(
            featuresCol=self.features, labelCol=self.label, weightCol="__drawn", numTrees=1, bootstrap=False,
            maxDepth=self.depth, maxBins=self.bins, minInstancesPerNode=self.min_rows,
            featureSubsetStrategy="all" if self.feature_share >= 1 else str(self.feature_share),
        )

        def fit(i: int) -> RandomForestRegressionModel:
            drawn = F.get("__draws", F.lit(i)).cast("double")
            return one.copy({one.seed: self.seed + i}).fit(train.withColumn("__drawn", drawn).where("__drawn > 0"))

        some = train.select(self.features).first()
        together = self.side_by_side(train.count(), train.rdd.getNumPartitions(), len(some[0]) if some and some[0] is not None else 1)
        with swept(train.sparkSession):
            trees = side_by_side(fit, range(self.trees), together)
        return Forest(trees, self.keys, self.seed, self.features)

    def fit(self, train: DataFrame) -> TrimmedBoost:
        return self.fit_trees(train).mean
