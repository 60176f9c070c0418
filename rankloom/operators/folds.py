"""Reproducible folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import FOLDS, SEED

# Leading hex digits of the hash that name a bucket: 16 ** 4 buckets.
_DIGITS = 4


def _shuffle_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def fold_of(position: Column, total: Column, k: int) -> Column:
    """Fold of a 0-based position: the first ``total mod k`` folds hold one row more."""
    small = F.floor(total / k)
    larger = total % k
    cut = larger * (small + 1)
    after = larger + F.floor((position - cut) / F.greatest(small, F.lit(1)))
    return F.when(position < cut, F.floor(position / (small + 1))).otherwise(after)


def assign_folds(df: DataFrame, keys: Sequence[str], k: int = FOLDS, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Shuffled folds of exact size, a pure function of key and seed.

    Rows are ordered by a hash of their key. Since the hash spreads evenly
    whatever the keys are, its leading digits cut the order into 65,536
    consecutive buckets of like size. Each bucket is numbered on its own and
    the rows in the buckets before are added from a table that never has more
    than 65,536 rows, which is why it may be broadcast and summed in one task.
    """
    keys = list(keys)
    hashed = df.withColumn("__hash", _shuffle_hash(keys, seed)).withColumn(
        "__bucket", F.conv(F.substring("__hash", 1, _DIGITS), 16, 10).cast("int")
    )
    sizes = hashed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy()).alias("__total"),
    )
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy("__hash", *keys))
    return (
        hashed.withColumn("__inside", inside - 1)
        .join(F.broadcast(offsets), "__bucket", "left")
        .withColumn(out, fold_of(F.col("__before") + F.col("__inside"), F.col("__total"), k).cast("int"))
        .select(*df.columns, out)
    )


def assign_group_folds(df: DataFrame, group: str, k: int = FOLDS, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Folds of about equal size that never split a group: a hash of the group key, without a shuffle."""
    head = F.conv(F.substring(_shuffle_hash([group], seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (head % k).cast("int"))


def fold_roles(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Each row once per fold, as ``valid`` in its own and ``train`` in the others."""
    every = F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("__f")
    return df.select("*", every).select(
        *[c for c in df.columns if c != fold],
        F.col("__f").alias(fold),
        F.when(F.col(fold) == F.col("__f"), "valid").otherwise("train").alias("role"),
    )


def train_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def valid_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def rest_of(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in a foreign row list."""
    return df.join(listed.select(*keys), list(keys), "left_anti")


def fold_count(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: train size over test size, rounded half to even."""
    sizes = (
        train.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionAll(test.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        .agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    )
    ratio = F.try_divide(F.col("n_train").cast("double"), F.col("n_test"))
    return sizes.withColumn("folds", F.bround(ratio).cast("long"))
