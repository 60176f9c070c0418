"""Row numbers within groups that stay exact when one group is huge.

A window puts each group into one task. That is the right plan while groups
are small. Groups above ``hot_rows`` rows are numbered by a distributed sort
instead: their rows are range-partitioned on the whole ordering, each partition
numbers its own run, and a table with one row per (group, partition) adds what
lies in the partitions before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, shuffle_width

HOT_ROWS = 2_000_000

_AT, _SLICE, _FIRST, _BEFORE = "__at", "__slice", "__first", "__before"
# monotonically_increasing_id keeps the partition in the bits above 33.
_PARTITION_BITS = 33


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def _number_by_sort(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    ordering = [F.col(k) for k in keys] + list(order)
    placed = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *ordering)
        .sortWithinPartitions(*ordering)
        .withColumn(_AT, F.monotonically_increasing_id())
    )
    placed = settle(placed).withColumn(_SLICE, F.shiftright(_AT, _PARTITION_BITS))
    group = [f"__g{i}" for i in range(len(keys))]
    slices = placed.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(_SLICE).alias("__s")).agg(
        F.min(_AT).alias(_FIRST), F.count("*").alias("__n")
    )
    earlier = W.partitionBy(*group).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn(_BEFORE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return (
        placed.join(slices, same_keys([*keys, _SLICE], [*group, "__s"]))
        .withColumn(name, F.col(_AT) - F.col(_FIRST) + F.col(_BEFORE) + 1)
        .select(*df.columns, name)
    )


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups small enough for one task, and the rows of the others if there are any.

    Only one count per group is computed, partly in the map tasks. There can be
    no more than ``rows / hot_rows`` hot groups.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
    if sizes.isEmpty():
        return df, None
    marks = [f"__h{i}" for i in range(len(keys))]
    hot = settle(sizes.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)]))
    return df.join(hot, same_keys(keys, marks), "left_anti"), df.join(hot, same_keys(keys, marks), "left_semi")


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    orders: Mapping[str, Sequence[Column]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one 1-based row number per entry of ``orders`` within the groups of ``keys``.

    Each ordering must be total, or equal rows get their numbers in any order.
    No keys means one group: the whole table.
    """
    keys = list(keys)
    if keys:
        cold, hot = split_hot(df, keys, hot_rows)
    else:
        large = df.count() > hot_rows
        cold, hot = (None, df) if large else (df, None)
    if cold is not None:
        for name, order in orders.items():
            place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
            cold = cold.withColumn(name, place.cast("long"))
    if hot is None:
        return cold
    for name, order in orders.items():
        hot = _number_by_sort(hot, keys, order, name)
    return hot if cold is None else cold.unionByName(hot)


def earlier_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    names: Mapping[int, str],
    default: str = "",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the value found ``n`` rows earlier in the group, for each ``n: name`` of ``names``."""
    keys = list(keys)
    cold, hot = split_hot(df, keys, hot_rows)
    window = W.partitionBy(*keys).orderBy(*order)
    cold = cold.withColumns({name: F.lag(value, n, default).over(window) for n, name in names.items()})
    if hot is None:
        return cold
    # A huge group is numbered by sort; each value is then sent to the positions that look back at it.
    placed = number_within(hot, keys, {"__at": [F.col(c) for c in order]}, hot_rows)
    steps = F.explode(F.array(*[F.lit(n) for n in names])).alias("__step")
    sent = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__at", F.col(value).alias("__v"), steps)
    sent = sent.withColumn("__at", F.col("__at") + F.col("__step"))
    marks = [f"__k{i}" for i in range(len(keys))]
    found = sent.groupBy(*marks, F.col("__at").alias("__to")).agg(
        *[F.max(F.when(F.col("__step") == n, F.col("__v"))).alias(name) for n, name in names.items()]
    )
    joined = placed.join(found, same_keys([*keys, "__at"], [*marks, "__to"]), "left")
    filled = {name: F.when(F.col("__at") <= n, F.lit(default)).otherwise(F.col(name)) for n, name in names.items()}
    return cold.unionByName(joined.withColumns(filled).select(*cold.columns))
