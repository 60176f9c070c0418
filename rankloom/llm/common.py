"""Helpers shared by the operators: tables on the shared folder, prefix sums, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, scratch_path

# Tables up to this many bytes are sent to every executor, after their size was summed.
SMALL_BYTES = 32 << 20
# The bytes that count as white space in the contracts: space and 0x09 to 0x0D.
WHITE = " \t\n\x0b\x0c\r"


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for `mapInArrow`, whose worker gives unused memory back when the task ends.

    Spark keeps idle workers; what Arrow and the C library hold on to in them is missing to all later work of the executor.
    """

    def task(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # A call of glibc alone: elsewhere int(0) does nothing.
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder on the shared path and read it back: lineage ends, lost executors take nothing along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null beside null; the keys come from ``left``."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def named_in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Give each row of a table of distinct rows a unique integer that follows ``order`` within a partition.

    The numbers are fixed by writing the table, so later readers agree on them.
    """
    return stored(df.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), name)


def running_before(df: DataFrame, group: Sequence[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """For each (group, bucket) the totals of all smaller buckets of the group.

    Rows are summed per bucket first, partly in the map tasks; a window then runs over at most one row for each
    bucket of a group, however many rows the group has.
    """
    per = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return per.select(*group, bucket, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums])


def one_of_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each value of ``keys``: the smallest by all columns, combined in the map tasks first."""
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row")
    return df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(first).select("__row.*")


def send(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A broadcast hint for a table measured as small; any other is joined by shuffle."""
    return broadcast_if_small(df, row_bytes, SMALL_BYTES)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, root), root the smallest node of its component.

    Alternating star contraction: each round hangs the larger neighbours of every node on its smallest one, then the
    smaller ones. Minima are combined in the map tasks; the joins that send them back are split when a node is hot.
    """
    forest = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    forest, seen = stored(forest, "edges"), None
    while True:
        mark = forest.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = forest.union(forest.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        forest = stored(hung.select("e.*").where("u <> v").distinct(), "edges")
    roots = forest.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
