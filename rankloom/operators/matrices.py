"""Products of a sparse matrix, held as a table, with dense blocks; sums of number arrays, added in a tree on the executors.

A sparse matrix X is a long table (keys, idx, weight). Its rows are dealt into ranges, and a range is cut into tiles by block
of ``idx``. A dense matrix V is a table with one row (block, v) per block of rows. Ranges are the unit of work: no column,
however frequent, draws cells into one task, and no vector per cell or per text travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, shuffle_width

# Sums that reach the driver at most, whatever the number of tasks; rows of a range at most, and cells that are multiplied
# at a time.
SUMS, RANGE, CHUNK = 16, 8192, 16_384

Batches = Iterator[pa.RecordBatch]
_SUM = "high array<double>, low array<double>"


def lists(rows: np.ndarray) -> pa.Array:
    """A column of equally long lists from the rows of a matrix."""
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    ends = np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype=np.int64)[: len(rows) + 1]
    return pa.LargeListArray.from_arrays(ends, pa.array(rows.reshape(-1))).cast(pa.list_(pa.float64()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column without nulls, all of ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _two_parts(total: np.ndarray) -> pa.RecordBatch:
    """A sum of extended precision as two doubles."""
    high = total.astype(np.float64)
    return pa.RecordBatch.from_arrays([lists(high[None, :]), lists((total - high).astype(np.float64)[None, :])], names=["high", "low"])


def _added(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = np.zeros(size, np.longdouble)
        for batch in batches:
            for column in batch.columns:
                for row in matrix(column, size):
                    total += row
        yield _two_parts(total)

    return run


def summed(df: DataFrame, share: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of what ``share`` makes of a batch: ``size`` numbers, in extended precision.

    A task adds the shares of its batches; the tasks' sums are dealt to at most ``SUMS`` tasks and added again there,
    so the driver gets ``SUMS`` arrays at most.
    """

    def run(batches: Batches) -> Batches:
        total = np.zeros(size, np.longdouble)
        for batch in batches:
            if batch.num_rows:
                total += share(batch).reshape(-1)
        yield _two_parts(total)

    parts = df.mapInArrow(run, _SUM).repartition(SUMS).mapInArrow(_added(size), _SUM).collect()
    out = np.zeros(size, np.longdouble)
    for r in parts:
        out += np.array(r["high"])
        out += np.array(r["low"])
    return out


_TILE = "struct<block:long,row:array<int>,at:array<int>,w:array<double>>"


def _ranges(block: int, most: int, slots: int) -> Callable[[Batches], Batches]:
    """Rows (id, slots, features, weights) to ranges of rows, each cut into tiles of ``block`` features. Each slot is a row of X."""

    def run(batches: Batches) -> Batches:
        g = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                slot, at, w = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                row = np.repeat(np.arange(part.num_rows, dtype=np.int32) * slots, part.column(1).value_lengths().to_numpy(zero_copy_only=False)) + slot
                # Cells of a row come in any order.
                within = np.argsort(row, kind="stable")
                row, at, w = row[within].astype(np.int32), at[within].astype(np.int64), w[within]
                order = np.argsort(at // block, kind="stable")
                blocks, first = np.unique(at[order] // block, return_index=True)
                ends = pa.array(np.r_[first, len(order)], pa.int32())
                cut = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (row, (at % block).astype(np.int32), w)]
                tiles = pa.StructArray.from_arrays([pa.array(blocks), *cut], names=["block", "row", "at", "w"])
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), tiles)]
                yield pa.RecordBatch.from_arrays([pa.array([g]), *one], names=["g", "ids", "tiles"])
                g += 1

    return run


def added_to(out: np.ndarray, to: np.ndarray, weight: np.ndarray, of: np.ndarray, source: np.ndarray) -> None:
    """out[to] += weight * source[of], for ``to`` in order."""
    for lo in range(0, len(to), CHUNK):
        at = to[lo : lo + CHUNK]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] += np.add.reduceat(weight[lo : lo + CHUNK, None] * source[of[lo : lo + CHUNK]], first, axis=0)


def projected(batches: Batches, turn: np.ndarray, slots: int = 1):
    """Range by range: its number, the ids of its rows, its tiles and its rows of X (V turn).

    Tiles of a range come one after the other, beside V of their block.
    """
    held, width = None, len(turn)
    for batch in batches:
        for i in range(batch.num_rows):
            g, block = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if held is None or held[0] != g:
                if held is not None:
                    yield *held[:3], held[3] @ turn
                ids = batch.column(1)[i].values
                held = (g, ids, [], np.zeros((len(ids) * slots, width)))
            if block is None:
                continue
            row, at, w = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            held[2].append((block, row, at, w))
            if batch.column(6)[i].is_valid:
                added_to(held[3], row, w, at, batch.column(6)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width))
    if held is not None:
        yield *held[:3], held[3] @ turn


def _scored(turn: np.ndarray, slots: int) -> Callable[[Batches], Batches]:
    """X (V turn), id by id, its slots end to end."""

    def run(batches: Batches) -> Batches:
        for _, ids, _, y in projected(batches, turn, slots):
            yield pa.RecordBatch.from_arrays([ids, lists(y.reshape(len(ids), -1))], names=["id", "y"])

    return run


def row_ranges(weights: DataFrame, keys: Sequence[str], block: int, slots: int = 1) -> DataFrame:
    """(g, ids, tiles): ranges of the rows of X, with their keys. A row's cells are gathered by one shuffle, or by none if its
    keys lie together already; cells without ``idx`` keep their row alive. With ``slots`` a key has as many rows of X, and its
    cells say in ``slot`` which one they are in."""
    slot = F.col("slot").cast("int") if slots > 1 else F.lit(0)
    cell = F.struct(slot.alias("slot"), F.col("idx").cast("long").alias("at"), F.col("weight").cast("double").alias("w"))
    per = weights.groupBy(*keys).agg(F.collect_list(F.when(F.col("idx").isNotNull(), cell)).alias("c"))
    per = per.select(F.struct(*keys).alias("id"), F.col("c.slot").alias("slot"), F.col("c.at").alias("at"), F.col("c.w").alias("w"))
    return per.mapInArrow(_ranges(block, RANGE, slots), f"g long, ids array<{per.schema['id'].dataType.simpleString()}>, tiles array<{_TILE}>")


def beside(ranges: DataFrame, dense: DataFrame, dense_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Tiles with V of their block, range by range. V is sent to every executor up to ``limit`` bytes, else both are shuffled."""
    tiles = ranges.select("g", "ids", F.explode_outer("tiles").alias("t")).select("g", "ids", "t.*")
    small = dense_bytes <= limit
    met = tiles.join(F.broadcast(dense) if small else dense, "block", "left").select("g", "ids", "block", "row", "at", "w", "v")
    # A broadcast join keeps the order of the tiles.
    return met if small else met.repartition(shuffle_width(ranges.sparkSession), "g").sortWithinPartitions("g", "block")


def product(met: DataFrame, keys: Sequence[str], turn: np.ndarray, out: str = "vector", slots: int = 1) -> DataFrame:
    """X (V turn) of what `beside` gives: (keys, out), a key's slots end to end."""
    ids = met.schema["ids"].dataType.elementType.simpleString()
    return met.mapInArrow(_scored(turn, slots), f"id {ids}, y array<double>").select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("y").alias(out))
