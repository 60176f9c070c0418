"""Shards cut from a Hilbert ordering of metadata, with built-in functions only.

Each dimension is quantised by equal steps between its smallest and largest value, a text dimension by the rank of its
value among the distinct ones, so that values with a common beginning come apart; the steps are the coordinates of a point, and the place of the point on the Hilbert curve orders the rows. Runs of that order become shards whose counts
differ by one at most, so every shard covers a small box of all dimensions at once and its files can be skipped by
the minimum and maximum of any of them.

Ranks come without a global sort in one task: rows are counted per cell, which is a place on the curve and a part of a row
hash; the counts are summed up in three steps, over the leading bits of the cell, the middle ones and the last ones, so that
no window holds more than 2 ** LEAD_BITS or 2 ** 14 rows however dense a part of the curve is. Only rows of one cell meet in
a window: a third of all rows at one place is spread over HASH_PARTS of them.

Defined cases: null values of a dimension share its lowest step; a null text has size 1 and the checksum of no bytes; a
dimension without spread has one step; equal rows get neighbouring slots, which of them gets which makes no difference;
an empty table gives no rows; other columns are not read. A text of any length is read once, for its size and checksum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.numbering import number_within
from .common import joined, running_before, send, stored

BITS = 8
HASH_PARTS = 256
# Leading bits of a cell that are summed in one window: at most 4,096 rows.
LEAD_BITS = 12


def ranked_values(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings of a column replaced by their rank among its distinct values; null stays null.

    Values are counted in the map tasks, and numbered by a distributed sort when there are many of them.
    """
    values = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__rows")).drop("__rows")
    values = stored(number_within(values, [], {"__rank": [F.col(name).cast("binary")]}), "values")
    values = send(values, F.octet_length(name) + 32)
    return joined(rows, values, [name], "left").withColumn(name, F.col("__rank").cast("double")).drop("__rank")


def hilbert_place(coordinates: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with coordinates of ``bits`` bits, after Skilling's transposed form."""
    n = len(coordinates)

    def turn(x: Column, step: Column) -> Column:
        i = step % n
        q = F.pow(F.lit(2), bits - 1 - F.floor(step / n)).cast("long")
        at, first = F.element_at(x, i + 1), F.element_at(x, 1)
        up = at.bitwiseAND(q) != 0
        t = first.bitwiseXOR(at).bitwiseAND(q - 1)
        other = F.when(up, at).otherwise(at.bitwiseXOR(t))
        zero = F.when(up, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(t))
        return F.transform(x, lambda v, j: F.when(j == 0, zero).when(j == i, other).otherwise(v))

    def gray(x: Column) -> Column:
        return F.aggregate(F.slice(x, 2, n - 1), F.slice(x, 1, 1), lambda a, v: F.concat(a, F.array(v.bitwiseXOR(F.element_at(a, -1)))))

    def place(x: Column) -> Column:
        last = F.element_at(x, n)
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        turned = F.transform(x, lambda v: v.bitwiseXOR(t))
        return F.element_at(F.transform(F.array(turned), woven), 1)

    def woven(x: Column) -> Column:
        key = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(F.element_at(x, i + 1), b).bitwiseAND(F.lit(1))
                key = key + F.shiftleft(bit.cast("long"), b * n + n - 1 - i)
        return key

    start = F.array(*[c.cast("long") for c in coordinates])
    steps = F.sequence(F.lit(0), F.lit(n * (bits - 1) - 1))
    turned = F.aggregate(steps, start, turn)
    # One-element arrays bind a value to a lambda variable, so it is computed once.
    grayed = F.transform(F.array(turned), gray)
    return F.element_at(F.transform(grayed, place), 1)


def sharded(
    docs: DataFrame,
    dims: Sequence[Column],
    shards: int = 16,
    text: str = "text",
    doc_id: str = "doc_id",
    bits: int = BITS,
) -> DataFrame:
    """Per row doc_id, size, text_crc32, place, shard and slot; ``dims`` are numeric or text columns of ``docs``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        *[d.alias(f"dim{i}") for i, d in enumerate(dims)],
    )
    rows = stored(rows, "facts")
    texts = {f.name for f in rows.schema if isinstance(f.dataType, StringType) and f.name.startswith("dim")}
    for i in range(len(dims)):
        name = f"dim{i}"
        rows = ranked_values(rows, name) if name in texts else rows.withColumn(name, F.col(name).cast("double"))
    ends = [f(f"dim{i}").alias(f"{name}{i}") for i in range(len(dims)) for name, f in (("low", F.min), ("high", F.max))]
    # One row of minima and maxima.
    rows = rows.join(F.broadcast(rows.agg(*ends, F.count("*").alias("total"))))
    steps = []
    for i in range(len(dims)):
        span = F.col(f"high{i}") - F.col(f"low{i}")
        part = F.when(span > 0, (F.col(f"dim{i}") - F.col(f"low{i}")) / span).otherwise(0.0)
        steps.append(F.least(F.coalesce(F.floor(part * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)))
    rows = rows.withColumn("place", hilbert_place(steps, bits)).select("doc_id", "size", "text_crc32", "place", "total")
    spread = F.xxhash64("doc_id", "text_crc32", "size")
    rows = rows.withColumns({"spread": spread, "cell": F.col("place") * HASH_PARTS + F.pmod(spread, F.lit(HASH_PARTS))})
    rows = stored(rows, "placed")
    width = len(dims) * bits + HASH_PARTS.bit_length() - 1
    low = max(0, width - LEAD_BITS) // 2
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cells.withColumns({"mid": F.shiftright("cell", low), "lead": F.shiftright("cell", max(0, width - LEAD_BITS))})
    cells = stored(cells, "cells")
    outer = running_before(cells, [], "lead", {"outer": F.col("n")})
    middle = running_before(cells, ["lead"], "mid", {"middle": F.col("n")})
    inner = running_before(cells, ["mid"], "cell", {"inner": F.col("n")})
    inner = joined(inner, joined(middle, outer, ["lead"]), ["mid"])
    before = inner.select("cell", (F.col("outer") + F.col("middle") + F.col("inner")).alias("before"))
    within = F.row_number().over(W.partitionBy("cell").orderBy("spread", "doc_id", "size", "text_crc32")) - 1
    rows = joined(rows.withColumn("within", within), before, ["cell"])
    rank = (F.col("before") + F.col("within")).cast("long")
    # Shard s holds the ranks from ceil(s * total / shards) on, so counts differ by one at most.
    rows = rows.withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    first = F.expr(f"(cast(shard as long) * total + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", "place", "shard", (F.col("rank") - first).alias("slot"))


def document_dims(docs: DataFrame) -> list[Column]:
    """Language, source, size on a log scale, and id of a document."""
    return [F.col("lang"), F.col("source"), F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0), F.col("doc_id").cast("double")]


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each file sorted by slot.

    Columns of the documents that are named shard or slot themselves are written as doc_shard and doc_slot.
    """
    taken = {c.lower() for c in docs.columns} | {"shard", "slot"}
    names = {}
    for c in docs.columns:
        if c.lower() in ("shard", "slot"):
            names[c] = f"doc_{c}"
            while names[c].lower() in taken:
                names[c] = f"doc_{names[c]}"
            taken.add(names[c].lower())
    docs = docs.withColumnsRenamed(names)
    at = placed.select(F.col("doc_id").alias("__d"), "text_crc32", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    at = at.withColumnRenamed("text_crc32", "__c")
    mine = docs.withColumn("__crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    # Repeats of a row share id and checksum: each keeps one of their slots.
    again = W.partitionBy("__d", "__c").orderBy("__shard", "__slot")
    once = W.partitionBy(doc_id, "__crc").orderBy(F.lit(0))
    at, mine = at.withColumn("__n", F.row_number().over(again)), mine.withColumn("__m", F.row_number().over(once))
    on = F.col(f"`{doc_id}`").eqNullSafe(F.col("__d")) & (F.col("__crc") == F.col("__c")) & (F.col("__m") == F.col("__n"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = mine.join(at, on).select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
