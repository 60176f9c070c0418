"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random directions, shifted, quantised and put in Hilbert order, several times with other
directions and shifts. Quantiles of the keys cut each order into blocks of a bounded number of rows. A query reads the
blocks around its own key, a fixed share of each order, and the results of all orders are merged and ranked again by the
inner product of the original vectors. A block's rows are held as one matrix and queries pass by in batches, so a task
holds a bounded number of vectors, and a query meets a block as a matrix product rather than as joined rows.

For inner products candidates get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero, as
in the usual reduction to nearness by angle.

The share of each order read is a constant of the operator: it sets the recall, alike at every size. See README for
measured recall.

Defined cases: null vectors, vectors of another length than most, zero vectors and vectors with null, NaN or infinite
components take no part, neither as queries nor as candidates; null ids take no part; of rows that
share an id the smallest vector counts, as query and as candidate; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

ORDERS, DIRECTIONS, SHARE = 3, 4, 0.5
BITS = 10
BLOCK_ROWS = 4096
SEED = 20240517


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points, one row each, after Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(width: int, orders: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions for all orders while the space has room, then anew; and one shift for each."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    rows: list[np.ndarray] = []
    while len(rows) < orders * dims:
        rows.extend(np.linalg.qr(draw.standard_normal((width, width)))[0].T)
    return np.stack(rows[: orders * dims]).reshape(orders, dims, width), draw.uniform(-0.5, 0.5, (orders, dims))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """One row (id, v) per id, of vectors that can take part; of several the smallest counts."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def _placed(width: int, orders: int, dims: int, most: float):
    rows, shifts = directions(width + 1, orders, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            square = (x * x).sum(axis=1)
            query = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            more = np.where(query, 0.0, np.sqrt(np.maximum(most * most - square, 0.0)))
            x = np.column_stack([x, more]) / np.where(query, np.sqrt(square), most)[:, None]
            keys = []
            for o in range(orders):
                # Components of unit vectors along a direction spread by about 1 / sqrt(width): four spreads to each side.
                p = (x @ rows[o].T) * np.sqrt(width) + shifts[o]
                cells = np.clip((p / 9 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
                keys.append(hilbert_keys(cells, BITS))
            keys = np.stack(keys, axis=1).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, orders), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "asks", "keys"])

    return run


def _met(k: int, width: int, most: float):
    """Best k candidates of a block for each query that passes; rows come by slot, candidates first.

    Scores are compared as cosines rounded to 11 places, so that ties are ties however the products were summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, block = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            own = batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            out = [], [], []
            for lo, hi in zip([0, *edges], [*edges, len(at)]):
                if at[lo] != slot:
                    slot, ids, block = at[lo], [], []
                if kind[lo] == 0:
                    ids.append(own[lo:hi]), block.append(x[lo:hi])
                    continue
                if not ids:
                    continue
                ids, block = [np.concatenate(ids)], [np.concatenate(block)]
                for i in range(lo, hi, 512):
                    asked, q = own[i : min(i + 512, hi)], x[i : min(i + 512, hi)]
                    score = np.round((q / (most * np.sqrt((q * q).sum(axis=1)))[:, None]) @ block[0].T, 11)
                    score[ids[0][None, :] == asked[:, None]] = -np.inf
                    n = min(k, len(ids[0]))
                    limit = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                    for a, s, least in zip(asked, score, limit):
                        best = np.flatnonzero((s >= least) & np.isfinite(s))
                        best = best[np.lexsort((ids[0][best], -s[best]))][:k]
                        out[0].append(a), out[1].append(ids[0][best]), out[2].append(s[best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))],
                names=["query_id", "ids", "scores"],
            )

    return run


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    orders: int = ORDERS,
    dims: int = DIRECTIONS,
    share: float = SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each query the k candidates of largest inner product found: query_id, rank, vec_id, score.

    ``asks`` tells by the column id which rows are queries; all rows are candidates, a query's own aside.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors, vec_id, vector), "vectors")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width, count = widths[0]["w"], widths[0]["n"]
    rows = rows.where(F.size("v") == width)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    most = rows.agg(F.max(norm)).first()[0] * (1 + 1e-9)
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of anything.
    alike = F.row_number().over(W.partitionBy("v").orderBy("id"))
    candidates = rows.withColumn("place", alike).where(f"place <= {k + 1}").select("id", "v", F.lit(False).alias("asks"))
    queries = rows.where(asks).select("id", "v", F.lit(True).alias("asks"))
    kind = rows.schema["v"].dataType.simpleString()
    keyed = candidates.unionByName(queries).mapInArrow(_placed(width, orders, dims, most), f"id long, v {kind}, asks boolean, keys array<long>")
    keyed = stored(keyed, "keyed")
    # Blocks so large that a window holds more than k rows; a table smaller than that is one block.
    blocks = min(max(8, -(-count // block_rows)), max(1, count // (4 * (k + 1))))
    placed = None
    for o in range(orders):
        one = keyed.select("id", "v", "asks", F.col("keys")[o].alias("key"))
        one = one.repartitionByRange(blocks, "key", "id").select("id", "v", "asks", F.lit(o).alias("order"), F.spark_partition_id().alias("block"))
        placed = one if placed is None else placed.unionByName(one)
    placed = stored(placed, "placed")
    # Partitions of a union count on from one order to the next; whatever their number, they make ``blocks`` blocks.
    ends = placed.groupBy("order").agg(F.max("block").alias("last"), F.min("block").alias("first"))
    placed = placed.join(F.broadcast(ends), "order")  # one row for each order
    at = F.floor((F.col("block") - F.col("first")) * blocks / (F.col("last") - F.col("first") + 1))
    placed = placed.withColumn("block", at.cast("long"))
    reach = -int(-(blocks * share - 1) // 2)
    # Windows at the ends of an order are moved inwards, so that each holds as many blocks.
    low = F.greatest(F.lit(0), F.least(F.col("block") - reach, F.lit(blocks - 1 - 2 * reach)))
    high = F.least(F.lit(blocks - 1), low + 2 * reach)
    slot = lambda block: (F.col("order").cast("long") * (1 << 32) + block).alias("slot")
    held = placed.where("not asks").select(slot(F.col("block")), F.lit(0).alias("kind"), "id", "v")
    sent = placed.where("asks").withColumn("to", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    sent = sent.select(slot(F.col("to")), F.lit(1).alias("kind"), "id", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = held.unionByName(sent).repartition(parts, "slot").sortWithinPartitions("slot", "kind")
    met = met.mapInArrow(_met(k, width, most), "query_id long, ids array<long>, scores array<double>")
    found = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("m")).groupBy("query_id", F.col("m.ids").alias("vec_id"))
    found = found.agg(F.max("m.scores").alias("near"))
    by_near = W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    found = found.withColumn("place", F.row_number().over(by_near)).where(f"place <= {k}").select("query_id", "vec_id")
    # Scores anew, one component after the other, on the original vectors: the same wherever a pair met.
    found = found.join(rows.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    found = found.join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("c")), "vec_id")
    product = F.aggregate(F.zip_with("q", "c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    found = found.select("query_id", "vec_id", product.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score")
