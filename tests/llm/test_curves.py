import numpy as np
from pyspark.sql import functions as F

from rankloom.llm.curves import hilbert_keys, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_curve_visits_neighbours_one_after_the_other():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores(spark):
    draw = np.random.default_rng(1)
    rows = draw.standard_normal((3000, 24)).astype(np.float32) * draw.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, "s") for i, v in enumerate(rows)], SCHEMA)
    got = nearest(df, F.col("id") % 20 == 0, k=20, block_rows=100).toPandas()
    vectors = {i: v.astype(np.float64) for i, v in enumerate(rows)}
    want = brute(vectors, range(0, 3000, 20), 20)
    hits = sum(len(set(part.vec_id) & set(want[q])) for q, part in got.groupby("query_id"))
    assert len(got) == 150 * 20 and hits >= 0.9 * 150 * 20
    for row in got.head(200).itertuples():
        assert abs(row.score - float(np.dot(vectors[row.query_id], vectors[row.vec_id]))) < 1e-9
    for _, part in got.sort_values("rank").groupby("query_id"):
        assert list(part["rank"]) == list(range(1, 21))
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (20, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (40, []),
    ]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], SCHEMA)
    got = nearest(df, F.col("id") % 20 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0),
    ]
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_one_id_with_two_vectors_counts_by_the_smaller(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [1.0, 5.0]), (2, [0.0, 3.0])]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], SCHEMA)
    got = nearest(df, F.col("id") % 20 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 5.0), (0, 2, 2, 3.0)]
