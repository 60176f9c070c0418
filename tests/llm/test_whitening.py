from fractions import Fraction

import numpy as np
import pytest

from rankloom.llm.whitening import eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", "w") for i, v in rows], SCHEMA)


def plain(vectors):
    """Exact integers, means and deviations; eigenvectors by the usual solver in double precision."""
    x = [[int(np.floor(np.float64(64) * np.float64(np.float32(c)))) + 10**6 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(width)]
    deviation = [sum((n * r[d] - sums[d]) ** 2 for d in range(width)) for r in x]
    centred = np.array([[float(Fraction(n * r[d] - sums[d], n)) for d in range(width)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], axes[:, ::-1]


def orthonormal(draw, width):
    """Columns orthonormal in extended precision."""
    q = draw.standard_normal((width, width)).astype(np.longdouble)
    for _ in range(2):
        for j in range(width):
            q[:, j] -= q[:, :j] @ (q[:, :j].T @ q[:, j])
            q[:, j] /= np.sqrt(q[:, j] @ q[:, j])
    return q


@pytest.mark.parametrize("values", [np.linspace(1, 9, 24), np.r_[np.linspace(1, 2, 20), 3 + np.arange(4) * 1e-9], np.r_[np.full(4, 2.0), np.linspace(3, 4, 20)]])
def test_refined_to_double_precision_also_in_clusters(values):
    q = orthonormal(np.random.default_rng(4), 24)
    a = (q * values) @ q.T
    got, axes = eigen(a)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14 * 9
    assert np.abs(axes.T @ axes - np.eye(24)).max() < 1e-15 * 4
    assert np.abs(a @ axes - axes * got).max() < 1e-15 * 40
    alone = np.array([(np.abs(values - v) < 1e-12).sum() == 1 for v in np.sort(values)[::-1]])
    want = q[:, np.argsort(-values)]
    meet = np.abs((want.T @ axes).astype(float))
    assert np.abs(np.diag(meet)[alone] - 1).max() < 1e-12
    assert (np.abs(meet - np.eye(24))[np.ix_(alone, alone)]).max() < 1e-7


def test_plain_float32_is_not_enough():
    q = orthonormal(np.random.default_rng(4), 24)
    a = ((q * np.linspace(1, 9, 24)) @ q.T).astype(np.float32)
    x = np.linalg.eigh(a)[1].astype(float)
    assert np.abs(x.T @ x - np.eye(24)).max() > 1e-9


def test_whitened_equals_the_plain_computation(spark):
    draw = np.random.default_rng(2)
    base = (draw.standard_normal((700, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    rows = [(i if i % 50 else None, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(5, None), (6, []), (7, [float("nan")] * 40), (8, [float("-inf")] * 40), (9, [None] * 40), (10, [1.0, 2.0])]
    got = whiten(frame(spark, rows).repartition(5)).toPandas()
    n, deviation, centred, values, axes = plain(base)
    assert len(got) == 700 * 32 and set(got.n) == {700} and sorted(got.component.unique()) == list(range(1, 33))
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    known = got[got.vec_id.notna()].sort_values(["component", "vec_id"])
    ids = [i for i in range(700) if i % 50]
    for c in (1, 2, 17, 32):
        part = known[known.component == c]
        want = (centred @ axes[:, c - 1] / np.sqrt(values[c - 1]))[ids]
        sign = np.sign(want[0] * part.whitened.iloc[0])
        assert np.abs(part.whitened.to_numpy() * sign - want).max() < 1e-9
        assert part.explained.iloc[0] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert got.vec_id.isna().sum() == 14 * 32


def test_few_equal_long_and_no_vectors(spark):
    same = whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 2, 0, None, None, None), (2, 2, 0, None, None, None)] * 2
    line = whiten(frame(spark, [(1, [0.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0])])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert sorted(abs(round(r.whitened, 9)) for r in line if r.component == 1) == [0.707106781, 0.707106781, 1.414213562]
    assert all(abs(r.explained - (1.0 if r.component == 1 else 0.0)) < 1e-12 and r.identity_error < 1e-12 for r in line)
    assert {(r.vec_id, r.deviation) for r in line} == {(1, (3 * 0 - 128) ** 2), (2, 64**2)}
    large = whiten(frame(spark, [(i, [float(i % 3) * 2.0**16, 1.0]) for i in range(40)])).collect()
    mean = sum(i % 3 for i in range(40))
    assert all(r.deviation == ((40 * (r.vec_id % 3) - mean) << 22) ** 2 for r in large) and len(large) == 80
    empty = whiten(frame(spark, [(1, None)]))
    assert empty.count() == 0 and whiten(frame(spark, [])).columns == empty.columns
