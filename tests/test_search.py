import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from rankloom.operators import folds as D
from rankloom.operators import learners as M
from rankloom.plans import search as H


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    rows = [(i % 30, i, Vectors.dense([float(a)]), float(2 * a + rng.normal())) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, ["context_id", "reply_id", "features", "target"])
    return D.assign_folds(df, ["reply_id"], 4).cache()


def test_grid():
    assert H.grid({"a": [1, 2], "b": "xy"}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]


@pytest.mark.parametrize("folds,settings,halving,want", [
    (5, 8, True, [(8, 1), (4, 2), (2, 4), (1, 5)]), (4, 3, True, [(3, 1), (2, 2), (1, 4)]), (1, 3, True, [(3, 1)]), (5, 8, False, [(8, 5)]),
])
def test_rungs(folds, settings, halving, want):
    assert H.rung_folds(folds, settings, halving) == want


@pytest.mark.parametrize("halving", [True, False])
def test_losses_are_those_of_single_fits(data, halving):
    ridges = [0.0, 1.0, 100.0]
    found = H.search(data, M.linear, H.grid({"ridge": ridges}), 4, halving=halving, parallelism=4)
    for trial in found:
        each = []
        for f in range(trial.folds):
            model = M.linear(**trial.setting).fit(D.train_rows(data, f))
            rows = M.predict(model, D.valid_rows(data, f)).collect()
            each.append(np.mean([(r.pred - r.target) ** 2 for r in rows]))
        assert trial.loss == pytest.approx(np.mean(each))
    assert [t.setting["ridge"] for t in found] == ridges
    assert [t.folds for t in found] == ([4, 2, 1] if halving else [4, 4, 4])


def test_ranking_loss_and_ties(data):
    found = H.search(data, M.linear, H.grid({"ridge": [1.0, 0.0]}), 2, H.ranking_loss(k=2), halving=False)
    assert all(0 <= t.loss <= 1 for t in found)
    assert [t.setting["ridge"] for t in found] == [1.0, 0.0]  # a ridge on one column changes no order
