import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from rankloom.operators import folds as D
from rankloom.operators import learners as M
from rankloom.settings import BOOST_PRESETS
from rankloom.sources import stores

SMALL = {"trees": 12, "leaves": 4, "min_rows": 2, "bins": 16}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 3))
    y = np.sin(x[:, 0] * 2) + 0.5 * x[:, 1] + rng.normal(scale=0.3, size=240)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x.tolist(), y))], ["id", "features", "target"])
    return D.assign_folds(df, ["id"], 3).cache()


def test_presets(spark):
    est = M.boosted("lexical")
    assert (est.getMaxIter(), est.getStepSize(), est.getMaxBins(), est.getMinInstancesPerNode()) == (150, 0.03, 1024, 20)
    assert (est.getSubsamplingRate(), est.getFeatureSubsetStrategy()) == (0.95, "0.9")
    assert 2**est.getMaxDepth() >= 50 > 2 ** (est.getMaxDepth() - 1)
    assert BOOST_PRESETS["embedding"].depth == 5
    assert M.boosted("embedding", trees=3).getMaxIter() == 3


@pytest.mark.parametrize("losses,rounds,want", [
    ([5, 4, 3, 2, 1], 5, 5), ([3, 2, 4, 4, 4, 4, 1], 3, 2), ([3, 2, 4, 4, 1], 3, 5), ([1, 1, 1], 5, 1), ([2, 1, 1, 1, 0.5], 2, 2),
])
def test_best_round(losses, rounds, want):
    assert M.best_round(losses, rounds) == want


def test_early_stopping_scores_with_the_kept_trees(data):
    train, valid = D.train_rows(data, 0), D.valid_rows(data, 0)
    est = M.boosted("embedding", **(SMALL | {"trees": 25, "rate": 0.8}))
    model, losses = M.fit_early_stopped(est, train, valid, rounds=3)
    assert model.kept == M.best_round(losses, 3) < 25
    scored = model.transform(valid, "p").select("target", "p").collect()
    assert np.mean([(r.target - r.p) ** 2 for r in scored]) == pytest.approx(losses[model.kept - 1])


@pytest.mark.parametrize("chunk", [1, 4])
def test_chunks_grow_the_trees_of_the_whole_learner_and_stop(data, chunk):
    train, valid = D.train_rows(data, 0), D.valid_rows(data, 0)
    est = M.boosted("embedding", **(SMALL | {"trees": 500, "rate": 0.8}))
    model, losses = M.fit_early_stopped(est, train, valid, rounds=3, chunk=chunk)
    assert model.fitted == len(losses) <= model.kept + 3 + chunk < 100 and M.has_stopped(losses, 3)
    whole = est.copy({est.maxIter: model.fitted}).fit(train)
    assert losses == pytest.approx(list(whole.evaluateEachIteration(valid, "squared")))
    few = M.fit_early_stopped(est.copy({est.maxIter: 2}), train, valid, rounds=3, chunk=chunk)[0]
    assert few.fitted == 2 and few.kept <= 2


def test_training_loss_falls(data):
    train = D.train_rows(data, 0)
    model = M.boosted("embedding", **SMALL).fit(train)
    losses = model.evaluateEachIteration(train, "squared")
    assert losses[-1] < losses[0]


@pytest.mark.parametrize("parallelism", [1, 3])
def test_every_row_is_scored_once_by_the_model_without_it(data, parallelism):
    models = M.fit_folds(data, M.linear(), 3, parallelism=parallelism)
    assert len({id(m) for m in models.values()}) == 3
    scored = M.score_folds(data, models).collect()
    assert sorted(r.id for r in scored) == list(range(240))
    rows = data.collect()
    for f in range(3):
        x = np.array([[1, *r.features] for r in rows if r.fold != f])
        y = np.array([r.target for r in rows if r.fold != f])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        for r in scored:
            if r.fold == f:
                assert r.role == "valid"
                assert r.pred == pytest.approx(float(np.array([1, *r.features]) @ beta), abs=1e-6)


def test_train_role(data):
    scored = M.score_folds(data, M.fit_folds(data, M.linear(), 3), ("valid", "train"))
    assert scored.count() == 240 * 3


def test_holdout_is_the_negated_mean(data):
    models = M.fit_folds(data, M.linear(), 3)
    got = {r.id: r["rank"] for r in M.score_holdout(data, models).collect()}
    each = [{r.id: r.pred for r in M.predict(m, data).collect()} for m in models.values()]
    assert got == pytest.approx({i: -sum(e[i] for e in each) / 3 for i in got})
    plan = M.score_holdout(data.drop("fold"), models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= data._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_models_survive_the_store(spark, data, tmp_path):
    models = M.fit_folds(data, M.boosted("embedding", **SMALL), 2, early_stopping=True)
    stores.save_models(spark, models, str(tmp_path / "m"))
    back = stores.load_models(spark, str(tmp_path / "m"), 2)
    for f in range(2):
        assert back[f].kept == models[f].kept
        a = [r.p for r in M.predict(models[f], data, "p").orderBy("id").collect()]
        assert [r.p for r in M.predict(back[f], data, "p").orderBy("id").collect()] == pytest.approx(a)


def test_registry(data):
    for name, make in M.LEARNERS.items():
        est = make() if name == "lr" else make(trees=2, leaves=2)
        assert est.fit(data).transform(data).count() == 240
