import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from rankloom.operators import learners as M
from rankloom.operators.lambdas import RankBoost, RankTask, fit_ranked, rank_gradients
from rankloom.operators.ranking import ndcg

SCHEMA = "context_id long, reply_id long, target double, s double, extra string"


def plain(rows, k, method=1):
    """All pairs of each context, one by one."""
    worth = lambda p: 0.0 if p > k else (1 / math.log2(p + 1) if method else 1 / max(1.0, math.log2(p)))
    out = {}
    for context in {r[0] for r in rows}:
        mine = [(r[1], r[2] or 0.0, r[3] or 0.0) for r in rows if r[0] == context]
        by_score = sorted(mine, key=lambda r: (-r[2], r[0]))
        place = {r[0]: i for i, r in enumerate(by_score, 1)}
        ideal = sum(g * worth(i) for i, g in enumerate(sorted((r[1] for r in mine), reverse=True), 1))
        for i, gi, si in mine:
            grad = curve = 0.0
            for j, gj, sj in mine:
                if gi != gj and ideal > 0:
                    side = 1 if gi > gj else -1
                    chance = 1 / (1 + math.exp(side * (si - sj)))
                    change = abs(gi - gj) * abs(worth(place[i]) - worth(place[j])) / ideal
                    grad, curve = grad + side * chance * change, curve + chance * (1 - chance) * change
            out[context, i] = (grad, curve)
    return out


def cases():
    rng = np.random.default_rng(3)
    rows = [(int(c), i, float(rng.integers(0, 4)), float(rng.normal()), "x") for i, c in enumerate(rng.choice([1, 2, 3, 4], 200, p=[0.7, 0.2, 0.05, 0.05]))]
    rows += [(9, 1000 + i, 0.0, float(i), "x") for i in range(5)] + [(10, 2000, 2.0, 1.0, "x")]
    rows += [(11, 3000, None, 1.0, "x"), (11, 3001, 1.0, None, "x"), (11, 3002, 3.0, 1.0, "x")]
    return rows + [(None, 4000 + i, float(i % 3), float(-i), None) for i in range(6)]


@pytest.mark.parametrize("k,method,options", [
    (3, 1, {}), (20, 0, {}), (500, 1, {}), (4, 1, {"broadcast_bytes": 0}), (4, 1, {"broadcast_bytes": 0, "hot_rows": 30}),
])
def test_gradients_equal_all_pairs(spark, k, method, options):
    rows = cases()
    if k > 100:
        rows, k = rows[:150], 60
    got = rank_gradients(spark.createDataFrame(rows, SCHEMA), RankTask(k=k, method=method), "s", **options)
    assert got.columns == ["context_id", "reply_id", "target", "s", "extra", "gradient", "curvature"]
    got = {(r.context_id, r.reply_id): (r.gradient, r.curvature) for r in got.collect()}
    want = plain(rows, k, method)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9)


def test_no_rows_give_none(spark):
    assert rank_gradients(spark.createDataFrame([], SCHEMA), RankTask(), "s").count() == 0


def test_no_pair_becomes_a_row(spark):
    plan = rank_gradients(spark.createDataFrame(cases(), SCHEMA), RankTask(), "s")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def planted(spark):
    """Contexts differ in level, which the squared loss fits first; within a context one feature tells the gains."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        c = i % 60
        level, good = (c % 6) * 10.0, rng.normal()
        gain = float(np.clip(round(good + 1.5), 0, 3))
        rows.append((c, i, gain, gain + level, Vectors.dense([level, good + rng.normal(scale=0.4), rng.normal()])))
    return spark.createDataFrame(rows, ["context_id", "reply_id", "target", "shifted", "features"]).cache()


def mean(df, model):
    return ndcg(M.predict(model, df), ["context_id"], "target", "pred", "reply_id", 3, 1).agg({"ndcg": "avg"}).first()[0]


def test_not_below_the_squared_loss(planted):
    train, valid = planted.where("context_id % 3 > 0"), planted.where("context_id % 3 = 0")
    options = {"trees": 8, "leaves": 4, "min_rows": 5, "bins": 32, "rate": 0.3}
    squared = M.boosted("embedding", label="shifted", **options).fit(train)
    ranked = RankBoost(M.boosted("embedding", **options), RankTask(k=3)).fit(train)
    assert ranked.kept == ranked.fitted == 8
    assert mean(valid, ranked) >= mean(valid, squared)


def test_stops_by_valid_ndcg(planted):
    train, valid = planted.where("context_id % 3 > 0"), planted.where("context_id % 3 = 0")
    est = M.boosted("embedding", trees=40, leaves=4, min_rows=5, bins=32, rate=0.5)
    model, losses = fit_ranked(est, train, RankTask(k=3), valid, rounds=2, chunk=3)
    assert model.kept == M.best_round(losses, 2) and model.fitted == len(losses) <= model.kept + 2 + 3
    assert 1 - mean(valid, model) == pytest.approx(losses[model.kept - 1])


def test_equal_gains_score_alike(planted):
    rows = planted.selectExpr("context_id", "reply_id", "1.0 as target", "features")
    model = RankBoost(M.boosted("embedding", trees=2)).fit(rows)
    assert {r.pred for r in M.predict(model, rows).collect()} == {0.0}
