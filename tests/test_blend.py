import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rankloom.functions.scoring import WAYS, blend
from rankloom.operators import blend as B

MODELS = ("lr", "xgb", "cat", "lgbm")


def plain(values, way):
    m = len(values)
    if way == "mean":
        return sum(values) / m
    if way == "geom":
        return abs(math.prod(values)) ** (1 / m)
    if 0 in values:
        return 0.0
    total = sum(1 / v for v in values)
    return m / total if total else math.inf


def score(spark, values, way):
    return spark.range(1).select(blend([F.lit(float(v)) for v in values], way).alias("s")).first().s


@pytest.mark.parametrize("way,values,want", [
    ("geom", (2, -8), 4), ("harmonic", (2, -8), 16 / 3), ("harmonic", (0, 4), 0), ("mean", (2, -8), -3),
    ("harmonic", (2, -2), math.inf),
])
def test_ways(spark, way, values, want):
    assert score(spark, values, way) == pytest.approx(want)


def test_combinations():
    combos = B.model_combinations(MODELS)
    assert len(combos) == 10
    assert combos[0] == ("lr", "xgb") and combos[-1] == ("xgb", "cat", "lgbm")
    assert len(B.model_combinations(MODELS, max_size=4)) == 11


def sample(spark, n=90):
    rng = random.Random(2)
    data = [(i % 3, i, rng.random() * 3, *[rng.random() * 3 + 0.1 for _ in MODELS]) for i in range(n)]
    return data, spark.createDataFrame(data, "fold int, reply_id int, target double, lr double, xgb double, cat double, lgbm double")


def losses(rows):
    out = {}
    for size in (2, 3):
        for c in combinations(range(4), size):
            for way in WAYS:
                errs = [(r[2] - plain([r[3 + i] for i in c], way)) ** 2 for r in rows]
                out["_".join(MODELS[i] for i in c), way] = sum(errs) / len(errs)
    return out


def test_losses_and_choice(spark):
    data, df = sample(spark)
    got = {(r.fold, r.combo, r.way): r.loss for r in B.blend_losses(df, "target", MODELS, ["fold"]).collect()}
    choices = {r.fold: r for r in B.best_choice(df, "target", MODELS, ["fold"]).collect()}
    for f in range(3):
        rows = [d for d in data if d[0] == f]
        want = losses(rows)
        assert {k[1:]: v for k, v in got.items() if k[0] == f} == pytest.approx(want)
        single = {m: sum((r[2] - r[3 + i]) ** 2 for r in rows) / len(rows) for i, m in enumerate(MODELS)}
        (combo, way), loss = min(want.items(), key=lambda kv: kv[1])
        model, alone = min(single.items(), key=lambda kv: kv[1])
        assert choices[f].loss == pytest.approx(min(loss, alone))
        if loss < alone:
            assert (choices[f].best, choices[f].way, "_".join(choices[f].members)) == ("averaged", way, combo)
        else:
            assert (choices[f].best, choices[f].way) == (model, None)


def test_highest_loss_when_lower_is_not_better(spark):
    data, df = sample(spark)
    best = B.best_blend(B.blend_losses(df, "target", MODELS), lower_is_better=False).first()
    assert best.loss == pytest.approx(max(losses(data).values()))


def test_first_wins_a_tie_and_infinity_never_wins(spark):
    same = spark.createDataFrame([(1.0, 2.0, 2.0, 2.0)], "target double, a double, b double, c double")
    choice = B.best_choice(same, "target", ["a", "b", "c"]).first()
    assert (choice.best, choice.members) == ("a", ["a"])
    cancel = spark.createDataFrame([(1.0, 2.0, -2.0, 5.0)], "target double, a double, b double, c double")
    loss = {(r.combo, r.way): r.loss for r in B.blend_losses(cancel, "target", ["a", "b", "c"]).collect()}
    assert loss["a_b", "harmonic"] == math.inf
    assert B.best_blend(B.blend_losses(cancel, "target", ["a", "b", "c"])).first().loss < math.inf


def test_many_models_need_several_passes(spark):
    models = [f"m{i}" for i in range(6)]
    df = spark.range(20).select(F.lit(1.0).alias("target"), *[(F.rand(i) + 0.5).alias(m) for i, m in enumerate(models)])
    assert B.blend_losses(df, "target", models).count() == (2**6 - 2 - 6) * 3


def test_holdout(spark):
    data, df = sample(spark)
    choices = B.best_choice(df, "target", MODELS, ["fold"])
    picked = {r.fold: r for r in choices.collect()}
    hold = [(f, i, *[1.0 + f + i + j for j in range(4)]) for f in range(3) for i in range(5)]
    rows = spark.createDataFrame(hold, "fold int, reply_id int, lr double, xgb double, cat double, lgbm double")
    got = {r.reply_id: r["rank"] for r in B.blended_holdout(rows, choices, ["reply_id"], MODELS).collect()}
    for i in range(5):
        scores = []
        for f in range(3):
            values = [1.0 + f + i + MODELS.index(m) for m in picked[f].members]
            scores.append(plain(values, picked[f].way) if picked[f].way else values[0])
        assert got[i] == pytest.approx(-sum(scores) / 3)


def test_wide_predictions(spark, rows):
    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "a", 1.0)], "id int, model string, pred double")
    assert rows(B.wide_predictions(long, ["id"], ["a", "b"])) == [(1, 0.5, 0.25), (2, 1.0, None)]
