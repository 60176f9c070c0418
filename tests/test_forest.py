import hashlib
import time
from math import exp, factorial

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rankloom.operators import learners as M
from rankloom.operators import forest as forests
from rankloom.operators.forest import BootstrapForest, bootstrap_count, bootstrap_counts, poisson_steps
from rankloom.session import swept

KEYS = ("context_id", "reply_id")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = np.sin(x[:, 0] * 2) + 0.5 * x[:, 1] + rng.normal(scale=0.2, size=400)
    rows = [(i % 20, i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, ["context_id", "reply_id", "features", "target"]).cache()


def drawn(context, reply, tree, seed=42):
    digest = hashlib.md5(f"{context}|{reply}|{seed}|{tree}".encode()).hexdigest()
    u = int(digest[:13], 16) / 2**52
    return sum(u >= sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(15))


def test_counts_follow_the_hash(data):
    for tree in (0, 7):
        for r in data.select(*KEYS, bootstrap_count(KEYS, tree).alias("n")).collect():
            assert r.n == drawn(r.context_id, r.reply_id, tree)


def test_counts_are_poisson(spark):
    got = spark.range(40_000).select(bootstrap_count(["id"], 3).alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 40_000 for r in got}
    for i in range(4):
        assert share[i] == pytest.approx(exp(-1) / factorial(i), abs=0.01)
    assert poisson_steps()[-1] == pytest.approx(1.0)


def test_counts_of_all_trees_are_those_of_each(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(300)], "context_id long, reply_id long")
    got = rows.select(bootstrap_counts(KEYS, 12).alias("all"), F.array(*[bootstrap_count(KEYS, t) for t in range(12)]).alias("each"))
    assert all(r["all"] == r["each"] for r in got.collect())


def test_rows_are_hashed_once_for_all_trees(data, monkeypatch):
    """What a tree is fitted on holds the draws; no pass over it hashes a row again."""
    plans, plain = [], forests.RandomForestRegressor.fit
    monkeypatch.setattr(
        forests.RandomForestRegressor, "fit", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(self, df)
    )
    BootstrapForest(3, depth=2).fit_trees(data)
    assert len(plans) == 3 and not any("md5" in p for p in plans)


def test_null_keys_count_as_empty(spark):
    rows = spark.createDataFrame([(None, 1), ("", 1)], "context_id string, reply_id long")
    assert len({r.n for r in rows.select(bootstrap_count(KEYS, 0).alias("n")).collect()}) == 1


def test_out_of_bag_scores_come_from_trees_without_the_row(data, monkeypatch):
    monkeypatch.setattr("rankloom.operators.forest.SCORE_CHUNK", 4)
    forest = BootstrapForest(6, depth=4).fit_trees(data)
    got = {r.reply_id: r for r in forest.out_of_bag(data).collect()}
    each = [{r.reply_id: r.p for r in t.copy({t.predictionCol: "p"}).transform(data).collect()} for t in forest.trees]
    for i, r in got.items():
        out = [t for t in range(6) if drawn(r.context_id, i, t) == 0]
        assert r.trees_out == len(out)
        assert r.pred == (pytest.approx(np.mean([each[t][i] for t in out])) if out else None)
    mean = {r.reply_id: r.pred for r in M.predict(forest.mean, data).collect()}
    assert mean == pytest.approx({i: np.mean([e[i] for e in each]) for i in mean})


def test_a_tree_does_not_see_rows_it_did_not_draw(data):
    spoiled = data.withColumn("target", F.when(bootstrap_count(KEYS, 0) == 0, 1e6).otherwise(F.col("target")))
    a, b = (BootstrapForest(1, depth=4).fit(d) for d in (data, spoiled))
    scores = [[r.pred for r in M.predict(m, data).orderBy("reply_id").collect()] for m in (a, b)]
    assert scores[0] == scores[1]


def test_forest_beats_its_trees_out_of_bag(data):
    forest = BootstrapForest(15, depth=6).fit_trees(data)
    scored = forest.out_of_bag(data).where("trees_out > 0")
    error = scored.agg(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).first()[0]
    assert error < data.agg(F.var_pop("target")).first()[0] / 2


def test_trees_side_by_side_are_bounded_by_the_sums_they_shuffle(data, monkeypatch):
    assert BootstrapForest().side_by_side(1_000, 4, 256) == 8
    assert BootstrapForest().side_by_side(135_000, 34, 256) == 1
    assert BootstrapForest(depth=5).side_by_side(6_000_000, 100, 1) == 8
    seen, plain = [], forests.side_by_side
    monkeypatch.setattr(forests, "side_by_side", lambda fit, tasks, n: seen.append(n) or plain(fit, tasks, n))
    monkeypatch.setattr(forests, "SUM_BYTES", 2 * 400 * 3 * 2 * forests.CELL_BYTES)
    assert len(BootstrapForest(3, depth=2).fit_trees(data).trees) == 3
    assert seen == [2]


def test_what_nothing_refers_to_goes_while_trees_are_fitted(spark, monkeypatch):
    monkeypatch.setattr("rankloom.session.SWEEP_SECONDS", 0.05)
    bean = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    swept_so_far = lambda: sum(b.getCollectionCount() for b in bean)
    before = swept_so_far()
    with swept(spark):
        time.sleep(1)
    assert swept_so_far() > before
