import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics as M
from rankloom.operators import ranking as R


def dcg(gains, k, method=0):
    gains = gains[:k]
    if method == 0:
        return sum(g / (1 if p == 1 else math.log2(p)) for p, g in enumerate(gains, 1))
    return sum(g / math.log2(p + 1) for p, g in enumerate(gains, 1))


def plain_ndcg(rows, k, method=0):
    """rows of one context: (gain, score, candidate)."""
    ranked = [g for g, s, c in sorted(rows, key=lambda r: (-r[1], r[2]))]
    cut = len({c for _, _, c in rows}) if k == "distinct" else k
    best = dcg(sorted(ranked, reverse=True), cut, method)
    return dcg(ranked, cut, method) / best if best else 0.0


def sample(spark, n=400, seed=3, repeats=False):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        context = 0 if i % 3 == 0 else i % 23
        candidate = rng.randrange(40) if repeats else i
        data.append((context, candidate, float(rng.choice([0, 0, 1, 2, 3])), i * 7919 % 1000 / 10))
    return data, spark.createDataFrame(data, "context_id int, reply_id int, gain double, score double")


def by_context(data):
    out = {}
    for context, candidate, gain, score in data:
        out.setdefault(context, []).append((gain, score, candidate))
    return out


@pytest.mark.parametrize("k", [1, 3, 10, 10_000, "distinct"])
@pytest.mark.parametrize("method", [0, 1])
def test_ndcg_against_lists(spark, k, method):
    data, df = sample(spark)
    got = {r.context_id: r.ndcg for r in R.ndcg(df, ["context_id"], "gain", "score", "reply_id", k, method).collect()}
    want = {c: plain_ndcg(rows, k, method) for c, rows in by_context(data).items()}
    assert got == pytest.approx(want)


def test_hot_contexts(spark):
    data, df = sample(spark)
    got = {r.context_id: r.ndcg for r in R.ndcg(df, ["context_id"], "gain", "score", "reply_id", "distinct", hot_rows=20).collect()}
    assert got == pytest.approx({c: plain_ndcg(rows, "distinct") for c, rows in by_context(data).items()})


def test_repeated_candidates_shorten_the_cut(spark):
    data = [(1, 5, 3.0, 0.9), (1, 5, 1.0, 0.8), (1, 6, 2.0, 0.7)]
    df = spark.createDataFrame(data, "context_id int, reply_id int, gain double, score double")
    row = R.ndcg(df, ["context_id"], "gain", "score", "reply_id", "distinct").first()
    assert (row.dcg, row.ideal) == (4.0, 5.0)


def test_fixture_values(spark):
    df = spark.createDataFrame([(1, i, g, -float(i)) for i, g in enumerate([3.0, 2.0, 3.0])], "context_id int, reply_id int, gain double, score double")
    assert R.ndcg(df, ["context_id"], "gain", "score", "reply_id", 3).first().dcg == pytest.approx(6.892789, abs=1e-6)
    assert R.ndcg(df, ["context_id"], "gain", "score", "reply_id", 3, 1).first().dcg == pytest.approx(5.761860, abs=1e-6)
    with pytest.raises(ValueError):
        R.ndcg(df, ["context_id"], "gain", "score", "reply_id", 3, 2)


def test_no_gain_scores_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.1), (1, 2, 0.0, 0.2)], "context_id int, reply_id int, gain double, score double")
    assert R.ndcg(df, ["context_id"], "gain", "score", "reply_id", 3).first().ndcg == 0.0


def test_rank_and_evaluate(spark, rows):
    data, df = sample(spark)
    ranked = R.rank_and_evaluate(df, "context_id", "reply_id", "score")
    want = [(c, r) for c, r, _, s in sorted(data, key=lambda t: (t[0], -t[3], t[1]))]
    assert [tuple(r) for r in ranked.collect()] == want
    score = R.rank_and_evaluate(df, "context_id", "reply_id", "score", loss=True).first().mean_ndcg
    lists = {}
    for c, r in want:
        lists.setdefault(c, []).append(r)
    plain = [dcg(x, 3) / dcg(sorted(x, reverse=True), 3) if max(x[:3]) else 0.0 for x in lists.values()]
    assert score == pytest.approx(sum(plain) / len(plain) * 100_000)


def test_top_k_limits_before_the_shuffle(spark):
    _, df = sample(spark)
    best = R.top_k(df, ["context_id"], R.best_first("score", "reply_id"), 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert best.groupBy("context_id").count().agg(F.max("count")).first()[0] == 2


def test_fold_report(spark):
    rng = random.Random(5)
    data = [(f, role, i % 4, i, rng.random() * 3, rng.random() * 3) for f in range(2) for role in ("valid", "train") for i in range(30)]
    df = spark.createDataFrame(data, "fold int, role string, context_id int, reply_id int, y double, p double")
    report = {r.fold: r for r in M.fold_report(df, "y", "p", "context_id", "reply_id", gain="y").collect()}
    for f in range(2):
        valid = [d for d in data if d[:2] == (f, "valid")]
        train = [d for d in data if d[:2] == (f, "train")]
        groups = {}
        for d in valid:
            groups.setdefault(d[2], []).append((d[4], d[5], d[3]))
        ndcg = sum(plain_ndcg(g, "distinct") for g in groups.values()) / len(groups) * 100_000
        assert report[f].ndcg == pytest.approx(ndcg)
        assert report[f].ndcg_int == int(ndcg)
        for rows, suffix in ((valid, ""), (train, "_train")):
            assert report[f][f"mse{suffix}"] == pytest.approx(sum((d[4] - d[5]) ** 2 for d in rows) / len(rows))
            assert report[f][f"mae{suffix}"] == pytest.approx(sum(abs(d[4] - d[5]) for d in rows) / len(rows))
    mean = M.cv_mean(M.fold_report(df, "y", "p", "context_id", "reply_id", "y"), ["mse"]).first().cv_mse
    assert mean == pytest.approx((report[0].mse + report[1].mse) / 2)


def test_averages_and_shape(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 5.0)], "id int, a double, b double")
    assert rows(M.average_columns(df, ["a", "b"]), "id", "rank") == [(1, -2.0), (2, -3.5)]
    long = df.unpivot(["id"], ["a", "b"], "fold", "pred")
    assert rows(M.average_scores(long, ["id"], "pred")) == [(1, -2.0), (2, -3.5)]
    assert rows(M.shape(df.select(F.array("a", "b").alias("v")), "v")) == [(2, 2)]
