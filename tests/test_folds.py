import hashlib
from collections import Counter

from rankloom.operators import folds as D


def plain_folds(ids, k, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))
    size, more = divmod(len(ids), k)
    out, start = {}, 0
    for f in range(k):
        end = start + size + (f < more)
        out.update({i: f for i in order[start:end]})
        start = end
    return out


def test_folds_are_exact_and_reproducible(spark):
    for n, k in ((23, 10), (1000, 7), (5, 10), (10_007, 10)):
        got = {r.id: r.fold for r in D.assign_folds(spark.range(n), ["id"], k).collect()}
        assert got == plain_folds(range(n), k)


def test_fold_sizes(spark):
    sizes = Counter(r.fold for r in D.assign_folds(spark.range(23), ["id"], 10).collect())
    assert sorted(sizes.values(), reverse=True) == [3, 3, 3] + [2] * 7
    assert [sizes[f] for f in range(3)] == [3, 3, 3]


def test_seed_changes_folds(spark):
    a = {r.id: r.fold for r in D.assign_folds(spark.range(200), ["id"], 5).collect()}
    b = {r.id: r.fold for r in D.assign_folds(spark.range(200), ["id"], 5, seed=1).collect()}
    assert a != b


def test_group_folds_keep_groups_whole(spark):
    df = D.assign_group_folds(spark.range(1000).selectExpr("id % 37 as g", "id"), "g", 4)
    assert df.groupBy("g").agg({"fold": "min"}).count() == 37
    assert df.select("g", "fold").distinct().count() == 37
    assert {r.fold for r in df.select("fold").distinct().collect()} <= set(range(4))


def test_roles(spark):
    df = D.fold_roles(D.assign_folds(spark.range(23), ["id"], 10), 10)
    assert df.count() == 230
    assert df.where("role = 'valid'").count() == 23


def test_complement(spark):
    df = D.assign_folds(spark.range(50), ["id"], 5)
    assert D.train_rows(df, 2).count() + D.valid_rows(df, 2).count() == 50
    assert D.rest_of(df, D.valid_rows(df, 2), ["id"]).count() == 40


def test_fold_count_rounds_half_to_even(spark):
    def count(a, b):
        return D.fold_count(spark.range(a), spark.range(b)).first()["folds"]

    assert (count(5, 2), count(7, 2), count(10, 3)) == (2, 4, 3)
    assert D.fold_count(spark.range(3), spark.range(0)).count() == 1
