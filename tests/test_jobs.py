"""Whole jobs on a small made-up dialogue set."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import folds as D
from rankloom.operators import learners as M
from rankloom.plans import features as P
from rankloom.plans import prepare as A
from rankloom.plans import training as T
from rankloom.session import settle
from rankloom.settings import LexicalSettings
from rankloom.sources import delimited as S

GOOD, BAD = ["yes sure", "of course", "fine thanks"], ["blue stone", "seven rivers", "no idea at all"]
SMALL = {"trees": 5, "leaves": 4, "min_rows": 2, "bins": 16}
LEXICAL = LexicalSettings(char_range=(2, 3), word_range=(1, 2), max_features=60, components=3)


def lines(n, labelled, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.5
        reply = rng.choice(GOOD if good else BAD)
        cells = [str(i // 4), "hello & you", rng.choice(["", "NA", "well 25"]), rng.choice(["how are you?", "coming?"]), str(i % 4), reply]
        out.append("\t".join([*cells, "good" if good else "bad", str(round(rng.random(), 3))] if labelled else cells))
    return out


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    (base / "train.tsv").write_text("\n".join(lines(80, True, 1)) + "\n")
    (base / "final.tsv").write_text("\n".join([*lines(20, False, 2), "9\ttoo\tmany\tfields\t1\tr\textra"]) + "\n")
    train, test = A.prepare_files(spark, str(base / "train.tsv"), str(base / "final.tsv"), str(base / "out"))
    return base, train, test


@pytest.fixture(scope="module")
def vectors(spark):
    words = "yes sure of course fine thanks blue stone seven rivers no idea hello you how are".split()
    data = [(w, [float(i % 3), float(i % 5), 1.0]) for i, w in enumerate(words)]
    return spark.createDataFrame(data, "word string, vector array<double>")


def test_preparation(spark, prepared):
    base, train, test = prepared
    assert (train.count(), test.count()) == (80, 20)
    row = train.where("context_1 = 'well два пять'").first()
    assert row.context_2 == "hello и you"
    assert train.where("context_1 = ''").count() > 0
    assert train.where("label = 'good' and rank <> 3").count() == 0
    assert train.where(F.abs(F.col("target") - F.col("rank") * F.col("confidence")) > 1e-12).count() == 0
    back = S.read_prepared(spark, str(base / "out" / "train_modified"), train.select("row_id", *[c for c in train.columns if c != "row_id"]).schema)
    assert sorted(back.select("row_id", "reply", "target").collect()) == sorted(train.select("row_id", "reply", "target").collect())
    text = "".join(p.read_text() for p in sorted((base / "out" / "train_text" / "reply").glob("part-*"))).split("\n")[:-1]
    assert text == [r.reply for r in train.orderBy("row_id").collect()]


def test_token_mode(spark):
    raw = spark.createDataFrame([(1, 1, "The CATS, a é"), (1, 2, None)], "context_id int, reply_id int, reply string")
    lemmas = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    plain = {r.reply_id: r.reply for r in A.prepare(raw, ["reply"], mode="tokens").collect()}
    joined = {r.reply_id: r.reply for r in A.prepare(raw, ["reply"], mode="tokens", lemmas=lemmas).collect()}
    assert plain == {1: "the cats", 2: ""} and joined == {1: "the cat", 2: ""}


def check(done, n_train, n_test, folds):
    assert done.predictions.where("role = 'valid'").count() == n_train
    assert done.predictions.where("role = 'train'").count() == n_train * (folds - 1)
    assert done.report.count() == folds
    mean = done.mean.first()
    assert 0 < mean.cv_ndcg <= 100_000 and mean.cv_mse > 0
    ranked = done.ranked.collect()
    assert len({(r.context_id, r.reply_id) for r in ranked}) == len(ranked) == n_test


def test_embedding_ranker(spark, prepared, vectors, tmp_path):
    _, train, test = prepared
    train = D.assign_folds(train, ["context_id", "reply_id"], 4)
    features = P.embedding_features(train, vectors, 3).join(train.select(*P.KEYS, "fold", "target"), list(P.KEYS)).cache()
    assert features.first().features.size == 12
    done = T.train_and_rank(features, M.boosted("embedding", **SMALL), 4, P.embedding_features(test, vectors, 3))
    check(done, 80, 20, 4)
    S.write_submission(done.ranked, str(tmp_path / "sub"))
    assert spark.read.text(str(tmp_path / "sub")).count() == 20
    by_reply = done.predictions.where("role = 'valid'").join(train.select(*P.KEYS, "label"), list(P.KEYS))
    means = {r.label: r.m for r in by_reply.groupBy("label").agg(F.avg("pred").alias("m")).collect()}
    assert means["good"] > means["bad"]


@pytest.mark.parametrize("components", [3, None])
def test_lexical_ranker(spark, prepared, tmp_path, components):
    _, train, test = prepared
    settings = LexicalSettings(char_range=(2, 3), word_range=(1, 2), max_features=60, components=components)
    rows = settle(D.assign_folds(train, ["context_id", "reply_id"], 2))
    path = str(tmp_path / "f")
    P.write_fold_features(spark, path, rows, test, 2, P.LexicalFeatures.fit_folds(rows, 2, settings), scale=components is not None)
    valid = P.stored_fold(spark, path)(0)[1]
    width = valid.first().features.size
    assert width == (4 * 2 * 3 if components else width) and width > 20
    done = T.train_and_rank(P.stored_fold(spark, path), M.boosted("lexical", **SMALL), 2, P.stored_holdout(spark, path))
    check(done, 80, 20, 2)


def test_word_vector_ranker(spark, prepared, vectors, tmp_path):
    _, train, test = prepared
    rows = settle(D.assign_folds(train, ["context_id", "reply_id"], 2))
    path = str(tmp_path / "f")
    P.write_fold_features(spark, path, rows, test, 2, P.fit_word_vector_features(rows, 2, vectors, 3, LEXICAL))
    done = T.train_and_rank(
        P.stored_fold(spark, path), M.boosted("word_vectors", **SMALL), 2, P.stored_holdout(spark, path), early_stopping=True, rounds=2
    )
    check(done, 80, 20, 2)
    assert all(1 <= m.kept <= 5 for m in done.models.values())


def test_blend(spark, prepared, tmp_path):
    _, train, test = prepared
    rows = settle(D.assign_folds(train, ["context_id", "reply_id"], 2))
    path = str(tmp_path / "f")
    P.write_fold_features(spark, path, rows, test, 2, P.LexicalFeatures.fit_folds(rows, 2, LEXICAL, char_counts=True))
    learners = {"lr": M.linear(ridge=0.1)} | {n: M.boosted(n, **SMALL) for n in ("xgb", "cat", "lgbm")}
    done = T.blend_and_rank(P.stored_fold(spark, path), learners, 2, P.stored_holdout(spark, path), early_stopping=True)
    assert done.predictions.count() == 80
    assert done.choices.count() == 2
    assert done.ranked.count() == 20
    assert done.loss.first().cv_loss > 0
