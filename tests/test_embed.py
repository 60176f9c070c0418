import random

import numpy as np
import pytest

from rankloom.operators import embed as E


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(
        [("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "word string, vector array<double>"
    )


def test_sentence_vector_fixture(spark, vectors):
    df = spark.createDataFrame([(1, "a b q z"), (2, "q"), (3, "")], "id int, text string")
    got = {r.id: r.vector for r in E.sentence_vectors(df, ["id"], "text", vectors, 2).collect()}
    assert got == {1: pytest.approx([0.3, 0.9]), 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_repeated_tokens_count(spark, vectors):
    df = spark.createDataFrame([(1, "a a b")], "id int, text string")
    got = E.sentence_vectors(df, ["id"], "text", vectors, 2).first().vector
    assert got == pytest.approx([1.2 / 3, 2.6 / 3])


def test_weighted_vector_fixture(spark):
    vectors = spark.createDataFrame([("p", [1.0, 2.0]), ("q", [3.0, 4.0])], "word string, vector array<double>")
    weights = spark.createDataFrame([(1, "p", 0.5), (1, "q", 2.0), (1, "none", 9.0)], "id int, term string, weight double")
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    got = {r.id: r.vector for r in E.weighted_vectors(weights, rows, ["id"], vectors, 2).collect()}
    assert got == {1: pytest.approx([6.5, 9.0]), 2: [0.0, 0.0]}


def test_a_vector_table_in_parts_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    table = {w: rng.normal(size=4).tolist() for w in words}
    vectors = spark.createDataFrame(list(table.items()), "word string, vector array<double>")
    pick = random.Random(1)
    texts = [(i, " ".join(pick.choices(words + ["unknown"], k=pick.randrange(12)))) for i in range(50)]
    df = spark.createDataFrame(texts, "id int, text string")
    whole = {r.id: r.vector for r in E.sentence_vectors(df, ["id"], "text", vectors, 4).collect()}
    monkeypatch.setattr(E, "WORDS", 9)
    parts = {r.id: r.vector for r in E.sentence_vectors(df, ["id"], "text", vectors, 4, limit=1000).collect()}
    weights = spark.createDataFrame([(1, "w3", 1.0), (1, "w4", 1.0), (2, "w3", 1.0), (2, "none", 1.0)], "id int, term string, weight double")
    _, places, dense, size = E._placed(weights, vectors, 4, 1000)
    assert {r.term for r in places.collect()} == {"w3", "w4"} and size == 2 * 5 * 8
    _, places, dense, _ = E._placed(weights, vectors, 4, 1 << 20)
    assert places.count() == 60 and dense.count() > 3
    assert whole.keys() == parts.keys()
    for i, text in texts:
        known = [np.array(table[w]) / np.linalg.norm(table[w]) for w in text.split() if w in table]
        want = np.mean(known, axis=0) if known else np.zeros(4)
        assert whole[i] == pytest.approx(want.tolist())
        assert parts[i] == pytest.approx(want.tolist())


def test_columns_end_to_end(spark, vectors):
    df = spark.createDataFrame([(1, "a", ""), (2, "", ""), (3, "q", "b")], "id int, x string, y string")
    got = {r.id: r.features for r in E.column_sentence_vectors(df, ["id"], ["x", "y"], vectors, 2).collect()}
    assert got == {1: pytest.approx([0.6, 0.8, 0.0, 0.0]), 2: [0.0] * 4, 3: pytest.approx([0.0, 0.0, 0.0, 1.0])}


def test_columns_of_a_row_stay_together(spark, vectors):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    plan = E.column_sentence_vectors(df, ["id"], ["x", "y"], vectors, 2)._jdf.queryExecution().executedPlan().toString()
    # One for the texts; the vector table is dealt into its blocks apart from them.
    assert plan.count("Exchange hashpartitioning(id") <= 1
    assert "SortMergeJoin [term" not in plan and "SortMergeJoin [block" not in plan and "BroadcastHashJoin" in plan


def test_last_wins(spark, rows):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 0)], "k string, v int, o int")
    assert rows(E.last_wins(df, "k", "v", "o")) == [("a", 2), ("b", 3)]


def test_prepare_word_vectors(spark, rows):
    raw = spark.createDataFrame(
        [(0, "ёлка_NOUN", [1.0]), (1, "елка_VERB", [2.0]), (2, "cats_NOUN", [3.0]), (3, "cat_NOUN", [4.0])],
        "ordinal long, word string, vector array<double>",
    )
    assert rows(E.prepare_word_vectors(raw)) == [("cat", [4.0]), ("cats", [3.0]), ("елка", [2.0])]
    lemmas = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    assert rows(E.prepare_word_vectors(raw, lemmas)) == [("cat", [4.0]), ("елка", [2.0])]


def test_align(spark, rows, vectors):
    vocab = spark.createDataFrame([("b",), ("b c",)], "term string")
    assert rows(E.align_vectors(vocab, vectors, 2), "term", "vector") == [("b c", [0.0, 0.0]), ("b", [0.0, 2.0])]


def test_clean_tokens(spark, rows):
    df = spark.createDataFrame([(1, "Cats, a DOG & ёлки x2"), (2, "!"), (3, "the cats")], "id int, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("елки", "елка")], "token string, lemma string")
    assert rows(E.clean_tokens(df, ["id"], "text")) == [(1, "cats dog елки x2"), (2, ""), (3, "the cats")]
    got = rows(E.clean_tokens(df, ["id"], "text", lemmas, ["the"]))
    assert got == [(1, "cat dog елка x2"), (2, ""), (3, "cat")]


def test_bind(spark, rows):
    a = spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    b = spark.createDataFrame([(1, [2.0, 3.0])], "id int, w array<double>")
    assert rows(E.bind_columns([("v", a), ("w", b)], ["id"])) == [(1, [1.0, 2.0, 3.0])]


def test_token_mode_keeps_every_row(spark):
    """Four columns at once, a dictionary with repeated tokens, rows with null and repeated keys."""
    from rankloom.operators.embed import clean_token_columns

    lemmas = spark.createDataFrame([("cats", "kat"), ("cats", "cat"), ("dogs", "dog"), (None, "x")], "token string, lemma string")
    rows = [(None, 1, "Cats, dogs!", "", "a bb", None), (None, 1, "Cats, dogs!", "", "a bb", None), (2, 2, "éte", "dogs dogs", "z", "cats")]
    df = spark.createDataFrame(rows, "k long, n long, a string, b string, c string, d string")
    got = sorted(map(tuple, clean_token_columns(df, ["a", "b", "c", "d"], lemmas).collect()), key=repr)
    assert got == sorted([(None, 1, "cat dog", "", "bb", "")] * 2 + [(2, 2, "ete", "dog dog", "", "cat")], key=repr)


def test_bound_columns_keep_null_and_missing_keys(spark):
    from rankloom.operators.embed import bind_columns

    a = spark.createDataFrame([(1, [1.0]), (None, [2.0])], "k long, v array<double>")
    b = spark.createDataFrame([(1, [3.0, 4.0]), (5, [5.0, 6.0])], "k long, w array<double>")
    got = {r.k: r.features for r in bind_columns([("v", a), ("w", b)], ["k"]).collect()}
    assert got == {1: [1.0, 3.0, 4.0], None: [2.0, 0.0, 0.0], 5: [0.0, 5.0, 6.0]}
