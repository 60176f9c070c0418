import gzip

import pytest
from pyspark.sql import types as T

from rankloom.operators import folds as D
from rankloom.sources import delimited as S
from rankloom.sources import stores
from rankloom.sources import vectors as V

LINES = [
    "1\tc2\tc1\tc0\t7\tfull \"x",
    "2\tonly\tthree",
    "3\ta\tb\tc\t8\tr\textra",
    "4\tNA\t\tnan\tbad\tNULL",
    "",
]


def put(path, lines, opener=open):
    with opener(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_lenient_tsv(spark, tmp_path, rows):
    path = put(tmp_path / "final.tsv", LINES)
    assert rows(S.read_tsv_lenient(spark, path)) == [
        (1, "c2", "c1", "c0", 7, 'full "x'),
        (2, "only", "three", None, None, None),
        (4, None, None, None, None, None),
    ]


def test_strict_tsv(spark, tmp_path, rows):
    path = put(tmp_path / "train.tsv", ["1\ta\tb\tc\t2\t\"r\tgood\t0.75", "2\ta\tb\tc\t3\tr\tbad"])
    assert rows(S.read_tsv(spark, path)) == [(1, "a", "b", "c", 2, '"r', "good", 0.75), (2, "a", "b", "c", 3, "r", "bad", None)]
    with pytest.raises(Exception, match="at most 6 fields"):
        S.read_tsv(spark, put(tmp_path / "long.tsv", LINES), S.UNLABELLED).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.read_tsv(spark, put(tmp_path / "word.tsv", ["x\ta"]), S.UNLABELLED).collect()


def test_prepared_round_trip(spark, tmp_path, rows):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("t", T.StringType()), T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame([(0, 'q"x', 1.5), (1, "", None), (2, None, 2.0), (3, "two words", 3.0), (4, '"', 0.0)], schema)
    S.write_prepared(df, str(tmp_path / "p"))
    assert rows(S.read_prepared(spark, str(tmp_path / "p"), schema)) == [
        (0, 'q"x', 1.5), (1, "", None), (2, "", 2.0), (3, "two words", 3.0), (4, '"', 0.0),
    ]


def test_text_lines_keep_row_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}" if i % 3 else "", f"other {i}") for i in range(500)], "row_id long, a string, b string")
    S.write_text_lines(df.repartition(5), str(tmp_path / "t"), "row_id", ["a", "b"])
    for c, word in (("a", "line"), ("b", "other")):
        parts = sorted((tmp_path / "t" / c).glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        want = [f"{word} {i}" if c == "b" or i % 3 else "" for i in range(500)]
        assert text.split("\n")[:-1] == want
    with pytest.raises(Exception, match="line break in text of row 0"):
        S.write_text_lines(spark.createDataFrame([(0, "a\nb")], "row_id long, a string"), str(tmp_path / "u"), "row_id", ["a"])


def test_submission_is_in_global_order(spark, tmp_path):
    data = [(i % 7, i, -float(i * 31 % 100)) for i in range(300)]
    df = spark.createDataFrame(data, "context_id int, reply_id int, rank double")
    S.write_submission(df.repartition(4), str(tmp_path / "s"))
    S.write_ranked(df, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    want = sorted(data, key=lambda t: (t[0], t[2], t[1]))
    assert text.split("\n")[:-1] == [f"{c} {r}" for c, r, _ in want]
    assert S.read_prepared(spark, str(tmp_path / "r"), df.schema).count() == 300


def test_text_vectors(spark, tmp_path):
    path = put(tmp_path / "v.txt", ["some words 1 2.5 -3 ", "1 2 3", "x 0.1 0.2 3e-1"])
    got = [r.vector for r in V.read_text_vectors(spark, path, 3).orderBy("ordinal").collect()]
    assert got == [[1.0, 2.5, -3.0], [1.0, 2.0, 3.0], [0.1, 0.2, 0.3]]


def test_word_vectors_keep_file_order(spark, tmp_path):
    path = put(tmp_path / "w.vec.gz", ["3 2", "b_NOUN 1 2", "a_VERB 3 4", "b_NOUN 5 6"], gzip.open)
    got = [(r.word, r.vector) for r in V.read_word_vectors(spark, path, 2).orderBy("ordinal").collect()]
    assert got == [("b_NOUN", [1.0, 2.0]), ("a_VERB", [3.0, 4.0]), ("b_NOUN", [5.0, 6.0])]


def test_feature_store_reads_one_partition(spark, tmp_path):
    df = D.fold_roles(D.assign_folds(spark.range(60), ["id"], 3), 3)
    stores.write_features(df, str(tmp_path / "f"))
    one = stores.read_features(spark, str(tmp_path / "f"), 1, "valid")
    assert one.count() == 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_folds_are_loaded_when_they_exist(spark, tmp_path):
    path, calls = str(tmp_path / "folds"), []

    def create():
        calls.append(1)
        return D.assign_folds(spark.range(30), ["id"], 3)

    first = stores.load_or_create_folds(spark, path, create).collect()
    assert sorted(first) == sorted(stores.load_or_create_folds(spark, path, create).collect())
    assert calls == [1]


def test_word_vectors_follow_the_files_as_listed(spark, tmp_path):
    """A small first file and a large second one: Spark reads the large one first, the order is still that of the list."""
    small, large = tmp_path / "a.vec", tmp_path / "b.vec"
    small.write_text("3 2\nw 1 1\n10 20 30\n")
    large.write_text("".join(f"x{i} 0 0\n" for i in range(5000)) + "w 2 2\n")
    got = V.read_word_vectors(spark, [str(small), str(large)], 2)
    assert got.count() == 5003
    from rankloom.operators.embed import last_wins

    kept = {r.word: r.vector for r in last_wins(got, "word", "vector", "ordinal").where("word in ('w', '10')").collect()}
    assert kept == {"w": [2.0, 2.0], "10": [20.0, 30.0]}


def test_short_vector_lines_are_errors(spark, tmp_path):
    (tmp_path / "v").write_text("1 2\n")
    with pytest.raises(Exception, match="fewer than 3 numbers"):
        V.read_text_vectors(spark, str(tmp_path / "v"), 3).collect()


def test_keyed_vectors(spark, tmp_path):
    (tmp_path / "v").write_text("7 1 2\n5 3 4\n")
    assert {r.row_id: r.vector for r in V.read_keyed_vectors(spark, str(tmp_path / "v"), 2).collect()} == {7: [1.0, 2.0], 5: [3.0, 4.0]}
